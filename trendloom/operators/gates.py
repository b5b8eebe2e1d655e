"""Gates: vectors against a centroid, sampled texts against an anchor, events against a technology family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import text, vectors
from trendloom.operators import tfidf

# Words that say nothing about a topic are passed in by the caller; patterns of the event gate are fixed values.
IDENTITY = {
    "lora_llm": r"(?i)(?<!\w)lora(?!\w)|(?:lora(?:config|_target))|low[ -]rank adaptation",
    "rag": r"(?i)(?<!\w)rag(?!\w)|retrieval[ -]augmented|ragretriever",
}
DOMAIN = {
    "lora_llm": r"(?i)\b(?:llms?|language models?|transformers?|fine[ -]?tun(?:e|ing)|adapters?|peft|qwen|llama|roberta|deberta|rank decomposition|lora(?:config|_target)|checkpoint|weights?)\b",
    "rag": r"(?i)\b(?:retriev\w*|documents?|embeddings?|vector|question answering|answer\w*|llms?|language models?|knowledge|ragretriever|indexing|chatgpt)\b",
}
NAME = {
    "lora_llm": r"(?i)low[ -]rank adaptation|\blora\b|loraconfig|--lora_target",
    "rag": r"(?i)retrieval[ -]augmented|\brag\b|ragretriever|chatgpt retrieval plugin",
}
ACTION = r"(?i)\b(?:add|implement|support|enable|integrat\w*|fix|train\w*|fine[ -]?tun\w*|stream\w*|build|merge|adapt\w*|checkpoint\w*|pipeline|config\w*|retriev\w*|index\w*|introduc\w*)\b|--lora_target|lora(?:config|_target)"
REJECT = r"(?i)remove.*(?:mention|reference|docs)|\b(?:list|catalog|mention|link to)\b.*\b(?:tools|libraries|docs)\b|formatting only|typo fixes|no implementation"
RADIO = r"(?i)lorawan|wireless|radio|gateway|sx127|rf frequencies|sensor network"
IMAGE = r"(?i)diffusers|stable.diffusion|image generation|texture training"
LANGUAGE, LANGUAGE_NAMES = r"(?i)\b(?:llm|language model|transformer)\b", r"(?i)\b(?:llm|language model|transformer|qwen|llama)\b"
LIGHTS = r"(?i)red[ ,/-]*amber[ ,/-]*green|traffic light|status dashboard"
PATCH_MARK = r"(?m)^\s*GIT_PATCH_ADDED_LINES\s*$"
# The files whose patches count.
SOURCE = r"(?i)\.(?:py|ts|tsx|js|jsx|rs|cpp|cc|c|h|go|java|cs)$"
NOT_SOURCE = r"(?i)(?:^|/)(?:docs?|tests?|examples?|tutorials?|notebooks?|fixtures?|vendor|node_modules|generated)/|(?:^|/)test_[^/]+$|(?:^|/)[^/]+(?:_test|\.test|\.spec)\.[a-z]+$"
# The source modules that lineage follows, which are fewer than those whose patches count.
MODULE_SOURCE = r"\.(?:py|ts|tsx|js|jsx|rs|go|cpp|c|h)$"
NOT_MODULE = r"(?i)(^|/)(docs?|tests?|examples?|tutorials?|fixtures?|notebooks?|vendor|node_modules|generated)/|(^|/)(test_[^/]*|[^/]*(_test|\.test|\.spec)\.[^/]+)$"
# What a patch's lines say.
RELEVANT = r"(?i)(?:lora|low.rank|peft|adapter|train|finetun|retriev|rag|vector|embed|generat|query|knowledge|model|tokeniz)"
PATCH = {
    "lora_llm": r"(?i)(?:\blora(?:config|model|lib|_?[a-z][a-z_]*|[A-Z][A-Za-z]*)\b|\bqlora\b|\bget_peft_model\b|\bmark_only_lora_as_trainable\b|\blow.rank\b)",
    "rag": r"(?i)(?:\brag(?:retriever|generator|queryengine|query_engine|_?[a-z_]+)\b|\bretrieval.augmented\b|\bgraph.rag\b)",
}
RETRIEVE, APPLY = r"(?i)retriev|vector.search|embedding|knowledge.graph", r"(?i)generat|query.engine|question.answer|llm|model|prompt|qa\b"


def vector_gate(rows: DataFrame, centroids: DataFrame, by: str, vector: str = "vector", threshold: float = 0.82) -> DataFrame:
    """rows with similarity to their group's centroid and accepted; a row whose vector is invalid is rejected."""
    joined = rows.join(centroids.select(by, "centroid"), by)
    similarity = F.when(vectors.valid(F.col(vector)), vectors.cosine(F.col(vector), F.col("centroid")))
    return joined.withColumn("similarity", similarity).withColumn("accepted", F.coalesce(F.col("similarity") >= threshold, F.lit(False))).drop("centroid")


def coverage(anchor_terms: Column, sample_terms: Column) -> Column:
    return F.when(F.size(anchor_terms) > 0, F.size(F.array_intersect(anchor_terms, sample_terms)) / F.size(anchor_terms)).otherwise(0.0)


def alias_hit(phrase: Column, aliases: Column, context: Column) -> Column:
    """An alias of several words is a part of the text, one of a single word a token; then a context term must
    be a part, too, if there are any."""
    words = F.split(phrase, " ")
    hit = F.exists(aliases, lambda a: F.when(F.contains(a, F.lit(" ")), F.contains(phrase, a)).otherwise(F.array_contains(words, a)))
    return hit & ((F.size(context) == 0) | F.exists(context, lambda c: F.contains(phrase, c)))


def estimate(raw: Column, samples: Column, matched: Column) -> Column:
    """Accepted volume: what was sampled where that is all, one for one match, else in proportion (half to
    even), between the matches and the total."""
    share = F.bround(raw * (matched / samples)).cast("long")
    return F.when((matched == 0) | (samples == 0), F.lit(0)).when(raw <= samples, F.least(raw, matched)).when(matched == 1, F.lit(1)).otherwise(F.least(raw, F.greatest(matched, share))).cast("long")


def sample_gate(cases: DataFrame, samples: DataFrame, generic: tuple[str, ...] = (), similarity: float = 0.16, cover: float = 0.34, strong_similarity: float = 0.42, strong_cover: float = 0.67) -> DataFrame:
    """samples (case_id, sample_id, text) of cases (case_id, anchor, aliases, context) with cosine, coverage and
    accepted. Vectors are fitted on a case's anchor and samples together."""
    asked = samples.join(cases.select("case_id"), "case_id", "left_semi")
    corpus = asked.select("case_id", "sample_id", "text").union(cases.select("case_id", F.lit(-1).cast(samples.schema["sample_id"].dataType), F.col("anchor")))
    near = tfidf.cosines(corpus, "case_id", "sample_id", "text", F.col("sample_id") == -1, tfidf.HYPHENS)
    normal = lambda c: F.filter(F.transform(c, text.normalise_phrase), lambda x: x != "")
    # what an anchor says is told once, and what a text says before it meets its cosine, so that no text need travel
    told = cases.withColumns({"terms_": text.key_terms(F.col("anchor"), generic), "names_": normal(F.col("aliases")), "context_": normal(F.col("context"))})
    df = samples.join(told, "case_id").withColumn("coverage", coverage(F.col("terms_"), text.key_terms(F.col("text"), generic)))
    df = df.withColumns({"aliased_": F.size("names_") > 0, "named_": alias_hit(text.normalise_phrase(F.col("text")), F.col("names_"), F.col("context_"))})
    df = df.drop("terms_", "names_", "context_")
    df = df.join(near, ["case_id", "sample_id"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    strong = (F.col("cosine") >= strong_similarity) & (F.col("coverage") >= strong_cover)
    ordinary = (F.col("cosine") >= similarity) & (F.col("coverage") >= cover)
    return df.withColumn("accepted", F.when(F.col("aliased_"), F.col("named_") | strong).otherwise(ordinary)).drop("aliased_", "named_")


def family(direction: Column) -> Column:
    low = F.regexp_replace(F.lower(direction), "-", " ")
    has = lambda *words: F.greatest(*(F.contains(low, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(low, F.lit(words[0]))
    return F.when(has("low rank adaptation", "lora") & has("language model", "llm", "transformer"), "lora_llm").when(has("retrieval augmented"), "rag")


def event_gate(events: DataFrame) -> DataFrame:
    """events (direction, title, text, source_diff) with family, status, reason and evidence_span: the first
    segment with identity, action, domain and name decides; a patch of the same commit may stand in for it."""
    u = lambda p: p.replace("(?i)", "(?iU)")
    body = F.element_at(F.split(F.coalesce("text", F.lit("")), PATCH_MARK, 2), 1)
    df = events.withColumn("family", family(F.col("direction"))).withColumn("spans_", text.segments(F.col("title"), body))

    def fits(name: str):
        def ok(s: Column) -> Column:
            good = s.rlike(u(IDENTITY[name])) & ~s.rlike(u(REJECT)) & s.rlike(u(ACTION)) & s.rlike(u(DOMAIN[name])) & s.rlike(u(NAME[name]))
            if name == "rag":
                return good & ~s.rlike(u(LIGHTS))
            return good & ~(s.rlike(u(RADIO)) & ~s.rlike(u(LANGUAGE))) & ~(s.rlike(u(IMAGE)) & ~s.rlike(u(LANGUAGE_NAMES))) & ~s.rlike(r"\bLoRa\b")

        return ok

    span = F.when(F.col("family") == "lora_llm", F.get(F.filter("spans_", fits("lora_llm")), F.lit(0))).when(F.col("family") == "rag", F.get(F.filter("spans_", fits("rag")), F.lit(0)))
    df = df.withColumns({"span_": span, "patch_": F.when(~F.col("title").rlike(u(REJECT)), patch_verdict(F.col("family"), F.col("title"), F.col("source_diff")))})
    status = F.when(F.col("family").isNull(), "review_required").when(F.col("span_").isNotNull() | F.col("patch_").isNotNull(), "eligible").otherwise("rejected")
    reason = F.when(F.col("family").isNull(), "no_calibrated_family_policy").when(F.col("span_").isNotNull(), "local_technology_and_implementation_context").otherwise(F.coalesce(F.col("patch_.reason"), F.lit("no_event_local_implementation_evidence")))
    return df.withColumns({"status": status, "reason": reason, "evidence_span": F.substring(F.coalesce("span_", F.col("patch_.span")), 1, 1000)}).drop("spans_", "span_", "patch_")


def patch_verdict(fam: Column, title: Column, diff: Column) -> Column:
    """struct(reason, span) of the first FILE part of a diff whose added code proves the family, else null."""
    u = lambda p: p.replace("(?i)", "(?iU)")
    nothing = F.lit(None).cast("struct<reason:string,span:string>")

    def of(chunk: Column) -> Column:
        name, body = F.substring_index(chunk, "\n", 1), F.regexp_replace(chunk, r"^[^\n]*\n?", "")
        added = F.filter(F.split(body, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
        code = F.filter(F.transform(added, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x)))), lambda x: (x != "") & ~x.rlike(r"^(#|//|\*)"))
        joined = F.array_join(code, "\n")
        told = lambda kind, lines, n: F.struct(F.lit(kind).alias("reason"), F.concat(title, F.lit("\n"), F.array_join(F.slice(lines, 1, n), "\n")).alias("span"))
        lora, rag = F.filter(code, lambda x: x.rlike(u(PATCH["lora_llm"]))), F.filter(code, lambda x: x.rlike(u(PATCH["rag"])))
        radio = F.concat_ws(" ", title, name, joined).rlike(u(RADIO))
        half = title.rlike(u(NAME["rag"])) & joined.rlike(u(RETRIEVE)) & joined.rlike(u(APPLY))
        relevant = F.filter(code, lambda x: x.rlike(u(RETRIEVE)) | x.rlike(u(APPLY)))
        return (
            F.when((F.trim(body) == "") | (F.size(code) == 0), nothing)
            .when((fam == "lora_llm") & ~radio & (F.size(lora) > 0) & F.lower(name).rlike(r"\.(py|ts|tsx|js|rs|go)$"), told("same_sha_executable_lora_code", lora, 3))
            .when((fam == "rag") & (F.size(rag) > 0), told("same_sha_executable_rag_code", rag, 3))
            .when((fam == "rag") & half, told("same_sha_executable_rag_retrieval_query", relevant, 4))
            .otherwise(nothing)
        )

    chunks = F.split(diff, "(?m)^FILE ")
    verdicts = F.filter(F.transform(F.slice(chunks, F.lit(2), F.size(chunks)), of), lambda v: v.isNotNull())
    return F.when(diff.isNotNull() & (F.size(chunks) > 1), F.get(verdicts, F.lit(0)))


def source_file(path: Column) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return path.rlike(SOURCE) & ~path.rlike(NOT_SOURCE)


def source_patch(files: Column, max_files: int = 8, max_lines: int = 14) -> Column:
    """The added, relevant code lines of a commit's first 60 files as FILE parts, or null where there are none."""

    def chunk(f: Column) -> Column:
        added = F.filter(F.split(f["patch"], "\r\n|\r|\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
        code = F.transform(added, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x))))
        code = F.filter(code, lambda x: (x != "") & ~x.rlike(r"^(#|//|/\*|\*|--)") & x.rlike(RELEVANT))
        lines = F.transform(F.slice(code, 1, max_lines), lambda x: F.concat(F.lit("+"), F.substring(x, 1, 220)))
        return F.when(source_file(f["filename"]) & (F.size(lines) > 0), F.concat(F.lit("FILE "), F.replace(f["filename"], F.lit("\\"), F.lit("/")), F.lit("\n"), F.array_join(lines, "\n")))

    found = F.slice(F.filter(F.transform(F.slice(files, 1, 60), chunk), lambda x: x.isNotNull()), 1, max_files)
    return F.when(F.size(found) > 0, F.substring(F.array_join(found, "\n"), 1, 4500))


def module_file(path: Column) -> Column:
    return F.lower(path).rlike(MODULE_SOURCE) & ~path.rlike(NOT_MODULE)


def anchor_paths(diff: Column) -> Column:
    """Distinct paths of source modules in a diff's FILE lines, in order."""
    marked = F.filter(F.split(diff, "\r\n|\r|\n"), lambda x: x.startswith("FILE "))
    return F.array_distinct(F.filter(F.transform(marked, lambda x: F.trim(F.substring(x, F.lit(6), F.length(x)))), module_file))


def matched_terms(body: Column, distinctive: Column, aliases: Column, context: Column) -> Column:
    """Terms of a Git text that count: distinctive ones (with case, if theirs is mixed), aliases of several
    words as parts, aliases of one word only beside a context term; then the context terms. Ordered, distinct."""
    low = F.lower(body)
    found_context = F.filter(context, lambda c: F.contains(low, F.lower(c)))
    mixed = lambda t: (t != F.lower(t)) & (t != F.upper(t))
    word = lambda t: F.concat(F.lit(" "), F.regexp_replace(t, r"(?U)[^\w]+", " "), F.lit(" "))
    sure = F.filter(distinctive, lambda t: F.when(mixed(t), F.contains(body, t)).otherwise(F.contains(low, F.lower(t))))
    named = F.filter(aliases, lambda t: F.when(F.contains(F.trim(t), F.lit(" ")), F.contains(low, F.lower(t))).otherwise(F.contains(word(low), word(F.lower(t))) & (F.size(found_context) > 0)))
    hits = F.concat(sure, named)
    return F.when(F.size(hits) > 0, F.array_distinct(F.concat(hits, found_context))).otherwise(F.array().cast("array<string>"))


def query_terms(query: Column, haystack: Column, stopwords: tuple[str, ...], most: int = 12) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"(?U)(\w+)"), 1), lambda t: (F.length(t) >= 3) & ~t.isin(*stopwords))
    return F.slice(F.array_distinct(F.filter(words, lambda t: F.contains(F.lower(haystack), t))), 1, most)


def accepted_actors(samples: DataFrame, accepted: DataFrame, by: list[str]) -> DataFrame:
    """by and the sorted distinct actors of those samples (by, sample, actor_keys) that accepted (by, sample) names;
    blank actors don't count."""
    kept = samples.join(accepted.select(*by, "sample").distinct(), [*by, "sample"], "left_semi")
    each = kept.select(*by, F.explode("actor_keys").alias("actor")).where("trim(actor) <> ''")
    return each.groupBy(*by).agg(F.array_sort(F.collect_set("actor")).alias("actors"))
