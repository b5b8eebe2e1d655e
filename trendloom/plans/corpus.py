"""Queries over texts: exact and fuzzy deduplication, routing, gates, TF-IDF."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.operators import dedup, gates, metrics, routing, tfidf
from trendloom.operators.dedup_index import DedupIndex
from trendloom.plans.evidence import read
from trendloom.sources.shared import materialize, shared_root

_STOP = ("the", "and", "for", "with")
_FAMILIES = {"alpha": ("the", "of and", "tion"), "beta": ("un", "les", "de la"), "gamma": ("der", "und die"), "delta": ("que", "los de")}


def _titled(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "text", text.first_line(F.col("text")).alias("title"))


def text_normal_forms(spark, sf_dir):
    d = _titled(spark, sf_dir)
    return d.select("doc_id", text.normalise(F.col("title")).alias("normal"), F.size(text.token_set(F.col("title"))).alias("n_tokens"), text.collapse(F.col("title")).alias("collapsed"))


def dedup_exact_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.lit(None).cast("string"), F.col("text")).alias("content"))
    keyed = d.select("doc_id", F.array("content").alias("keys"))
    return dedup.exact_matches(keyed, "doc_id", "keys", "doc_id").select(F.col("id").alias("doc_id"), "duplicate_of")


def dedup_exact_urls(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", text.normalise_url(F.col("url")).alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))


def _candidates(spark, sf_dir):
    d = _titled(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("block"), text.token_set(F.col("title")).alias("tokens"))
    # rows of equal token sets are one candidate: its first row
    d = d.withColumn("k", F.array_sort("tokens")).groupBy("block", "k").agg(F.min("id").alias("id"), F.min_by("tokens", "id").alias("tokens"))
    return d.select("id", "block", "tokens", text.simhash(text.md5_longs(F.col("tokens"))).alias("simhash"), F.array().cast("array<string>").alias("actors"))


def dedup_fuzzy_pairs(spark, sf_dir):
    return dedup.fuzzy_pairs(materialize(_candidates(spark, sf_dir), "candidates"), jaccard=0.6, hamming=16).select("a", "b", F.round("similarity", 6).alias("similarity"))


def dedup_greedy_resolution(spark, sf_dir):
    c = materialize(_candidates(spark, sf_dir), "candidates")
    pairs = dedup.fuzzy_pairs(c, jaccard=0.6, hamming=16).withColumn("reason", F.lit("fuzzy_title"))
    return dedup.resolve(c.select("id", F.col("id").alias("seq")), pairs).select("id", "unique", "duplicate_of", "reason", F.round("similarity", 6).alias("similarity"))


def dedup_index_batches(spark, sf_dir):
    """Documents in order, in three batches, against an index that lasts."""
    d = _titled(spark, sf_dir)
    top = d.agg(F.max("doc_id")).first()[0] or 0
    tokens = text.token_set(F.col("title"))
    rows = d.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.array(text.content_hash(F.lit(None).cast("string"), F.col("text"))).alias("keys"), F.col("lang").alias("block"), tokens.alias("tokens"),
        text.simhash(text.md5_longs(tokens)).alias("simhash"), F.lit(None).cast("array<string>").alias("actors"), F.floor(F.col("doc_id") * 3 / (top + 1)).alias("batch"),
    )
    rows = materialize(rows, "observations")
    index = DedupIndex(spark, f"{shared_root(spark)}/trendloom/dedup-{uuid.uuid4().hex}", jaccard=0.6, hamming=16)
    for batch in range(3):
        index.add(rows.where(F.col("batch") == batch), batch)
    return index.results().select(F.col("seq").alias("id"), "unique", F.col("duplicate_of").cast("long").alias("duplicate_of"), "reason", F.round("similarity", 6).alias("similarity"))


def dedup_key_cases(spark, sf_dir):
    """Keys of all clients, the nameless too: name and city as title and body, the name's hash, and actors: every third has
    an address as its id, and each is named a second time without one."""
    c = read(spark, sf_dir, "clients")
    address = F.when(F.col("client_id") % 3 == 0, F.concat(F.lit("  "), F.upper("email")))
    twice = F.array(F.struct("name", address.alias("external_id")), F.struct(F.concat(F.col("name"), F.lit("  ")).alias("name"), F.lit("").alias("external_id")))
    simhash = text.simhash(text.md5_longs(text.token_set(F.col("name"))))
    return c.select("client_id", text.content_hash(F.col("name"), F.col("city")).alias("content_hash"), F.coalesce(simhash, F.lit(0)).alias("simhash"), F.array_join(text.actor_keys(twice), "|").alias("actors"))


def simhash_titles(spark, sf_dir):
    return _candidates(spark, sf_dir).select("id", "simhash")


def router_classify(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("direction"))
    out = routing.classify(d, routing.signals(spark, _FAMILIES))
    return out.select("id", "profile", F.round("confidence", 3).alias("confidence"), F.array_join("matched", "|").alias("matched"))


#: Signals of all profiles, in order; directions are made of them.
_ALL = [x for found in routing.SIGNALS.values() for x in found]


def router_directions(spark, sf_dir):
    """The real signals on directions made of up to three of them, in upper case for every fifth order."""
    k = F.col("o_orderkey")
    word = lambda i: F.element_at(F.array(*map(F.lit, _ALL)), (i % len(_ALL)).cast("int") + 1)
    said = F.concat_ws(" of ", word(k), F.when(k % 2 == 0, word(k * 7)), F.when(k % 3 == 0, word(k * 11)), F.when(k % 4 == 0, F.lit("plain-words")))
    d = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 13 == 0, "bridges").when(k % 5 == 0, F.upper(said)).otherwise(said).alias("direction"))
    return routing.classify(d, routing.signals(spark)).select("id", "profile", "confidence", F.array_join("matched", "|").alias("matched"))


def term_match_events(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    terms = lambda *x: F.array(*map(F.lit, x))
    found = gates.matched_terms(F.col("text"), terms("Ouwhea", "tion"), terms("of the", "and"), terms("er", "un"))
    return d.select("conv_id", "turn", F.array_join(found, "|").alias("terms"))


def query_terms(spark, sf_dir):
    d = read(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", F.array_join(gates.query_terms(F.lit("The then Tion and under que les edthe"), F.col("text"), _STOP), "|").alias("terms"))


def tfidf_top_terms(spark, sf_dir):
    d = read(spark, sf_dir, "benchmark").select(F.lit("all").alias("g"), "item_id", "text")
    v = tfidf.vectors(d, "g", "item_id", "text")
    return v.groupBy("term").agg(F.round(F.sum("w"), 6).alias("weight"), F.max("df").alias("df"))


def lexical_medoid(spark, sf_dir):
    """The document of each source whose mean cosine to the source's documents is highest."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", text.first_line(F.col("text")).alias("title"))
    v = tfidf.vectors(d, "source", "doc_id", "title", r"(?U)\b(\w[\w-]+)\b", sublinear=False)
    mean = tfidf.mean_cosine(v, "source", "doc_id").withColumn("mean", F.round("mean", 6))
    return mean.groupBy("source").agg(F.min(F.struct(-F.col("mean"), "doc_id")).alias("m")).select("source", F.col("m.doc_id").alias("doc_id"))


def sample_gate_counts(spark, sf_dir):
    """Benchmark items as anchors against the documents of one source each."""
    anchors = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("case_id"), F.col("text").alias("anchor"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("context"))
    samples = read(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("sample_id"), "text")
    gated = gates.sample_gate(anchors, samples, similarity=0.05, cover=0.2)
    n = gated.groupBy("case_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if("accepted").alias("matched"), F.round(F.avg("cosine"), 5).alias("cosine"), F.round(F.avg("coverage"), 5).alias("coverage"))
    return n.select("*", gates.estimate(F.col("samples") * 7, F.col("samples"), F.col("matched")).alias("estimated"))


def estimate_rules(spark, sf_dir):
    """The estimate's cases, from the digits of orders: all of 40 totals, 1 to 11 samples, and matches among them."""
    k = F.col("o_orderkey")
    r = read(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 40).alias("raw"), (k % 11 + 1).alias("samples")).withColumn("matched", F.floor(k / 11) % (F.col("samples") + 1))
    return r.select("o_orderkey", "raw", "samples", "matched", gates.estimate(F.col("raw"), F.col("samples"), F.col("matched")).alias("estimated"))


#: Events of orders by kind: direction, title, text, patch; what the gate makes of them: family, status, reason, span.
_LORA, _RAG = "Low-rank adaptation for language models", "Retrieval augmented generation"
_NOTHING = "no_event_local_implementation_evidence"
_KINDS = [
    ((_LORA, "Add LoRA fine-tuning for LLM adapters", "Implement lora support for transformers.", None), ("lora_llm", "eligible", "local_technology_and_implementation_context", "Add LoRA fine-tuning for LLM adapters (#K)")),
    ((_LORA, "Fix LoRaWAN gateway", "Fix lora radio gateway config", None), ("lora_llm", "rejected", _NOTHING, None)),
    ((_RAG, "Add RAG pipeline over documents", "", None), ("rag", "eligible", "local_technology_and_implementation_context", "Add RAG pipeline over documents (#K)")),
    ((_RAG, "Update docs", "typo fixes", None), ("rag", "rejected", _NOTHING, None)),
    (("Bridges", "Add steel", "", None), (None, "review_required", "no_calibrated_family_policy", None)),
    ((_LORA, "wip", "wip", "FILE peft/lora.py\n+class LoraConfig:\n+    rank = 8"), ("lora_llm", "eligible", "same_sha_executable_lora_code", "wip (#K)\nclass LoraConfig:")),
    ((_RAG, "RAG query", "wip", "FILE a/q.py\n+docs = retriever.get()\n+answer = llm(prompt, docs)"), ("rag", "eligible", "same_sha_executable_rag_retrieval_query", "RAG query (#K)\ndocs = retriever.get()\nanswer = llm(prompt, docs)")),
    ((_RAG, "Traffic light status: add rag for documents", "", None), ("rag", "rejected", _NOTHING, None)),
]


def event_local_gate(spark, sf_dir):
    """Orders as events of eight kinds, numbered in their titles."""
    k = F.col("o_orderkey")
    told = lambda i: F.element_at(F.array(*(F.lit(given[i]).cast("string") for given, _ in _KINDS)), (k % len(_KINDS)).cast("int") + 1)
    e = read(spark, sf_dir, "orders").select(k.alias("id"), told(0).alias("direction"), F.concat(told(1), F.lit(" (#"), k.cast("string"), F.lit(")")).alias("title"), told(2).alias("text"), told(3).alias("source_diff"))
    return gates.event_gate(e).select("id", "family", "status", "reason", "evidence_span")


def confusion_by_split(spark, sf_dir):
    """A rule (few distinct words) against the quality labels, by language."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    words = F.split("text", " ")
    rule = F.size(F.array_distinct(words)) * 2 >= F.size(words)
    return metrics.confusion(d, ["lang"], F.col("quality") == 1, rule)


def threshold_select(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    words = F.split("text", " ")
    scored = d.select((F.col("quality") == 1).alias("expected"), F.round(F.size(F.array_distinct(words)) / F.size(words), 4).alias("score"))
    return metrics.chosen_threshold(metrics.thresholds(scored, [i / 20 for i in range(1, 20)]), most_fp=40, least_recall=0.05)


_W = r"[\p{L}\p{M}\p{N}_]+"
def _norm(x: str) -> str:
    # case folding writes a sharp s as two; the tables have no other letter that it changes beyond lower()
    return f"array_to_string(regexp_extract_all(replace(lower(translate({x}, '-_', '  ')), 'ß', 'ss'), '{_W}'), ' ')"


_TITLE = "trim(split_part(text, chr(10), 1))"
_SET = f"list_filter(string_split({_norm(_TITLE)}, ' '), lambda t: t <> '')"


def _keep_first(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


_CAND = f"""toks as (select doc_id as id, lang as block, {_keep_first(_SET)} as tokens from documents),
  cand as (select block, list_sort(tokens) as k, min(id) as id from toks group by all),
  bits as (select id, i, sum(case when (('0x' || substr(md5(t), 1, 15))::bigint >> i) & 1 = 1 then 1 else -1 end) as s from (select id, unnest(k) as t from cand), range(60) r(i) group by id, i),
  sim as (select id, sum(case when s >= 0 then (1::bigint << i) else 0 end)::bigint as simhash from bits group by id),
  c as (select cand.id, block, k, coalesce(simhash, 0)::bigint as simhash from cand left join sim on cand.id = sim.id)"""


def _router_sql(table: dict[str, tuple[str, ...]] = _FAMILIES, said: str = "select conv_id || '-' || turn as id, text as said from conversations") -> str:
    rows = ", ".join(f"('{p}', {i}, '{s}', '{s.replace('-', ' ')}', least(2.0, 1 + length('{s}') / 24.0))" for i, (p, found) in enumerate(table.items()) for s in found)
    return rf"""with said as ({said}), d as (select id, trim(regexp_replace(lower(replace(said, '-', ' ')), '\s+', ' ', 'g')) as t from said),
  sig(profile, place, signal, needle, weight) as (values {rows}),
  hits as (select id, profile, place, signal, weight from d, sig where case when length(needle) <= 3 then contains(' ' || regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}_]', ' ', 'g') || ' ', ' ' || needle || ' ') else contains(t, needle) end),
  by_p as (select id, profile, place, sum(weight) as score, list(signal) as f from hits group by all),
  r as (select *, row_number() over (partition by id order by score desc, place) as rk from by_p),
  two as (select id, max(profile) filter (rk = 1) as p1, max(score) filter (rk = 1) as s1, max(score) filter (rk = 2) as s2, any_value(f) filter (rk = 1) as f1, any_value(f) filter (rk = 2) as f2 from r where rk <= 2 group by id),
  o as (select d.id, p1, s1, s2, coalesce(s2 >= 0.8 * s1, false) as bth, case when coalesce(s2 >= 0.8 * s1, false) then f1 || f2 else f1 end as f from d left join two on d.id = two.id)
  select id, case when p1 is null or bth then 'mixed' else p1 end as profile, case when p1 is null then 0.25 when bth then 0.55 else round(least(0.95, 0.55 + 0.12 * s1 + 0.06 * (s1 - coalesce(s2, 0))), 3) end as confidence,
  coalesce((select string_agg(x, '|' order by length(x) desc, x) from (select unnest(o.f) as x)), '') as matched from o"""


_WORD = "([" + ", ".join(f"'{x}'" for x in _ALL) + f"])[({{0}}) % {len(_ALL)} + 1]"
_DIRECTIONS_SQL = f"""select o_orderkey as id, case when o_orderkey % 13 = 0 then 'bridges' when o_orderkey % 5 = 0 then upper(x) else x end as said from (select o_orderkey, concat_ws(' of ', {_WORD.format('o_orderkey')},
    case when o_orderkey % 2 = 0 then {_WORD.format('o_orderkey * 7')} end, case when o_orderkey % 3 = 0 then {_WORD.format('o_orderkey * 11')} end, case when o_orderkey % 4 = 0 then 'plain-words' end) as x from orders)"""
_VERDICTS = ", ".join("(" + ", ".join([str(i), *("null" if x is None else f"'{x}'" for x in told)]) + ")" for i, (_, told) in enumerate(_KINDS))


def _tf(p: str, tf: str) -> str:
    """Unit TF-IDF vectors v (g, d, term, w, df, n) of src (g, d, t)."""
    return f"""words as (select g, d, list_filter(regexp_extract_all(lower(t), '{p}'), lambda x: length(x) >= 2) as w from src),
  terms as (select g, d, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as term from words),
  tf as (select g, d, term, count(*) as tf from terms group by all),
  dfs as (select g, term, count(*) as df from tf group by all),
  ns as (select g, count(distinct d) as n from src group by g),
  wt as (select tf.g, tf.d, tf.term, {tf} * (ln((1 + n) / (1 + df)::double) + 1) as w, df, n from tf join dfs on tf.g = dfs.g and tf.term = dfs.term join ns on tf.g = ns.g),
  len as (select g, d, sqrt(sum(w * w)) as l from wt group by all),
  v as (select wt.g, wt.d, term, w / l as w, df, n from wt join len on wt.g = len.g and wt.d = len.d)"""


_WORDS = r"[\p{L}\p{M}\p{N}_]+"
_RULE = "len(list_distinct(string_split(text, ' '))) * 2 >= len(string_split(text, ' '))"


def _url(i: int) -> str:
    return rf"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?', {i})"



_PAIRS = """p as (select x.id as a, y.id as b, x.block, x.k as ka, y.k as kb, len(list_intersect(x.k, y.k)) / len(list_distinct(x.k || y.k))::double as j, bit_count(xor(x.simhash, y.simhash)) as d
      from c x join c y on x.block is not distinct from y.block and x.id < y.id where len(x.k) >= 4 and len(y.k) >= 4), near as (select *, least(j, 1 - d / 64.0) as s from p where j >= 0.6 and d <= 16)"""
# who is a duplicate is decided row by row, in order, from edge (a, b, x, s): a before b, x for exact
_GREEDY = """contested as (select row_number() over (order by b) as i, b, list(a) as nb from edge group by b),
  step(i, dups) as (select 0::bigint, []::bigint[] union all select contested.i, case when len(list_filter(nb, lambda v: not list_contains(dups, v))) > 0 then list_append(dups, b) else dups end from step join contested on contested.i = step.i + 1),
  gone as (select unnest(dups) as id from step where i = (select max(i) from step)),
  best as (select b, arg_min(struct_pack(o := a, x := x, s := s), (case when x then 0 else 1 end, -s, a)) as o from edge where a not in (select id from gone) and b in (select id from gone) group by b)"""
_TOLD = "{0}.id not in (select id from gone) as \"unique\", o.o as duplicate_of, case when o.x then 'exact' when o is not null then 'fuzzy_title' end as reason, round(o.s, 6) as similarity from {0} left join best on best.b = {0}.id"


QUERIES = {
    "text_normal_forms": (text_normal_forms, rf"select doc_id, {_norm(_TITLE)} as normal, len(list_distinct({_SET}))::int as n_tokens, trim(regexp_replace(lower({_TITLE}), '\s+', ' ', 'g')) as collapsed from documents"),
    "dedup_exact_documents": (dedup_exact_documents, f"with h as (select doc_id, sha256({_norm('text')}) as k from documents), f as (select k, min(doc_id) as f from h group by k) select doc_id, f as duplicate_of from h join f on h.k = f.k where doc_id > f"),
    "dedup_exact_urls": (dedup_exact_urls, f"""with p as (select page_id, lower({_url(1)}) || '://' || lower({_url(2)}) || regexp_replace({_url(3)}, '/+$', '') as base,
      array_to_string(list_filter(string_split(substr({_url(4)}, 2), '&'), lambda x: x <> '' and not (starts_with(lower(x), 'utm_') or lower(split_part(x, '=', 1)) in ('ref', 'source', 'fbclid', 'gclid'))), '&') as q from pages)
      select base || case when q <> '' then '?' || q else '' end as url, min(page_id) as first_page, count(*) as n from p group by 1"""),
    "dedup_key_cases": (dedup_key_cases, f"""with n as (select client_id, {_norm("concat_ws(' ', nullif(name, ''), nullif(city, ''))")} as content, {_norm('name')} as own, case when trim(name) <> '' then 'name:' || {_norm('name')} end as called,
        case when client_id % 3 = 0 then 'id:' || nullif(lower(trim(email)), '') end as id from clients),
      t as (select client_id, unnest(list_distinct(list_filter(string_split(own, ' '), lambda x: x <> ''))) as t from n),
      bits as (select client_id, i, sum(case when (('0x' || substr(md5(t), 1, 15))::bigint >> i) & 1 = 1 then 1 else -1 end) as s from t, range(60) r(i) group by client_id, i),
      sim as (select client_id, sum(case when s >= 0 then (1::bigint << i) else 0 end)::bigint as simhash from bits group by client_id)
      select client_id, sha256(nullif(content, '')) as content_hash, coalesce(simhash, 0)::bigint as simhash, concat_ws('|', id, called) as actors from n left join sim using (client_id)"""),
    "simhash_titles": (simhash_titles, f"with {_CAND} select id, simhash from c"),
    "dedup_fuzzy_pairs": (dedup_fuzzy_pairs, f"""with {_CAND}, p as (select x.id as a, y.id as b, len(list_intersect(x.k, y.k)) / len(list_distinct(x.k || y.k))::double as j, bit_count(xor(x.simhash, y.simhash)) as d
      from c x join c y on x.block = y.block and x.id < y.id where len(x.k) >= 4 and len(y.k) >= 4) select a, b, round(least(j, 1 - d / 64.0), 6) as similarity from p where j >= 0.6 and d <= 16"""),
    "dedup_greedy_resolution": (dedup_greedy_resolution, f"with recursive {_CAND}, {_PAIRS}, edge as (select a, b, false as x, s from near), {_GREEDY} select c.id, {_TOLD.format('c')}"),
    "dedup_index_batches": (dedup_index_batches, f"""with recursive {_CAND}, {_PAIRS}, r as (select doc_id as id, lang as block, list_sort({_keep_first(_SET)}) as k, nullif({_norm('text')}, '') as body from documents),
      same as (select x.id as a, y.id as b, true as x, 1.0::double as s from r x join r y on x.body = y.body and x.id < y.id),
      like_ as (select x.id as a, y.id as b, 1.0::double as s from r x join r y on x.block is not distinct from y.block and x.k = y.k and x.id < y.id where len(x.k) >= 4
        union all select least(x.id, y.id), greatest(x.id, y.id), s from near join r x on x.block is not distinct from near.block and x.k = ka join r y on y.block is not distinct from near.block and y.k = kb),
      edge as (select * from same union all select a, b, false, s from like_), {_GREEDY} select r.id, {_TOLD.format('r')}"""),
    "router_classify": (router_classify, _router_sql()),
    "router_directions": (router_directions, _router_sql(routing.SIGNALS, _DIRECTIONS_SQL)),
    "term_match_events": (term_match_events, r"""with d as (select conv_id, turn, text, lower(text) as l, ' ' || regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g') || ' ' as w from conversations),
      c as (select *, list_filter(['er', 'un'], lambda x: contains(l, x)) as ctx from d),
      h as (select *, list_filter(['Ouwhea', 'tion'], lambda x: case when x = 'Ouwhea' then contains(text, x) else contains(l, x) end) || list_filter(['of the', 'and'], lambda x: case when x = 'of the' then contains(l, x) else contains(w, ' ' || x || ' ') and len(ctx) > 0 end) as hits from c)
      select conv_id, turn, case when len(hits) > 0 then array_to_string(hits || ctx, '|') else '' end as terms from h"""),
    "query_terms": (query_terms, "select conv_id, turn, array_to_string(list_filter(['then', 'tion', 'under', 'que', 'les', 'edthe'], lambda x: contains(lower(text), x)), '|') as terms from conversations"),
    "tfidf_top_terms": (tfidf_top_terms, f"with src as (select 'all' as g, item_id as d, text as t from benchmark), {_tf(_WORDS, '(1 + ln(tf))')} select term, round(sum(w), 6) as weight, max(df) as df from v group by term"),
    "lexical_medoid": (lexical_medoid, f"""with src as (select source as g, doc_id as d, {_TITLE} as t from documents), {_tf(_WORDS[:-1] + f"[{_WORDS[1:-2]}-]*" + _WORDS[:-1], 'tf')},
      tot as (select g, term, sum(w) as s from v group by all), m as (select v.g, v.d, round(sum(w * s) / max(n), 6) as mean from v join tot on v.g = tot.g and v.term = tot.term group by all)
      select g as source, d as doc_id from m qualify row_number() over (partition by g order by mean desc, d) = 1"""),
    "sample_gate_counts": (sample_gate_counts, f"""with cases as (select 'src' || item_id as g, text as a from benchmark), samples as (select source as g, doc_id as d, text as t from documents where source in (select g from cases)),
      src as (select * from samples union all select g, -1, a from cases), {_tf(f"[{_WORDS[1:-2]}-]" + "{2,}", '(1 + ln(tf))')},
      cos as (select x.g, x.d, sum(x.w * y.w) as c from v x join v y on x.g = y.g and x.term = y.term and y.d = -1 where x.d <> -1 group by all),
      k as (select g, d, list_distinct(list_filter([trim(x, '-') for x in regexp_extract_all(lower(t), '[{_WORDS[1:-2]}-]+')], lambda x: length(x) >= 3)) as k from src),
      s as (select a.g, a.d, coalesce(c, 0) as c, len(list_intersect(b.k, a.k)) / len(b.k)::double as cov from k a join k b on a.g = b.g and b.d = -1 left join cos on cos.g = a.g and cos.d = a.d where a.d <> -1),
      n as (select g as case_id, count(*) as samples, count(*) filter (c >= 0.05 and cov >= 0.2) as matched, round(avg(c), 5) as cosine, round(avg(cov), 5) as coverage from s group by g)
      select *, (case when matched = 0 then 0 when matched = 1 then 1 else least(samples * 7, greatest(matched, round_even(samples * 7 * (matched / samples::double), 0)::bigint)) end)::bigint as estimated from n"""),
    "estimate_rules": (estimate_rules, """with r as (select o_orderkey, o_custkey % 40 as raw, o_orderkey % 11 + 1 as samples, (o_orderkey // 11) % (o_orderkey % 11 + 2) as matched from orders)
      select *, (case when matched = 0 then 0 when raw <= samples then least(raw, matched) when matched = 1 then 1 else least(raw, greatest(matched, round_even(raw * (matched / samples::double), 0)::bigint)) end)::bigint as estimated from r"""),
    "event_local_gate": (event_local_gate, f"select o_orderkey as id, family, status, reason, replace(span, '#K', '#' || o_orderkey) as evidence_span from orders join (values {_VERDICTS}) v(i, family, status, reason, span) on o_orderkey % {len(_KINDS)} = i"),
    "confusion_by_split": (confusion_by_split, f"""with d as (select lang, quality = 1 as e, {_RULE} as p from documents join labels using (doc_id)), c as (select lang, count(*) filter (e and p) as tp, count(*) filter (not e and p) as fp, count(*) filter (e and not p) as fn, count(*) filter (not e and not p) as tn from d group by lang)
      select *, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall, round(fp / nullif(fp + tn, 0)::double, 6) as fpr from c"""),
    "threshold_select": (threshold_select, """with s as (select quality = 1 as e, round(len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' '))::double, 4) as score from documents join labels using (doc_id)),
      t as (select i / 20.0::double as threshold, count(*) filter (not e and score >= i / 20.0::double) as fp, count(*) filter (e and score >= i / 20.0::double) / count(*) filter (e)::double as recall from s, range(1, 20) r(i) group by i) select max(threshold) as threshold from t where fp <= 40 and recall >= 0.05"""),
}
