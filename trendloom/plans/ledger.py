"""Queries over stores, collection, history windows, lineage and event streams."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators import ancestry, backfill, bridge, ingest, lineage, state, timeline, windows
from trendloom.plans.evidence import AS_OF, EVIDENCE_SQL, evidence, read
from trendloom.sources import contract, projections, specs, store
from trendloom.sources.shared import materialize, shared_root
from trendloom.streaming import keyed


def _texts(df, *dates):
    """df with dates as text, which both engines write alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in dates})


def _batches(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    old = e.where("event_id % 3 <> 0").select("event_id", "event_type", "value", "ts")
    new = e.where("event_id % 3 = 0 or event_id % 5 = 0").select("event_id", "event_type", (F.col("value") + 1).alias("value"), "ts")
    return old, new


def observation_upsert_stats(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return store.upsert_stats(old, new, "event_id")


def observation_upsert(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return store.upsert(old, new, "event_id").select("event_id", "event_type", F.round("value", 4).alias("value"))


def observations_list(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnsRenamed({"event_id": "observation_id", "ts": "observed_at", "event_type": "technology_direction"})
    return store.list_observations(e, "click", 100).select("observation_id", "observed_at")


def state_new_ids(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    known = e.where("event_id % 2 = 0").select(F.col("user_id").alias("trend_id"), F.col("event_id").alias("observation_id"))
    return state.new_members(e.where("event_id % 3 = 0").select(F.col("user_id").alias("trend_id"), F.col("event_id").alias("observation_id")), known)


_CUT = "1996-07-01"


def state_ingest_replay(spark, sf_dir):
    """Orders as observations, customers as clusters: the early orders, then all of them, then the early ones again,
    which must change nothing."""
    o = read(spark, sf_dir, "orders")
    seen = o.select(
        F.col("o_orderkey").cast("string").alias("observation_id"), F.col("o_orderpriority").alias("evidence_type"), F.col("o_orderstatus").alias("provider"), F.lit("order").alias("artifact_kind"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"), F.concat(F.lit("month:"), scalars.month_key(F.col("o_orderdate"))).alias("unit_key"), (F.col("o_orderstatus") == "F").alias("verified"),
        F.array(F.col("o_orderstatus")).alias("actors"), F.concat(F.lit("c"), "o_custkey").alias("cluster_id"),
    )
    kept, now = ingest.empty(spark), F.to_timestamp(F.lit("2024-01-01"))
    for rows in (seen.where(F.col("event_time") < _CUT), seen, seen.where(F.col("event_time") < _CUT)):
        c = rows.groupBy("cluster_id").agg(F.collect_list("observation_id").alias("member_ids"), F.min("event_time").alias("first_seen"))
        c = c.select("cluster_id", F.lit("mixed").alias("profile"), F.col("cluster_id").alias("direction_key"), F.lit("none").alias("model"), "member_ids", F.array(F.lit(1.0), F.lit(0.0)).alias("centroid"), "first_seen")
        kept, _ = ingest.ingest(kept, c, rows.drop("cluster_id"), now)
    urgent = kept.counters.where("kind = 'evidence' and name = '1-URGENT'").select("trend_id", F.col("n").alias("urgent"), F.col("first_at").cast("date").cast("string").alias("first_urgent"))
    found = kept.units.groupBy("trend_id").agg(F.count(F.lit(1)).alias("units"), F.count_if("verified").alias("verified_units"))
    t = kept.trends.join(urgent, "trend_id", "left").join(found, "trend_id", "left")
    return t.select("direction_key", "observation_count", F.col("first_seen").cast("date").cast("string").alias("first_seen"), F.col("last_seen").cast("date").cast("string").alias("last_seen"), "update_count", F.coalesce("urgent", F.lit(0)).alias("urgent"), "first_urgent", "units", "verified_units")


def state_ingest_overlapping(spark, sf_dir):
    """Customers as trends in a store of deltas: their first orders, then clusters by priority, all of which hold the
    customer's first two orders, then the same again."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w))
    seen = o.select(
        F.col("o_orderkey").cast("string").alias("observation_id"), F.col("o_orderpriority").alias("evidence_type"), F.col("o_orderstatus").alias("provider"), F.lit("order").alias("artifact_kind"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"), F.col("o_orderkey").cast("string").alias("unit_key"), (F.col("o_orderstatus") == "F").alias("verified"), F.array().cast("array<string>").alias("actors"),
        "o_custkey", "n",
    )
    seen = materialize(seen, "observations")
    firsts = seen.where("n <= 2").groupBy("o_custkey").agg(F.collect_list("observation_id").alias("shared"))
    own = seen.where("n > 1").groupBy("o_custkey", "evidence_type").agg(F.collect_list("observation_id").alias("own"), F.min("event_time").alias("first_seen"))
    one = seen.where("n = 1").select(F.concat(F.lit("c"), "o_custkey").alias("cluster_id"), "o_custkey", F.array("observation_id").alias("member_ids"), F.col("event_time").alias("first_seen"))
    more = own.join(firsts, "o_custkey").select(F.concat_ws("-", F.concat(F.lit("c"), "o_custkey"), "evidence_type").alias("cluster_id"), "o_custkey", F.array_union("own", "shared").alias("member_ids"), "first_seen")
    full = lambda c: c.select("cluster_id", F.lit("mixed").alias("profile"), F.concat(F.lit("c"), "o_custkey").alias("direction_key"), F.lit("none").alias("model"), "member_ids", F.array(F.lit(1.0), F.lit(0.0)).alias("centroid"), "first_seen")
    kept = ingest.DeltaStore(spark, f"{shared_root(spark)}/trendloom/store-{uuid.uuid4().hex}")
    for batch, rows in enumerate((one, more, more)):
        kept.ingest(batch, full(rows), seen, F.to_timestamp(F.lit("2024-01-01")))
    store_ = kept.store()
    counted = store_.counters.where("kind = 'evidence'").groupBy("trend_id").agg(F.sum("n").alias("counted"), F.count(F.lit(1)).alias("priorities"))
    t = store_.trends.join(counted, "trend_id").join(store_.units.groupBy("trend_id").agg(F.count(F.lit(1)).alias("units")), "trend_id")
    return t.select("direction_key", "observation_count", "counted", "priorities", "units", "update_count", F.col("last_seen").cast("date").cast("string").alias("last_seen"))


def collection_resume_pages(spark, sf_dir):
    """Pages of 100 events, with the batch id that a rerun would give them again."""
    e = read(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("page"))
    pages = e.groupBy("page").agg(F.count(F.lit(1)).alias("records"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return pages.select("*", store.batch_id(F.lit("events"), F.lit("all"), F.concat(F.lit('{"page":'), F.col("page").cast("string"), F.lit("}"))).alias("batch_id"))


#: What an order is to look like.
_ORDER = {
    "type": "object", "additionalProperties": False, "required": ["id", "status", "placed_at", "price"],
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "status": {"enum": ["F", "O"]}, "placed_at": {"type": "string", "format": "date"}, "price": {"type": ["number", "null"], "minimum": 1000},
        "tags": {"type": "array", "items": {"type": "string", "minLength": 2}},
    },
}


def contract_violations(spark, sf_dir):
    """Orders as documents, some of which lack a field, have one too many, or a value of another type."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    part = lambda name, x: F.concat(F.lit(f'"{name}":'), x)
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    fields = F.array(
        part("id", F.when(k % 11 == 0, quoted(k.cast("string"))).otherwise(k.cast("string"))), part("status", quoted(F.col("o_orderstatus"))), F.when(k % 13 != 0, part("placed_at", quoted(F.date_format("o_orderdate", "yyyy-MM-dd")))),
        part("price", F.when(k % 17 == 0, F.lit("null")).otherwise(F.floor("o_totalprice").cast("string"))), F.when(k % 19 == 0, part("extra", F.lit("{}"))),
        part("tags", F.concat(F.lit('["ok",'), F.when(k % 23 == 0, F.lit('"x"')).when(k % 29 == 0, F.lit("1")).otherwise(F.lit('"yes"')), F.lit("]"))),
    )
    doc = F.concat(F.lit("{"), F.array_join(F.array_compact(fields), ","), F.lit("}"))
    found = contract.broken(o.select(k.alias("id"), doc.alias("doc")), "doc", _ORDER)
    return found.select("id", F.array_join("violations", "; ").alias("violations"))


def upsert_from_json_props(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("most"))


def backfill_windows(spark, sf_dir):
    first = evidence(spark, sf_dir).groupBy("trend_id", "profile").agg(F.min("event_time").alias("first_seen"))
    return _texts(backfill.windows(first, AS_OF), "start", "end")


def _daily(spark, sf_dir):
    """A curve of days for each type and user, which are rare enough for gaps."""
    e = read(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("case_id"), F.to_date("ts").alias("period"))
    days = e.select("case_id").distinct().select("case_id", F.explode(F.sequence(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 30)))).alias("period"))
    n = e.groupBy("case_id", "period").agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, ["case_id", "period"], "left").select("case_id", "period", F.coalesce("n", F.lit(0)).alias("n"))


def first_sustained_period(spark, sf_dir):
    return _texts(timeline.sustained(_daily(spark, sf_dir)), "first_active", "first_sustained")


def prefix_timeline(spark, sf_dir):
    return _texts(timeline.prefix_sustained(_daily(spark, sf_dir)), "period", "first_sustained")


def first_useful_signal(spark, sf_dir):
    """First day on which a sustained case has ten events or more, and its lead on the end of the month."""
    t = timeline.prefix_sustained(_daily(spark, sf_dir)).where("first_sustained is not null and running >= 10")
    return t.groupBy("case_id").agg(F.min("period").alias("useful")).select("case_id", F.col("useful").cast("string").alias("useful"), F.datediff(F.lit(date(2024, 1, 31)), F.col("useful")).cast("long").alias("lead_days"), (F.datediff(F.lit(date(2024, 1, 31)), F.col("useful")) >= 3).alias("target_met"))


def pre_origin_counts(spark, sf_dir):
    curve = _daily(spark, sf_dir).withColumns({"start": F.col("period"), "end": F.date_add("period", 2)})
    return timeline.before_origin(curve, F.lit(date(2024, 1, 10)))


def calendar_months(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return o.select("o_orderpriority", F.explode(timeline.calendar_windows(F.col("a"), F.col("b"))).alias("w")).select("o_orderpriority", "w.period", F.col("w.start").cast("string").alias("start"), F.col("w.end").cast("string").alias("end"))


def case_windows(spark, sf_dir):
    """Orders within the quarter-long windows of their own customer, which start with each of its urgent orders."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    first = F.to_date("o_orderdate")
    own = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", first.alias("start"), F.date_add(F.add_months(first, 3), -1).alias("end")).distinct()
    return _texts(windows.counted(o, own, "o_custkey", "o_orderdate", days=92), "start", "end")


def stream_trend_months(spark, sf_dir):
    """Events as a stream of four files, the first of which comes again as the last: months by type and user."""
    e = materialize(read(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", "user_id").alias("trend_id"), F.col("event_id").cast("string").alias("observation_id"), F.col("ts").cast("timestamp").alias("event_time"), (F.col("event_id") % 3).alias("part")), "events")
    root = f"{shared_root(spark)}/trendloom/stream-{uuid.uuid4().hex}"
    for part in (0, 1, 2, 0):
        e.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    keyed.count_months(spark.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), f"{root}/state", f"{root}/checkpoint")
    m = keyed.months(spark, f"{root}/state")
    return m.select("trend_id", "period", "n", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


def month_arithmetic(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    d = F.col("o_orderdate")
    return o.select("o_orderkey", scalars.month_key(d).alias("month"), scalars.shift_month(d, -7).cast("string").alias("back"), scalars.month_distance(F.lit(AS_OF), d).cast("long").alias("distance"))


def stable_ids(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("m"))
    return o.select("o_custkey", scalars.cluster_id(F.lit("mixed"), F.col("m")).alias("cluster_id"))


def abstract_rebuild(spark, sf_dir):
    """Conversations as inverted indexes, and back."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word"))
    index = c.groupBy("conv_id", "turn", "word").agg(F.sort_array(F.collect_list("pos")).alias("at")).groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("idx"))
    return index.select("conv_id", "turn", projections.abstract(F.col("idx")).alias("abstract"))


def actors_capped(spark, sf_dir):
    """The first 20 suppliers of each part's lines, in order, and how many there are."""
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    first = line.groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("at"))
    each = first.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("at", "l_suppkey"))).alias("all"))
    return each.select("l_partkey", F.array_join(F.transform(F.slice("all", 1, 20), lambda x: x["l_suppkey"].cast("string")), ",").alias("actors"), F.size("all").cast("long").alias("total"), (F.size("all") > 20).alias("truncated"))


def top_labels(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return backfill.top_labels(line.select(F.col("l_suppkey").alias("s"), F.array("p_brand").alias("labels"), F.col("l_orderkey").alias("seq")), "s", "labels").select("s", F.col("place").cast("long").alias("place"), "label", "n")


def _graph(spark, sf_dir):
    """A commit graph over orders: customers are repositories, a commit's parent is the customer's order before
    it, and every seventh commit is on a branch of its own."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderkey").alias("k"))
    p = o.withColumn("pk", F.lag("k").over(Window.partitionBy("repo").orderBy("k"))).where("pk is not null and k % 7 <> 0")
    return o, p.select("repo", "sha", F.col("pk").cast("string").alias("parent_sha"))


def ancestor_closure(spark, sf_dir):
    o, parents = _graph(spark, sf_dir)
    return lineage.descendants(parents, o.where("k % 11 = 0").select("repo", "sha")).select("repo", "anchor_sha", "sha", F.col("depth").cast("long").alias("depth"))


def _dag(spark, sf_dir):
    """A commit graph with branches and merges over orders: a commit's first parent is the customer's order before it (every
    seventh: the one before that), and every fifth merges the third before it."""
    w = Window.partitionBy("repo").orderBy("k")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").alias("k"))
    o = o.withColumns({"one": F.lag("k", 1).over(w), "two": F.lag("k", 2).over(w), "three": F.lag("k", 3).over(w)})
    ends = F.array(F.struct(F.lit(0).alias("nth"), F.when(F.col("k") % 7 == 0, F.col("two")).otherwise(F.col("one")).alias("p")), F.struct(F.lit(1).alias("nth"), F.when(F.col("k") % 5 == 0, F.col("three")).alias("p")))
    return o.select("repo", F.col("k").cast("string").alias("sha"), F.explode(ends).alias("e")).select("repo", "sha", F.col("e.p").cast("string").alias("parent_sha"), "e.nth")


def ancestor_pairs(spark, sf_dir):
    """Each order against the customer's next, second, fifth and ninth after it: is it an ancestor of it?"""
    parents = materialize(_dag(spark, sf_dir), "parents")
    w = Window.partitionBy("repo").orderBy("k")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").alias("k"))
    later = o.withColumn("later", F.array(*(F.lead("k", n).over(w) for n in (1, 2, 5, 9))))
    pairs = later.select("repo", F.col("k").cast("string").alias("up"), F.explode("later").alias("d")).where("d is not null").select("repo", "up", F.col("d").cast("string").alias("down"))
    return ancestry.ahead(pairs, ancestry.labels(parents))


def rename_traces(spark, sf_dir):
    """A module of each customer's first order, followed through renames to the ninth: an order of even number renames the
    module by its number's last digit but one, at most three hops, four commits a page and six look-ups."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").alias("k"))
    w = Window.partitionBy("repo").orderBy("k")
    path = lambda n: F.concat(F.lit("m"), n.cast("string"), F.lit(".py"))
    own, old = path(F.floor(F.col("k") / 10) % 3), path(F.col("k") % 3)
    moved = (F.col("k") % 2 == 0) & (own != old)
    files = o.select("repo", F.col("k").cast("string").alias("sha"), F.col("k").alias("committed_at"), own.alias("filename"), F.when(moved, old).alias("previous_filename"), F.when(moved, "renamed").otherwise("modified").alias("status"))
    first = o.withColumns({"n": F.row_number().over(w), "last": F.lead("k", 8).over(w)}).where("n = 1 and last is not null")
    cases = first.select(F.col("repo").alias("case_id"), "repo", F.col("k").cast("string").alias("anchor_sha"), F.col("last").cast("string").alias("candidate_sha"), F.col("k").alias("anchor_at"), F.col("last").alias("candidate_at"), F.array(F.lit("m0.py")).alias("paths"), F.lit(None).cast("array<string>").alias("candidate_paths"))
    found = ancestry.trace_renames(cases, files, ancestry.labels(materialize(_dag(spark, sf_dir), "parents")), max_hops=3, max_history=4, max_details=6)
    return found.select("case_id", F.array_join("paths", ",").alias("paths"), F.array_join(F.transform("steps", lambda s: s["sha"]), ",").alias("steps"), "complete", "reason")


def _chains(spark, sf_dir):
    """Orders of a customer in chains: a chain starts with the customer's first order and with every seventh number."""
    _, parents = _graph(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").alias("k"))
    heads = materialize(o.withColumn("first", F.min("k").over(Window.partitionBy("repo"))).where("k = first or k % 7 = 0").select("repo", F.col("k").cast("string").alias("sha")), "heads")
    ends = Window.partitionBy("repo").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    marked = o.join(heads.select("repo", F.col("sha").cast("long").alias("k"), F.col("sha").alias("head")), ["repo", "k"], "left")
    return marked.withColumn("head", F.last("head", ignorenulls=True).over(ends)), parents


def rename_chain(spark, sf_dir):
    """A module of each chain's first order, followed through renames to its last."""
    o, parents = _chains(spark, sf_dir)
    path = lambda n: F.concat(F.lit("m"), n.cast("string"), F.lit(".py"))
    own, old = path(F.floor(F.col("k") / 10) % 3), path(F.col("k") % 3)
    moved = (F.col("k") % 2 == 0) & (own != old)
    files = o.select("repo", F.col("k").cast("string").alias("sha"), F.col("k").alias("committed_at"), own.alias("filename"), F.when(moved, old).alias("previous_filename"), F.when(moved, "renamed").otherwise("modified").alias("status"))
    cases = o.groupBy("repo", "head").agg(F.max("k").alias("candidate_at"))
    starts = cases.select(F.col("head").alias("case_id"), "repo", F.col("head").alias("anchor_sha"), F.col("head").cast("long").alias("anchor_at"), F.col("candidate_at").cast("string").alias("candidate_sha"), "candidate_at", F.lit("m0.py").alias("path"))
    return lineage.rename_chain(starts, files, ancestry.labels(parents)).select("case_id", "path", F.col("hops").cast("long").alias("hops"), "reason")


#: Anchors' patches by number, and the file that a commit changes; modules in Java aren't followed, nor are docs.
_DIFFS = ("FILE peft/lora.py\n+class LoraConfig:", "FILE peft/Lora.java\n+class LoraConfig:\nFILE peft/other.py\n+x", "FILE docs/lora.py\n+class LoraConfig:", None)
_FILES = ("peft/lora.py", "peft/Lora.java", "docs/lora.md", "peft/other.py", None)


def lineage_verdicts(spark, sf_dir):
    """Each order as a candidate, against the customer's order two before it, itself, one of another repository, and so on by
    its number."""
    o, parents = _chains(spark, sf_dir)
    o = o.withColumn("before", F.lag("k", 2).over(Window.partitionBy("repo").orderBy("k")))
    k, text_ = F.col("k"), F.col("k").cast("string")
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), at.cast("int") + 1)
    files = o.select("repo", text_.alias("sha"), pick(_FILES, k % 5).alias("filename"), F.lit(None).cast("string").alias("previous_filename"), F.lit("modified").alias("status"), F.lit("+class LoraLayer:\n+    pass").alias("patch")).where("filename is not null")
    kind = lambda n: F.when(k % n == 0, "release").otherwise("commit")
    cases = o.where("before is not null").select(
        k.alias("case_id"), F.lit("Low-rank adaptation for language models").alias("technology_direction"), F.when(k % 17 == 0, "other").otherwise(F.col("repo")).alias("anchor_repo"), F.when(k % 19 == 0, k).otherwise(F.col("before")).cast("string").alias("anchor_sha"),
        F.when(k % 23 == 0, k).otherwise(F.col("before")).alias("anchor_at"), kind(29).alias("anchor_kind"), F.when(k % 31 == 0, "Update docs").otherwise("Add LoRA fine-tuning for LLM adapters").alias("anchor_title"), F.lit(None).cast("string").alias("anchor_text"),
        F.when(k % 31 == 0, "FILE src/a.py\n+x").otherwise(pick(_DIFFS, k % 4)).alias("anchor_diff"), "repo", text_.alias("sha"), k.alias("at"), kind(37).alias("kind"),
    )
    return lineage.verdicts(cases, files, ancestry.labels(parents))


def bridge_events(spark, sf_dir):
    """Order lines as dated events of repositories (the supplier's nation) of a trend."""
    e = evidence(spark, sf_dir).select("trend_id", F.col("unit_key").alias("repository"), "observation_id", F.col("event_time").alias("published_at"), F.col("verified").alias("eligible"), F.to_timestamp(F.lit("2030-01-01")).alias("observed_at"))
    return bridge.labelled(e).groupBy("trend_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("first"))


def monthly_samples(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return specs.monthly_samples(o, "o_orderpriority", "o_orderdate", ["o_orderdate", "o_orderkey"]).select("o_orderpriority", "period", "n", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


def events_tumbling(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def events_session(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


_DAILY = """e as (select event_type || '-' || user_id::varchar as case_id, ts::date as period from events), c as (select case_id, period, count(*) as n from e group by all),
  d as (select x.case_id, p.d::date as period, coalesce(c.n, 0) as n from (select distinct case_id from e) x cross join (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as d) p left join c on c.case_id = x.case_id and c.period = p.d::date),
  l as (select *, coalesce(lead(n, 1) over w, 0) as n1, coalesce(lead(n, 2) over w, 0) as n2 from d window w as (partition by case_id order by period)),
  t as (select a.case_id, a.period, a.n, (select min(b.period) from l b where b.case_id = a.case_id and b.n > 0 and ((b.n1 > 0 and b.period + 1 <= a.period) or (b.n2 > 0 and b.period + 2 <= a.period))) as first_sustained, (select sum(b.n) from l b where b.case_id = a.case_id and b.period <= a.period)::bigint as running from l a)"""
_UP = "o as (select event_id, event_type, value from events where event_id % 3 <> 0), n as (select event_id, event_type, value + 1 as value from events where event_id % 3 = 0 or event_id % 5 = 0)"


def _case(i: int) -> str:
    return "case profile " + " ".join(f"when '{p}' then {v[i]}" for p, v in backfill.POLICIES.items()) + " end"


_DAG = """o as (select o_custkey::varchar as repo, o_orderkey as k, row_number() over w as n, lag(o_orderkey, 1) over w as one, lag(o_orderkey, 2) over w as two, lag(o_orderkey, 3) over w as three, lead(o_orderkey, 8) over w as last from orders window w as (partition by o_custkey order by o_orderkey)),
  edge as (select repo, k, case when k % 7 = 0 then two else one end as p from o union all select repo, k, three from o where k % 5 = 0),
  above(repo, d, u) as (select repo, k, p from edge where p is not null union select above.repo, above.d, edge.p from above join edge on edge.repo = above.repo and edge.k = above.u where edge.p is not null)"""
# the bounded search, hop by hop: h has the state of each case after a hop; a case has one path
_TRACE = """f as (select repo, k, 'm' || (k // 10 % 3) || '.py' as own, case when k % 2 = 0 and k // 10 % 3 <> k % 3 then 'm' || (k % 3) || '.py' end as old from o),
  t as (select repo, k, own as path, own, old from f union select repo, k, old, own, old from f where old is not null),
  h(hop, repo, path, cur, last, room, steps, reason) as (select 0, repo, 'm0.py', k, last, 6::bigint, []::bigint[], null::varchar from o where n = 1 and last is not null union all
    select hop + 1, repo, coalesce(hit.own, path), coalesce(hit.k, cur), last, room - coalesce(hit.look, 0), case when hit is not null then list_append(steps, hit.k) else steps end,
      case when hit is not null then null when not short and looks > room then 'rename_budget_exhausted' when short then 'truncated_git_history' else 'no_more_verified_renames' end
    from (select h.hop, h.repo, h.path, h.cur, h.last, h.room, h.steps, count(t.k) >= 4 as short, count(t.k) filter (t.k > cur and t.k < last) as looks,
        case when count(t.k) < 4 then arg_max(struct_pack(k := t.k, own := t.own, look := t.look), t.k) filter (t.good and t.look <= room) end as hit
      from h left join (select h2.repo as r, t0.k, t0.own, t0.path as tp, row_number() over (partition by h2.repo order by case when t0.k > h2.cur and t0.k < h2.last then 0 else 1 end, t0.k desc) as look,
          t0.old = t0.path and t0.k > h2.cur and t0.k < h2.last and exists (select 1 from above a where a.repo = t0.repo and a.d = t0.k and a.u = h2.cur) and exists (select 1 from above a where a.repo = t0.repo and a.d = h2.last and a.u = t0.k) as good
          from h h2 join t t0 on t0.repo = h2.repo and t0.path = h2.path and t0.k between h2.cur and h2.last where h2.reason is null and h2.hop < 3) t on t.r = h.repo
      where h.reason is null and h.hop < 3 group by all))"""

_CHAINS = """o as (select o_custkey::varchar as repo, o_orderkey as k, max(case when o_orderkey % 7 = 0 or o_orderkey = first then o_orderkey end) over (partition by o_custkey order by o_orderkey) as head
    from (select *, min(o_orderkey) over (partition by o_custkey) as first from orders))"""

QUERIES = {
    "observation_upsert_stats": (observation_upsert_stats, f"with {_UP} select count(*) filter (event_id not in (select event_id from o)) as inserted, count(*) filter (event_id in (select event_id from o)) as updated from n"),
    "observation_upsert": (observation_upsert, f"with {_UP} select event_id, event_type, round(value, 4) as value from n union all select event_id, event_type, round(value, 4) from o where event_id not in (select event_id from n)"),
    "observations_list": (observations_list, "select event_id as observation_id, ts as observed_at from events where event_type = 'click' order by ts, event_id limit 100"),
    "state_ingest_replay": (state_ingest_replay, f"""with u as (select o_custkey, strftime(o_orderdate, '%Y-%m') as m, bool_or(o_orderstatus = 'F') as v from orders group by all), n as (select o_custkey, count(*) as units, count(*) filter (v) as verified_units from u group by all)
      select 'c' || o_custkey as direction_key, count(*) as observation_count, min(o_orderdate)::date::varchar as first_seen, max(o_orderdate)::date::varchar as last_seen,
        (min(o_orderdate) < '{_CUT}')::bigint + (max(o_orderdate) >= '{_CUT}')::bigint as update_count, count(*) filter (o_orderpriority = '1-URGENT') as urgent, (min(o_orderdate) filter (o_orderpriority = '1-URGENT'))::date::varchar as first_urgent,
        any_value(units) as units, any_value(verified_units) as verified_units from orders join n using (o_custkey) group by o_custkey"""),
    "state_ingest_overlapping": (state_ingest_overlapping, """with o as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders),
      b as (select o_custkey, case when n = 2 then min(o_orderpriority) over (partition by o_custkey) else o_orderpriority end as brings from o where n > 1), s as (select o_custkey, count(distinct brings) as steps from b group by o_custkey)
      select 'c' || o_custkey as direction_key, count(*) as observation_count, count(*) as counted, count(distinct o_orderpriority) as priorities, count(*) as units, 1 + coalesce(any_value(steps), 0) as update_count, max(o_orderdate)::date::varchar as last_seen from o left join s using (o_custkey) group by o_custkey"""),
    "state_new_ids": (state_new_ids, "select user_id as trend_id, event_id as observation_id from events where event_id % 3 = 0 and event_id % 2 <> 0"),
    "collection_resume_pages": (collection_resume_pages, """select event_id // 100 as page, count(*) as records, min(event_id) as first_id, max(event_id) as last_id, 'page-' || substr(sha256('events|all|{"page":' || (event_id // 100)::varchar || '}'), 1, 24) as batch_id from events group by event_id // 100"""),
    "contract_violations": (contract_violations, """with v as (select o_orderkey as id, list_filter([case when o_orderkey % 19 = 0 then '$.extra: additionalProperties' end, case when o_orderkey % 11 = 0 then '$.id: type' end, case when o_orderkey % 13 = 0 then '$.placed_at: required' end,
      case when o_orderkey % 17 <> 0 and floor(o_totalprice) < 1000 then '$.price: minimum' end, case when o_orderstatus not in ('F', 'O') then '$.status: enum' end,
      case when o_orderkey % 23 = 0 then '$.tags[1]: minLength' when o_orderkey % 29 = 0 then '$.tags[1]: type' end], lambda x: x is not null) as v from orders) select id, array_to_string(v, '; ') as violations from v where len(v) > 0"""),
    "upsert_from_json_props": (upsert_from_json_props, "select event_type, count(*) as n, sum((props::json ->> 'k')::int)::bigint as total, max((props::json ->> 'k')::int) as most from events group by event_type"),
    "backfill_windows": (backfill_windows, f"""with recursive {EVIDENCE_SQL}, t as (select trend_id, profile, min(event_time)::date as fs, {_case(0)} as m0, {_case(1)} as m1, {_case(2)} as m2, {_case(3)} as m3 from evidence group by trend_id, profile),
      b as (select *, (date '1997-12-01' - to_months(m0 - 1))::date as s0, (date '1997-12-01' - to_months(m2 - 1))::date as lim from t),
      w as (select trend_id, 0 as step, greatest(lim, s0) as s, date '1997-12-31' as e, fs, m1, m3, lim from b union all
        select trend_id, step + 1, greatest(lim, (s - to_months(m1))::date), s - 1, fs, m1, m3, lim from w where s > lim and fs < s + to_months(m3) and step < 12)
      select trend_id, step, s::varchar as "start", e::varchar as "end" from w"""),
    "first_sustained_period": (first_sustained_period, f"with {_DAILY} select case_id, (min(period) filter (n > 0))::varchar as first_active, (min(period) filter (n > 0 and (n1 > 0 or n2 > 0)))::varchar as first_sustained from l group by case_id"),
    "prefix_timeline": (prefix_timeline, f"with {_DAILY} select case_id, period::varchar as period, n, first_sustained::varchar as first_sustained, running from t"),
    "first_useful_signal": (first_useful_signal, f"with {_DAILY} select case_id, min(period)::varchar as useful, date_diff('day', min(period), date '2024-01-31') as lead_days, date_diff('day', min(period), date '2024-01-31') >= 3 as target_met from t where first_sustained is not null and running >= 10 group by case_id"),
    "pre_origin_counts": (pre_origin_counts, f"with {_DAILY} select case_id, sum(case when period < date '2024-01-10' then n else 0 end)::bigint as started_before, sum(case when period + 2 < date '2024-01-10' then n else 0 end)::bigint as ended_before from d group by case_id"),
    "calendar_months": (calendar_months, "with o as (select o_orderpriority, min(o_orderdate)::date as a, max(o_orderdate)::date as b from orders group by 1), m as (select *, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), interval 1 month))::date as d from o) select o_orderpriority, strftime(d, '%Y-%m') as period, greatest(d, a)::varchar as \"start\", least(last_day(d), b)::varchar as \"end\" from m"),
    "case_windows": (case_windows, "with o as (select o_custkey, o_orderdate::date as d, o_orderpriority from orders), w as (select distinct o_custkey, d as s, (d + interval 3 month - interval 1 day)::date as e from o where o_orderpriority = '1-URGENT') select w.o_custkey, s::varchar as \"start\", e::varchar as \"end\", count(*) as n from w join o on w.o_custkey = o.o_custkey and d between s and e group by all"),
    "stream_trend_months": (stream_trend_months, "select event_type || '-' || user_id as trend_id, strftime(ts, '%Y-%m') as period, count(*) as n, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from events group by all"),
    "month_arithmetic": (month_arithmetic, "select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, (date_trunc('month', o_orderdate) - interval 7 month)::date::varchar as back, greatest(0, 1997 * 12 + 11 - (year(o_orderdate) * 12 + month(o_orderdate) - 1)) as distance from orders"),
    "stable_ids": (stable_ids, "select o_custkey, 'micro:mixed:' || substr(sha256('mixed' || chr(10) || string_agg(o_orderkey::varchar, chr(10) order by o_orderkey::varchar)), 1, 16) as cluster_id from orders group by o_custkey"),
    "abstract_rebuild": (abstract_rebuild, r"select conv_id, turn, regexp_replace(trim(text, ' '), '\s+', ' ', 'g') as abstract from conversations"),
    "actors_capped": (actors_capped, "with f as (select l_partkey, l_suppkey, min(l_orderkey * 100 + l_linenumber) as k from lineitem group by all), r as (select *, row_number() over (partition by l_partkey order by k, l_suppkey) as rn from f) select l_partkey, string_agg(l_suppkey::varchar, ',' order by rn) filter (rn <= 20) as actors, count(*) as total, count(*) > 20 as truncated from r group by l_partkey"),
    "top_labels": (top_labels, "with c as (select l_suppkey as s, p_brand as label, count(*) as n, min(l_orderkey) as f from lineitem join part on l_partkey = p_partkey group by all) select s, row_number() over (partition by s order by n desc, f, label) as place, label, n from c qualify place <= 5"),
    "ancestor_closure": (ancestor_closure, """with recursive o as (select o_custkey::varchar as repo, o_orderkey as k from orders), p as (select repo, k, lag(k) over (partition by repo order by k) as pk from o), e as (select repo, k, pk from p where pk is not null and k % 7 <> 0),
      r as (select repo, k as a, k as s, 0::bigint as depth from o where k % 11 = 0 union all select r.repo, r.a, e.k, depth + 1 from r join e on e.repo = r.repo and e.pk = r.s) select repo, a::varchar as anchor_sha, s::varchar as sha, depth from r"""),
    "ancestor_pairs": (ancestor_pairs, f"with recursive {_DAG}, later as (select repo, k, unnest([lead(k, 1) over w, lead(k, 2) over w, lead(k, 5) over w, lead(k, 9) over w]) as d from o window w as (partition by repo order by k)) select repo, k::varchar as up, later.d::varchar as down from later join above using (repo) where above.d = later.d and above.u = later.k"),
    "rename_traces": (rename_traces, f"""with recursive {_DAG}, {_TRACE}, e as (select * from h qualify row_number() over (partition by repo order by hop desc) = 1)
      select repo as case_id, path as paths, array_to_string(steps, ',') as steps, reason is not null and reason = 'no_more_verified_renames' as complete, coalesce(reason, 'max_rename_hops_reached') as reason from e"""),
    "rename_chain": (rename_chain, f"""with recursive {_CHAINS}, f as (select head, k, 'm' || (k // 10 % 3) || '.py' as own, 'm' || (k % 3) || '.py' as old from o where k % 2 = 0 and k // 10 % 3 <> k % 3),
      h(hop, head, path, cur, last, hops, reason) as (select 0, head, 'm0.py', head, max(k), 0::bigint, null::varchar from o group by head union all
        select hop + 1, h.head, coalesce(arg_min(own, f.k), path), coalesce(min(f.k), cur), last, hops + (count(f.k) > 0)::bigint, case when count(f.k) = 0 then 'no_more_verified_renames' end from h left join f on f.head = h.head and f.old = h.path and f.k > h.cur and f.k < h.last where h.reason is null and hop < 3 group by hop, h.head, path, cur, last, hops)
      select head::varchar as case_id, path, hops, coalesce(reason, 'max_rename_hops_reached') as reason from h qualify row_number() over (partition by head order by hop desc) = 1"""),
    "lineage_verdicts": (lineage_verdicts, f"""with {_CHAINS}, c as (select *, lag(k, 2) over (partition by repo order by k) as before, lag(head, 2) over (partition by repo order by k) as old from o),
      r as (select k, case when k % 17 = 0 then 'cross_repository' when k % 29 = 0 or k % 37 = 0 then 'only_commit_ancestry_supported' when k % 19 = 0 then 'same_commit_is_not_supporting_activity' when k % 23 = 0 then 'candidate_not_later_than_verified_anchor'
        when k % 31 <> 0 and k % 4 in (2, 3) then 'no_verified_anchor_source_paths' when k % 31 = 0 then 'anchor_not_technology_verified' when head <> old then 'not_confirmed_descendant' when k % 5 = 4 then 'missing_immutable_candidate_files'
        when (k % 4 = 0 and k % 5 = 0) or (k % 4 = 1 and k % 5 = 3) then 'confirmed_ancestor_and_same_module_source_change' else 'no_executable_changes_to_confirmed_module' end as reason from c where before is not null)
      select k as case_id, case when reason like 'confirmed%' then 'supporting' when reason in ('no_verified_anchor_source_paths', 'anchor_not_technology_verified', 'missing_immutable_candidate_files') then 'review_required' else 'rejected' end as verdict, reason from r"""),
    "bridge_events": (bridge_events, f"with {EVIDENCE_SQL}, r as (select *, row_number() over (partition by trend_id, unit_key, verified order by event_time, observation_id) as rn from evidence) select trend_id, case when not verified then 'rejected' when rn = 1 then 'accepted' else 'later_supporting' end as label, count(*) as n, min(event_time) as first from r group by all"),
    "monthly_samples": (monthly_samples, "with r as (select *, strftime(o_orderdate, '%Y-%m') as period, row_number() over (partition by o_orderpriority, strftime(o_orderdate, '%Y-%m') order by o_orderdate, o_orderkey) as rn from orders) select o_orderpriority, period, count(*) as n, string_agg(o_orderkey::varchar, ',' order by rn) filter (rn <= 15) as samples from r group by all"),
    "events_tumbling": (events_tumbling, "select time_bucket(interval 6 hours, ts, timestamp '2024-01-01') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all"),
    "events_session": (events_session, "with l as (select user_id, ts, case when ts - lag(ts) over w < interval 2 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from l) select user_id, min(ts) as start, count(*) as n from s group by user_id, sid"),
}
