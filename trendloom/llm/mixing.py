"""Mixing sources to target weights.

Each row gets a hash-random key. Word counts are summed by source and key range first; prefix sums over those
ranges show in which range a source's budget ends, and only the rows of that range are sorted. What a row
gives then follows from its key and its source's cut, without a shuffle of rows. Budgets above a source's
size repeat whole epochs.

Defined results: a null text has no words; a null source is a source of its own, last in order; a source
without words has target 0; rows with equal doc_id share a key, and where the cut falls on them each gives the
same number of words; an empty table gives no rows; other columns are kept by
``mix``, but for those named like its own, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import WORD, materialize, set_aside

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Rows that a key range holds about, and sources up to which their table is broadcast (under 10 MB).
RANGE_ROWS, BROADCAST_SOURCES = 20_000, 50_000
_KEY_BITS = 60


#: Columns that ``mix`` has meanwhile.
_OWN = ("key_", "epochs_", "rest_", "cut_", "part_words_", "source_", "deal_", "part_")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column) -> Column:
    """60 bits of md5 over the id, as a long: the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _join_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """rows with their source's columns: the sources are broadcast while they are few; beyond it they are
    repeated 32 times and joined with rows that are dealt over the repeats, so that no source is a hot spot."""
    if few:
        return rows.join(F.broadcast(sources), rows.source.eqNullSafe(sources.source_)).drop("source_")
    parts = sources.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(31))))
    dealt = rows.withColumn("deal_", F.pmod(F.col("key_"), F.lit(32)).cast("int"))
    return dealt.join(parts, dealt.source.eqNullSafe(parts.source_) & (dealt.deal_ == parts.part_)).drop("source_", "deal_", "part_")


def _ordered(sources: DataFrame) -> DataFrame:
    """sources with rank_ from 0 in order of source, nulls last; ranges are numbered on their own."""
    dealt = sources.repartitionByRange(8, F.col("source_").asc_nulls_last()).withColumn("pid_", F.spark_partition_id())
    dealt = materialize(dealt, "sources")
    before = Window.orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("pid_").count().select("pid_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base_"))
    own = F.row_number().over(Window.partitionBy("pid_").orderBy(F.col("source_").asc_nulls_last()))
    return dealt.withColumn("row_", own).join(sizes, "pid_").withColumn("rank_", F.col("row_") + F.col("base_") - 1).drop("pid_", "row_", "base_")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source_, source_size) with target: share times all sizes, dealt by weight; no source gets more
    than most times its size, and what is above goes to the others by weight until none is above."""
    if share > most:
        raise ValueError("share can't exceed most")
    ordered = _ordered(sources)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank_") % len(weights) + 1).cast("int"))
    table = materialize(ordered.select("source_", "source_size", weight.alias("weight_"), (F.col("source_size") * most).alias("cap_")), "weights")
    level = None
    while True:
        held = F.lit(False) if level is None else F.col("cap_") <= F.col("weight_") * level
        total, full, free = table.agg(F.sum("source_size"), F.sum(F.when(held, F.col("cap_")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight_")))).first()
        if not free:
            level = level or 0.0
            return table.select("source_", "source_size", F.least("cap_", F.lit(float("inf") if total else 0.0)).alias("target"))
        now = (total * share - full) / free
        if now == level:
            return table.select("source_", "source_size", F.least("cap_", F.col("weight_") * level).alias("target"))
        level = now


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """df (doc_id, text, source, ...) with size, source_size, target and taken, which replace columns of these
    names; other columns are kept whatever their names."""
    df, back = set_aside(df.drop("size", "source_size", "target", "taken"), _OWN)
    sized = df.withColumns({"size": words(F.col("text")), "key_": mix_key(F.col("doc_id"))})
    small = materialize(sized.select("source", "size", "key_"), "sizes")
    n = small.count()
    bits = max(8, (n // RANGE_ROWS).bit_length())
    in_range = F.shiftright("key_", _KEY_BITS - bits)
    sums = materialize(small.groupBy(F.col("source").alias("source_"), in_range.alias("range_")).agg(F.sum("size").alias("words_")), "ranges")
    table = targets(sums.groupBy("source_").agg(F.sum("words_").alias("source_size")), weights, share, most)
    budget = F.rint("target").cast("long")
    some = F.col("source_size") > 0
    table = table.withColumns({"epochs_": F.when(some, F.floor(budget / F.when(some, F.col("source_size")))).otherwise(0), "rest_": F.when(some, budget % F.when(some, F.col("source_size"))).otherwise(F.lit(0))})
    table = materialize(table, "targets")
    few = table.count() <= BROADCAST_SOURCES
    # the range in which the rest ends, by prefix sums over ranges
    upto = F.sum("words_").over(Window.partitionBy("source_").orderBy("range_").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto_", upto).withColumnRenamed("source_", "source")
    ends = _join_sources(ends.withColumn("key_", F.col("range_")), table.select("source_", "rest_"), few).drop("key_")
    ends = ends.where("rest_ > upto_ - words_ and rest_ <= upto_").select(F.col("source").alias("source_"), F.col("range_").alias("end_"), (F.col("rest_") - F.col("upto_") + F.col("words_")).alias("need_"))
    # the key at which it ends, by prefix sums over that range's rows
    near = _join_sources(small, ends, few).where(in_range == F.col("end_"))
    own = near.groupBy("source", "key_", "need_").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("ties_"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key_").rowsBetween(Window.unboundedPreceding, 0))
    cut = own.withColumn("upto_", upto).where("need_ > upto_ - size and need_ <= upto_")
    cut = cut.select(F.col("source").alias("at_"), F.col("key_").alias("cut_"), F.floor((F.col("need_") - F.col("upto_") + F.col("size")) / F.col("ties_")).alias("part_words_"))
    table = materialize(table.join(cut, F.col("source_").eqNullSafe(F.col("at_")), "left").drop("at_"), "cuts")
    whole = _join_sources(sized, table, few)
    last = F.when(F.col("key_") < F.col("cut_"), F.col("size")).when(F.col("key_") == F.col("cut_"), F.least("size", "part_words_")).otherwise(0)
    taken = (F.col("epochs_") * F.col("size") + last).cast("long")
    return whole.withColumn("taken", taken).drop("key_", "epochs_", "rest_", "cut_", "part_words_").withColumnsRenamed(back)


def copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as rows with the given columns: a row for each whole copy of a text, and one with its first
    words where the last copy isn't whole. Rows of which nothing is taken go; n_chars follows the text."""
    size = F.greatest("size", F.lit(1))
    n = F.ceil(F.col("taken") / size)
    out = mixed.where("taken > 0").withColumn("nth_", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    rest = (F.col("taken") - (F.col("nth_") - 1) * F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), rest), " ")
    out = out.withColumn("text", F.when(rest < F.col("size"), cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(mixed.schema["n_chars"].dataType))
    return out.select(*columns)


def mix_sql(steps: int = 12) -> str:
    """DuckDB's SQL for the mix of all documents; the level rises in the given number of steps at most."""
    levels = "".join(
        f", level{i + 1} as (select case when sum(case when cap > weight * l then weight else 0 end) = 0 then any_value(l) else (any_value(total) * {SHARE}::double - sum(case when cap <= weight * l then cap else 0 end)) / sum(case when cap > weight * l then weight else 0 end) end as l from weighted, level{i})"
        for i in range(steps)
    )
    return rf"""
with sized as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size,
    ('0x' || substr(md5('mix:' || doc_id::varchar), 1, 15))::bigint as k from documents),
sources as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as r from sized group by source),
weighted as (select source, source_size, case r when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 2.0::double as cap, sum(source_size) over ()::double as total from sources),
level0 as (select any_value(total) * {SHARE}::double / sum(weight) as l from weighted){levels},
aimed as (select source, source_size, least(cap, weight * l) as target from weighted, level{steps}),
budget as (select *, round_even(target, 0)::bigint as b from aimed),
ran as (select s.doc_id, s.size, b.source_size, b.target, case when b.source_size > 0 then b.b // b.source_size else 0 end as epochs,
    case when b.source_size > 0 then b.b % b.source_size else 0 end as rest,
    coalesce(sum(s.size) over (partition by s.source order by s.k rows between unbounded preceding and 1 preceding), 0) as before
    from sized s join budget b on s.source is not distinct from b.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from ran"""
