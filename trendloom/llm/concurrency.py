"""Peak concurrency: how many intervals are open at each moment, and when that is most.

Times are whole units (minutes, say) in a range of 2^33. An interval is cut into dyadic nodes: the node (level, i) covers
the units [i * 2^level, (i + 1) * 2^level), and at most two nodes of each level make up an interval. Equal intervals are
counted before they are cut, and nodes are summed by key before they meet anything. What is open at a moment is the
sum over the nodes that contain it, one of each level, found by equi-join in tiers of ten levels: the sums of a
tier's blocks become one more node of the tier below. Running maxima and next moments are taken within blocks of
1,024 units, then over blocks of blocks, and handed down again. So no join key has more than 1,024 rows a key and tier
(8,192 in the uppermost, which covers all time), no window more rows than that, whatever the input; nothing goes to
the driver.

Defined results: an interval without a start, or whose end isn't after its start, takes no part; one without an end is
open for ever; repeated intervals count each; a null key takes no part; moments at which starts and ends cancel in both
sums have no row; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.common import materialize

#: Bits of time, of a block, and of a node's place within its number (levels stand above it).
TIME_BITS, BLOCK_BITS, PLACE_BITS = 33, 10, 34
#: Added to minutes since 1970, so that each time that a timestamp can hold is in the range.
OFFSET, TOP = 1 << 31, 1 << TIME_BITS
#: Lowest and highest level of each tier, from the uppermost.
TIERS = ((20, TIME_BITS), (10, 19), (0, 9))
#: After the last shipment a sale stays open for so many minutes.
OPEN_MINUTES = 7 * 24 * 60


def minute_of(ts: Column) -> Column:
    """Minutes since 1970 of a timestamp without a zone (or of one in the session's zone), rounded down."""
    return F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def cents_of(total: Column) -> Column:
    """Whole cents; null, and what isn't a finite number, counts as 0."""
    x = total.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0)).otherwise(F.floor(100 * x + 0.5)).cast("long")


def _at(level: Column, x: str) -> Column:
    return F.call_function("shiftright", F.col(x), level)


def _node(level: Column, place: Column) -> Column:
    return F.call_function("shiftleft", level.cast("long"), F.lit(PLACE_BITS)).bitwiseOR(place)


def dyadic_nodes(intervals: DataFrame) -> DataFrame:
    """(key, node, n, cents) of intervals (key, a, b, n, cents), 0 <= a < b <= TOP, summed by node."""
    levels = F.sequence(F.lit(0), F.least(F.lit(TIME_BITS), F.floor(F.log2(F.col("b") - F.col("a"))).cast("int") + 1))
    cut = intervals.withColumn("level", F.explode(levels))
    # the first node that begins in the interval, and the first that doesn't end in it
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    cut = cut.withColumns({"l": F.call_function("shiftright", F.col("a") + one - 1, F.col("level")), "r": _at(F.col("level"), "b")}).where("l < r")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1).cast("long")) == 1
    ends = F.array(F.when(odd("l"), F.col("l")), F.when(odd("r"), F.col("r") - 1))
    each = cut.select("key", "level", "n", "cents", F.explode(ends).alias("place")).where("place is not null")
    return each.groupBy("key", _node(F.col("level"), F.col("place")).alias("node")).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


def change_moments(intervals: DataFrame) -> DataFrame:
    """(key, t) of the moments at which the number or the sum of open intervals changes."""
    ends = F.array(F.struct(F.col("a").alias("t"), F.col("n").alias("n"), F.col("cents").alias("cents")), F.struct(F.col("b").alias("t"), (-F.col("n")).alias("n"), (-F.col("cents")).alias("cents")))
    each = intervals.select("key", F.explode(ends).alias("e")).select("key", "e.*").where(F.col("t") < TOP)
    return each.groupBy("key", "t").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")).where("n <> 0 or cents <> 0").select("key", "t")


def open_at(moments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, t, n_open, open_cents) of moments (key, t): the sums over the nodes that contain each."""
    above = None
    for low, high in TIERS:
        at = moments.select("key", F.shiftright("t", low).alias("at"))
        at = at.distinct() if low else at
        tier = nodes.where(F.shiftright("node", PLACE_BITS).between(low, high)).select("key", "node", "n", "cents")
        if above is not None:
            tier = tier.unionByName(above.select("key", _node(F.lit(high + 1), F.col("at")).alias("node"), "n", "cents"))
        levels = F.sequence(F.lit(low), F.lit(high if above is None else high + 1))
        each = at.withColumn("level", F.explode(levels))
        each = each.select("key", "at", _node(F.col("level"), _at(F.col("level") - low, "at")).alias("node"))
        found = each.join(tier, ["key", "node"], "left").groupBy("key", "at")
        above = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))
    return above.select("key", F.col("at").alias("t"), F.col("n").alias("n_open"), F.col("cents").alias("open_cents"))


def _scanned(rows: DataFrame, at: str, bits: int) -> DataFrame:
    """rows (key, at, most, first) with what lies in the same block of 2^bits places: the most before a row
    (high) and the first moment after it (next)."""
    block = Window.partitionBy("key", F.shiftright(at, bits)).orderBy(at)
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"high": F.max("most").over(before), "next": F.lead("first").over(block)})


def _rolled(rows: DataFrame, at: str, bits: int) -> DataFrame:
    return rows.groupBy("key", F.shiftright(at, bits).alias("at")).agg(F.max("most").alias("most"), F.min("first").alias("first"))


def maxima(opens: DataFrame) -> DataFrame:
    """opens (key, t, n_open, ...) with to_t (the key's next moment), high_open (its most so far) and is_peak."""
    one = opens.select("key", F.col("t").alias("at"), F.col("n_open").alias("most"), F.col("t").alias("first"))
    blocks = materialize(_rolled(one, "at", BLOCK_BITS), "blocks")
    tops = _rolled(blocks, "at", BLOCK_BITS)
    whole = Window.partitionBy("key")
    # a key's blocks of 2^20 units: 8,192 rows at most
    tops = _scanned(tops, "at", TIME_BITS).withColumn("peak", F.max("most").over(whole))
    tops = tops.select("key", F.col("at").alias("top"), F.col("high").alias("high_top"), F.col("next").alias("next_top"), "peak")
    blocks = _scanned(blocks, "at", BLOCK_BITS).withColumn("top", F.shiftright("at", BLOCK_BITS)).join(tops, ["key", "top"])
    blocks = blocks.select("key", F.col("at").alias("block"), F.greatest("high", "high_top").alias("high_block"), F.coalesce("next", "next_top").alias("next_block"), "peak")
    rows = _scanned(opens.withColumns({"most": F.col("n_open"), "first": F.col("t")}), "t", BLOCK_BITS).withColumn("block", F.shiftright("t", BLOCK_BITS))
    rows = rows.join(blocks, ["key", "block"])
    return rows.select(*opens.columns, F.coalesce("next", "next_block").alias("to_t"), F.greatest("n_open", "high", "high_block").alias("high_open"), (F.col("n_open") == F.col("peak")).alias("is_peak"))


def sweep(intervals: DataFrame) -> DataFrame:
    """(key, t, to_t, n_open, open_cents, high_open, is_peak) of intervals (key, a, b, cents), a row each time that a key's
    open intervals change. Times lie in 0 (included) to TOP (excluded); a null b is never."""
    whole = intervals.select("key", "a", F.coalesce("b", F.lit(TOP)).alias("b"), "cents").where("key is not null and a < b")
    counted = materialize(whole.groupBy("key", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")), "intervals")
    nodes, moments = materialize(dyadic_nodes(counted), "nodes"), materialize(change_moments(counted), "moments")
    found = maxima(materialize(open_at(moments, nodes), "opens"))
    return found.select("key", "t", "to_t", "n_open", "open_cents", "high_open", "is_peak")


def sale_intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame) -> DataFrame:
    """(key, a, b, cents): each sale for its client's nation (-1 without one) and for -2, all nations. Where
    client_id repeats in clients, the least nation counts. Sales without an id have no lines and are dealt by hash."""
    ends = lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg(F.max("shipped_at").alias("shipped"))
    # written, so that the joins read exchanges of their own, whose large partitions adaptive execution can split
    ends = materialize(ends.select(F.col("sale_id").alias("sale"), F.lit(True).alias("known_sale"), "shipped"), "ends")
    nations = clients.where("client_id is not null").groupBy("client_id").agg(F.min("nation_id").alias("nation"))
    nations = materialize(nations.select(F.col("client_id").alias("client"), F.lit(True).alias("known_client"), "nation"), "nations")
    sold = sales.where("sold_at is not null")
    # null ids meet nothing; a hash in their place keeps them out of one task
    spread = F.xxhash64("sale_id", "client_id", "sold_at", "total")
    known = lambda c: F.col(c).isNotNull()
    sold = sold.select(F.coalesce("sale_id", spread).alias("sale"), known("sale_id").alias("known_sale"), F.coalesce("client_id", spread).alias("client"), known("client_id").alias("known_client"), minute_of(F.col("sold_at")).alias("sold"), cents_of(F.col("total")).alias("cents"))
    met = sold.join(ends, ["sale", "known_sale"], "left").join(nations, ["client", "known_client"], "left")
    until = minute_of(F.col("shipped")) + OPEN_MINUTES + OFFSET
    key = F.explode(F.array(F.coalesce("nation", F.lit(-1)), F.lit(-2))).alias("key")
    return met.select(key, (F.col("sold") + OFFSET).alias("a"), until.alias("b"), "cents")


def peak_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sales = read("sales").select("sale_id", "client_id", "sold_at", "total")
    found = sweep(sale_intervals(sales, read("sale_lines").select("sale_id", "shipped_at"), read("clients").select("client_id", "nation_id")))
    seconds = lambda c: (F.col(c) - OFFSET) * 60
    return found.select(F.col("key").cast("int").alias("nation_id"), seconds("t").alias("from_s"), seconds("to_t").alias("to_s"), "n_open", "open_cents", "high_open", "is_peak")


def peak_sql() -> str:
    """DuckDB's SQL for the digest: events in order of time, one window a nation."""
    minute = "(floor(epoch({}) / 60)::bigint * 60)"
    return f"""
with shipped as (select sale_id, max(shipped_at) as s from sale_lines where shipped_at is not null group by sale_id),
nations as (select client_id, min(nation_id) as nation from clients group by client_id),
sold as (select coalesce(nation, -1) as nation, {minute.format('sold_at')} as a, {minute.format('s')} + {OPEN_MINUTES * 60} as b,
    case when total is null or not isfinite(total) then 0 else floor(100 * total + 0.5)::bigint end as cents
    from sales left join shipped using (sale_id) left join nations using (client_id) where sold_at is not null),
part as (select unnest([nation, -2]) as nation, a, b, cents from sold where b is null or b > a),
turns as (select nation, a as t, 1 as n, cents from part union all select nation, b, -1, -cents from part where b is not null),
moves as (select nation, t, sum(n) as n, sum(cents) as cents from turns group by all having sum(n) <> 0 or sum(cents) <> 0),
-- moments without a change add nothing, so leaving them out leaves the sums right
run as (select nation, t, lead(t) over w as next, sum(n) over w as n_open, sum(cents) over w as open_cents from moves window w as (partition by nation order by t))
select nation::int as nation_id, t as from_s, next as to_s, n_open::bigint as n_open, open_cents::bigint as open_cents,
    max(n_open) over (partition by nation order by t rows unbounded preceding)::bigint as high_open, n_open = max(n_open) over (partition by nation) as is_peak from run"""
