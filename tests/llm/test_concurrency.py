"""The concurrency sweep against plain counting."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from trendloom.llm import concurrency as c

SHAPE = "key int, a long, b long, cents long"


def plain(intervals):
    """Rows of the sweep by counting all intervals at every moment."""
    by = defaultdict(list)
    for key, a, b, cents in intervals:
        b = c.TOP if b is None else b
        if key is not None and a is not None and a < b:
            by[key].append((a, b, cents))
    out = []
    for key, own in by.items():
        rows = []
        for t in sorted({x for a, b, _ in own for x in (a, b) if x < c.TOP}):
            dn = sum((a == t) - (b == t) for a, b, _ in own)
            dc = sum(((a == t) - (b == t)) * cents for a, b, cents in own)
            if dn or dc:
                live = [cents for a, b, cents in own if a <= t < b]
                rows.append((t, len(live), sum(live)))
        top = max((n for _, n, _ in rows), default=0)
        high = 0
        for i, (t, n, cents) in enumerate(rows):
            high = max(high, n)
            out.append((key, t, rows[i + 1][0] if i + 1 < len(rows) else None, n, cents, high, n == top))
    return sorted(out)


def run(spark, intervals):
    return sorted(map(tuple, c.sweep(spark.createDataFrame(intervals, SHAPE)).collect()))


def test_nodes_make_up_each_interval(spark):
    rng = random.Random(1)
    ranges = [(0, c.TOP), (0, 1), (c.TOP - 1, c.TOP), (5, 6), (0, 1024), (1023, 1025), (1, c.TOP)] + [tuple(sorted(rng.sample(range(3000), 2))) for _ in range(40)]
    df = spark.createDataFrame([(i, a, b, 1, 0) for i, (a, b) in enumerate(ranges)], "key int, a long, b long, n long, cents long")
    found = defaultdict(list)
    for r in c.dyadic_nodes(df).collect():
        level, place = r.node >> c.PLACE_BITS, r.node & (1 << c.PLACE_BITS) - 1
        found[r.key].append((place << level, (place + 1) << level))
        assert r.n == 1
    for i, (a, b) in enumerate(ranges):
        nodes = sorted(found[i])
        assert nodes[0][0] == a and nodes[-1][1] == b and all(x[1] == y[0] for x, y in zip(nodes, nodes[1:], strict=False))
        assert len(nodes) <= 2 * (c.TIME_BITS + 1)


def test_equals_plain_counting(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        a = rng.choice([rng.randrange(60), rng.randrange(5000), rng.randrange(1 << 22), c.OFFSET + rng.randrange(100)])
        b = rng.choice([None, a, a - 1, a + rng.randrange(40), a + rng.randrange(5000), a + rng.randrange(1 << 21)])
        rows.append((rng.choice([-2, -1, 0, 7, None]), a, b, rng.choice([0, 5, -3, 100])))
    rows += [(3, None, 5, 1), (4, 10, 20, 7), (4, 20, 30, 7), (4, 20, 20, 1), (5, 0, 10, 1), (5, 10, 20, 2), (6, 0, None, 0), (6, 0, None, 0)]
    assert run(spark, rows) == plain(rows)


def test_starts_and_ends_that_cancel_have_no_row(spark):
    assert run(spark, [(1, 0, 10, 5), (1, 10, 20, 5)]) == [(1, 0, 20, 1, 5, 1, True), (1, 20, None, 0, 0, 1, False)]
    assert run(spark, [(1, 0, 10, 5), (1, 10, 20, 6)])[1] == (1, 10, 20, 1, 6, 1, True)


def test_no_intervals_no_rows(spark):
    assert run(spark, []) == []


SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def test_sales_and_their_nations(spark):
    at = lambda *x: datetime(2024, 1, *x)
    sales = [
        (1, 10, "x", 1.005, at(1, 8, 0, 59), None, 1), (2, 11, "x", None, at(1, 8, 1), None, 1), (3, 12, "x", float("nan"), at(2), None, 1), (4, None, "x", 2.5, at(3), None, 1),
        (None, 10, "x", 1.0, at(3), None, 1), (5, 10, "x", 1.0, None, None, 1), (6, 10, "x", 1.0, at(20), None, 1), (1, 10, "x", 1.0, at(1), None, 1), (7, 99, "x", -0.014, datetime(1960, 5, 5, 1, 2, 3), None, 1),
    ]
    lines = [(1, at(2)), (1, at(1)), (1, None), (2, None), (3, at(4, 12, 30, 30)), (6, at(2)), (None, at(9)), (8, at(9)), (7, datetime(1960, 5, 5))]
    clients = [(10, 4), (11, None), (12, 5), (None, 6), (12, 3)]
    df = c.sale_intervals(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz"), spark.createDataFrame(clients, "client_id long, nation_id int"))
    minute = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(minutes=1) // 1) + c.OFFSET
    week = 7 * 1440
    want = [
        (4, minute(at(1, 8)), minute(at(2)) + week, 100), (-1, minute(at(1, 8, 1)), None, 0), (3, minute(at(2)), minute(at(4, 12, 30)) + week, 0), (-1, minute(at(3)), None, 250),
        (4, minute(at(3)), None, 100), (4, minute(at(20)), minute(at(2)) + week, 100), (4, minute(at(1)), minute(at(2)) + week, 100), (-1, minute(datetime(1960, 5, 5, 1, 2)), minute(datetime(1960, 5, 5)) + week, -1),
    ]
    assert 100 * 1.005 + 0.5 < 101  # as the contract's arithmetic has it
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted(want + [(-2, *w[1:]) for w in want], key=repr)
    assert sorted(map(tuple, c.sweep(df).collect())) == plain(got)


def test_no_block_of_a_scan_is_larger_than_its_bound(spark):
    # a start each unit: blocks of 1,024 moments, and two tiers above them
    rows = spark.range(5000).selectExpr("1 as key", "id as a", "cast(null as long) as b", "1L as cents")
    got = sorted(map(tuple, c.sweep(rows).collect()))
    assert got == [(1, t, t + 1 if t < 4999 else None, t + 1, t + 1, t + 1, t == 4999) for t in range(5000)]
