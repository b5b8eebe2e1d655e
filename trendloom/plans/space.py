"""Queries over vectors: centroids, gates, nearest states, retrieval metrics, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions import text, vectors
from trendloom.operators import clustering, gates, metrics, retrieval, state, tfidf
from trendloom.plans.corpus import _TITLE, _WORDS, _tf
from trendloom.plans.evidence import read
from trendloom.sources.shared import materialize

_CUTS = [0.7, 0.8, 0.9]
#: Thresholds and dense weights of the benchmark (fixed values), and thresholds beyond them.
_GRID, _ALPHAS = [round(0.05 + 0.025 * i, 3) for i in range(25)] + _CUTS, (0.80, 0.90, 0.95)


def _points(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


def embedding_centroids(spark, sf_dir):
    c = vectors.centroids(_points(spark, sf_dir), "label", "vector")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", "n", "pos", F.round("x", 5).alias("x"))


def vector_validity(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", vectors.valid(F.col("vector"), 64).alias("valid"), F.round(vectors.norm(F.col("vector")), 5).alias("norm"))


def vector_gate(spark, sf_dir):
    p = _points(spark, sf_dir)
    gated = gates.vector_gate(p, vectors.centroids(p, "label", "vector"), "label", threshold=0.15)
    return gated.select("vec_id", "label", F.round("similarity", 5).alias("similarity"), "accepted")


def nearest_state_match(spark, sf_dir):
    """Rows with even ids as states of their label's parity, odd ones as clusters."""
    p = _points(spark, sf_dir).withColumn("parity", F.col("label") % 2)
    states = p.where("vec_id % 2 = 0").select("parity", F.col("vec_id").alias("trend_id"), F.col("vector").alias("centroid"), F.to_timestamp(F.lit("2024-01-01")).alias("created_at"))
    clusters = p.where("vec_id % 2 = 1").select("parity", F.col("vec_id").alias("cluster_id"), F.col("vector").alias("centroid"))
    return state.nearest(clusters, states, ["parity"], 0.2).select("cluster_id", "trend_id", F.round("similarity", 5).alias("similarity"))


def _asked(spark, sf_dir):
    """The benchmark's stated queries, and all other rows as documents."""
    p = _points(spark, sf_dir)
    q = p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), "vector")
    return p.where("vec_id % 20 <> 0").select(F.col("vec_id").alias("doc_id"), "label", "vector"), q


def retrieval_metrics(spark, sf_dir):
    return metrics.averaged(retrieval.retrieval(*_asked(spark, sf_dir), labels=10), ["query_label"])


def pair_ordering(spark, sf_dir):
    """How often the nearer of two consecutive documents has the query's label."""
    d, q = _asked(spark, sf_dir)
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("label").alias("other_label"), F.col("vector").alias("other"))
    return retrieval.ordered(d.join(after, "doc_id"), q)


def clustering_quality_fixed(spark, sf_dir):
    p = _points(spark, sf_dir).select("label", (F.col("vec_id") % 7).alias("cluster"))
    return clustering.quality(p)


def cluster_composition(spark, sf_dir):
    return clustering.composition(_points(spark, sf_dir).select("label", (F.col("vec_id") % 7).alias("cluster")))


def microcluster_quality(spark, sf_dir):
    found = clustering.microclusters(_points(spark, sf_dir).withColumn("block", F.col("label") % 2), "block", "vec_id", "vector", 0.9)
    return clustering.quality(found.join(_points(spark, sf_dir).select("vec_id", "label"), "vec_id"))


def dbscan_core_points(spark, sf_dir):
    return clustering.core_points(clustering.close_pairs(_points(spark, sf_dir), "label", "vec_id", "vector", 0.2), 3)


def dbscan_clusters(spark, sf_dir):
    p = _points(spark, sf_dir)
    return clustering.dbscan(p.select(F.col("vec_id").alias("id")), clustering.close_pairs(p, "label", "vec_id", "vector", 0.3), 3)


def threshold_sweep(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("block", F.col("label") % 2)
    return clustering.sweep(p, "block", "vec_id", "vector", "label", _CUTS)


def hybrid_sweep(spark, sf_dir):
    """The vectors of documents with the terms of their titles: thresholds and weights of the benchmark, and wider ones,
    since these vectors lie far apart."""
    p = _points(spark, sf_dir).withColumn("block", F.col("label") % 2)
    titles = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), text.first_line(F.col("text")).alias("title"))
    p = materialize(p.join(titles, "vec_id"), "points")
    return clustering.sweep(p, "block", "vec_id", "vector", "label", _GRID, tfidf.vectors(p, "block", "vec_id", "title").select("block", F.col("vec_id").alias("key"), "term", "w").withColumnRenamed("key", "vec_id"), _ALPHAS)


_V = "p as (select vec_id, label, embedding::double[] as v from embeddings)"
_MEAN = "m as (select label, i as pos, avg(v[i]) as x from p, range(1, 65) r(i) group by all), cen as (select label, list(x order by pos) as c, sqrt(sum(x * x)) as l from m group by label)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_SIM = f"q as (select vec_id as query_id, label as query_label, v as qv from p where vec_id % 20 = 0), s as (select query_id, query_label, vec_id as doc_id, label, round({_COS.format(a='qv', b='v')}, 6) as similarity from p, q where vec_id % 20 <> 0)"
_QUALITY = """cells as (select label, cluster, count(*)::double as n from l group by all), w as (select sum(n) as t, sum(n * ln(n)) as h, sum(n * (n - 1) / 2) as p from cells),
  a as (select sum(n * ln(n)) as ht, sum(n * (n - 1) / 2) as pt from (select label, sum(n) as n from cells group by label)), b as (select sum(n * ln(n)) as hf, sum(n * (n - 1) / 2) as pf, count(*) as clusters, count(*) filter (n = 1) as singletons from (select cluster, sum(n) as n from cells group by cluster)),
  e as (select *, ln(t) - ht / t as th, ln(t) - hf / t as fh, ln(t) - h / t as jh, pt * pf / (t * (t - 1) / 2) as chance, (pt + pf) / 2 as top from w, a, b), g as (select *, (th + fh - jh) / th as ho, (th + fh - jh) / fh as co from e)
  select clusters, 0 as noise, singletons, round(ho, 6) as homogeneity, round(co, 6) as completeness, round(2 * ho * co / (ho + co), 6) as v_measure, round(2 * ho * co / (ho + co), 6) as nmi, round(1.5 * ho * co / (0.5 * ho + co), 6) as purity_weighted_v, round((p - chance) / (top - chance), 6) as ari from g"""

# average linkage of s (alpha, block, x, y, cos), x before y, step by step: the nearest two clusters of each block merge
_LINK = """st(it, alpha, block, id, c, h) as (select 0, alpha, block, vec_id, vec_id, -1.0::double from pts union all
  select st.it + 1, st.alpha, st.block, st.id, case when st.c = m.b then m.a else st.c end, m.d from st join
    (select alpha, block, arg_min(a, d) as a, arg_min(b, d) as b, min(d) as d from (select s.alpha, s.block, least(l.c, r.c) as a, greatest(l.c, r.c) as b, 1 - avg(cos) as d
      from s join st l on l.id = s.x and l.alpha = s.alpha join st r on r.id = s.y and r.alpha = s.alpha where l.c <> r.c group by all) where d < {top} group by alpha, block) m on st.alpha = m.alpha and st.block = m.block)"""
_CUT = "g as (select alpha, unnest({cuts}::double[]) as threshold, it, id, c, h from st), l as (select g.alpha, threshold, label, arg_max(c, it) as cluster from g join embeddings on vec_id = id where h < threshold group by g.alpha, threshold, id, label)"
_RATED = """cells as (select alpha, threshold, label, cluster, count(*)::double as n from l group by all), w as (select alpha, threshold, sum(n) as t, sum(n * ln(n)) as h, sum(n * (n - 1) / 2) as p from cells group by all),
  a as (select alpha, threshold, sum(n * ln(n)) as ht, sum(n * (n - 1) / 2) as pt from (select alpha, threshold, label, sum(n) as n from cells group by all) group by all),
  b as (select alpha, threshold, sum(n * ln(n)) as hf, sum(n * (n - 1) / 2) as pf, count(*) as clusters, count(*) filter (n = 1) as singletons from (select alpha, threshold, cluster, sum(n) as n from cells group by all) group by all),
  e as (select *, ln(t) - ht / t as th, ln(t) - hf / t as fh, ln(t) - h / t as jh, pt * pf / (t * (t - 1) / 2) as chance, (pt + pf) / 2 as mid from w join a using (alpha, threshold) join b using (alpha, threshold)),
  k as (select *, case when th > 1e-12 then (th + fh - jh) / th else 1.0 end as ho, case when fh > 1e-12 then (th + fh - jh) / fh else 1.0 end as co from e),
  o as (select alpha, threshold, clusters, 0 as noise, singletons, round(ho, 6) as homogeneity, round(co, 6) as completeness, round(2 * ho * co / (ho + co), 6) as v_measure, round(2 * ho * co / (ho + co), 6) as nmi, round(1.5 * ho * co / (0.5 * ho + co), 6) as purity_weighted_v, round(case when mid = chance then 1.0 else (p - chance) / (mid - chance) end, 6) as ari from k)
  select *, row_number() over (order by purity_weighted_v desc, ari desc, v_measure desc, abs(clusters - (select count(distinct label) from embeddings)), singletons, alpha < 1, alpha, threshold)::int as place from o"""
_DENSE = f"s as (select 1.0::double as alpha, a.label % 2 as block, a.vec_id as x, b.vec_id as y, {_COS.format(a='a.v', b='b.v')} as cos from p a join p b on a.label % 2 = b.label % 2 and a.vec_id < b.vec_id), pts as (select 1.0::double as alpha, label % 2 as block, vec_id from p)"


QUERIES = {
    "embedding_centroids": (embedding_centroids, f"with {_V}, {_MEAN} select cen.label, (select count(*) from p where p.label = cen.label) as n, (i - 1)::int as pos, round(c[i] / l, 5) as x from cen, range(1, 65) r(i)"),
    "vector_validity": (vector_validity, f"with {_V} select vec_id, len(v) = 64 as valid, round(sqrt(list_dot_product(v, v)), 5) as norm from p"),
    "vector_gate": (vector_gate, f"with {_V}, {_MEAN} select vec_id, p.label, round({_COS.format(a='v', b='c')}, 5) as similarity, {_COS.format(a='v', b='c')} >= 0.15 as accepted from p join cen on p.label = cen.label"),
    "nearest_state_match": (nearest_state_match, f"with {_V}, s as (select label % 2 as parity, vec_id as trend_id, v as sv from p where vec_id % 2 = 0), c as (select label % 2 as parity, vec_id as cluster_id, v from p where vec_id % 2 = 1), m as (select cluster_id, trend_id, {_COS.format(a='v', b='sv')} as sim from c join s on c.parity = s.parity) select cluster_id, trend_id, round(sim, 5) as similarity from m where sim >= 0.2 qualify row_number() over (partition by cluster_id order by sim desc, trend_id) = 1"),
    "retrieval_metrics": (retrieval_metrics, f"""with {_V}, {_SIM}, r as (select *, label = query_label as rel, label = (query_label + 1) % 10 as hard, row_number() over (partition by query_id order by similarity desc, doc_id desc) as rk from s),
      e as (select query_label, query_id, count(*) filter (rel and rk <= 1) / count(*) filter (rel)::double as r1, count(*) filter (rel and rk <= 3) / count(*) filter (rel)::double as r3, count(*) filter (rel and rk <= 5) / count(*) filter (rel)::double as r5, min(rk) filter (rel) as best, min(rk) filter (hard) as worst from r group by all)
      select query_label, count(*) as queries, round(avg(coalesce(r1, 0)), 6) as recall_at_1, round(avg(coalesce(r3, 0)), 6) as recall_at_3, round(avg(coalesce(r5, 0)), 6) as recall_at_5, round(avg(coalesce(1.0 / best, 0)), 6) as mrr, round(avg(case when best < worst then 1.0 else 0.0 end), 6) as hard_negative_win_rate from e group by query_label"""),
    "pair_ordering": (pair_ordering, f"with {_V}, {_SIM} select count(*) as pairs, count(*) filter (a.similarity > b.similarity) as ordered from s a join s b on a.query_id = b.query_id and b.doc_id = a.doc_id + 1 where a.label = a.query_label and b.label <> b.query_label"),
    "clustering_quality_fixed": (clustering_quality_fixed, f"with l as (select label, vec_id % 7 as cluster from embeddings), {_QUALITY}"),
    "cluster_composition": (cluster_composition, "select vec_id % 7 as cluster, label, count(*) as n from embeddings group by all"),
    "microcluster_quality": (microcluster_quality, f"with recursive {_V}, {_DENSE}, {_LINK.format(top=0.9)}, l as (select label, arg_max(c, it) as cluster from st join embeddings on vec_id = id group by id, label), {_QUALITY}"),
    "threshold_sweep": (threshold_sweep, f"with recursive {_V}, {_DENSE}, {_LINK.format(top=0.9)}, {_CUT.format(cuts=_CUTS)}, {_RATED}"),
    "hybrid_sweep": (hybrid_sweep, f"""with recursive {_V}, q as (select vec_id, label % 2 as block, e.v, {_TITLE} as title from p e join documents on vec_id = doc_id), src as (select block as g, vec_id as d, title as t from q), {_tf(_WORDS, '(1 + ln(tf))').replace('v as (', 'lexical as (')},
      lex as (select x.g, x.d as x, y.d as y, sum(x.w * y.w) as c from lexical x join lexical y on x.g = y.g and x.term = y.term and x.d < y.d group by all),
      both_ as (select a.block, a.vec_id as x, b.vec_id as y, {_COS.format(a='a.v', b='b.v')} as dense, coalesce(c, 0) as lexical from q a join q b on a.block = b.block and a.vec_id < b.vec_id left join lex on lex.g = a.block and lex.x = a.vec_id and lex.y = b.vec_id),
      ways as (select unnest([1.0, {', '.join(map(str, _ALPHAS))}]::double[]) as alpha), s as materialized (select alpha, block, x, y, alpha * dense + (1 - alpha) * lexical as cos from both_, ways), pts as (select alpha, block, vec_id from q, ways), {_LINK.format(top=0.9)}, {_CUT.format(cuts=_GRID)}, {_RATED}"""),
    "dbscan_clusters": (dbscan_clusters, f"""with recursive {_V}, n as (select a.vec_id as a, b.vec_id as b from p a join p b on a.label = b.label and a.vec_id <> b.vec_id where round({_COS.format(a='a.v', b='b.v')}, 6) >= 0.3),
      core as (select a as id from n group by a having count(*) + 1 >= 3), inn as (select a, b from n where a in (select id from core) and b in (select id from core)),
      reach(id, seen) as (select id, id from core union select reach.id, inn.b from reach join inn on inn.a = reach.seen), root as (select id, min(seen) as cluster from reach group by id),
      border as (select n.a as id, min(root.cluster) as cluster from n join root on root.id = n.b where n.a not in (select id from core) group by n.a)
      select vec_id as id, coalesce(root.cluster, border.cluster) as cluster from p left join root on root.id = vec_id left join border on border.id = vec_id"""),
    "dbscan_core_points": (dbscan_core_points, f"with {_V}, n as (select a.vec_id as a, b.vec_id as b from p a join p b on a.label = b.label and a.vec_id < b.vec_id where round({_COS.format(a='a.v', b='b.v')}, 6) >= 0.2) select id from (select a as id from n union all select b from n) group by id having count(*) + 1 >= 3"),
}
