"""Deduplication across batches, against an index that lasts.

Rows are taken in order: a row is a duplicate if an earlier *unique* one, of any batch, has one of its exact keys, or has a
title, an evidence block and actors like its own; duplicates are never indexed and make none. Rows of equal title tokens,
hash, block and actors have one signature, of which at most one row can be unique, so titles meet by signature: by
sketches, in products of tiles of like sizes (``sketches.near``), and only pairs that pass these become rows.

Whether a row is unique may hang on earlier ones. Each round looks at the earliest row left of each key and signature: who
stands behind a unique one is a duplicate, who stands behind none is unique, and what is left over goes to the next
round. Rounds carry the rows that are still open, with what these stand behind, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.operators import sketches
from trendloom.operators.dedup import HAMMING, JACCARD, TOKENS
from trendloom.sources.segments import Segments
from trendloom.sources.shared import materialize

_TITLE = "sig binary, id string, batch long, seq long, block string, n int, tokens array<string>, simhash long, actors array<string>"
_SHAPES = {
    "keys": "key string, id string, batch long, seq long",
    "titles": _TITLE,
    "results": "id string, batch long, seq long, unique boolean, duplicate_of string, reason string, similarity double",
}


class DedupIndex:
    """The index under path. Rows to add: id, seq (long, unique within a batch), keys (array, in the order in which they
    are tried), block, tokens (distinct), simhash, actors. Batches are numbered from 0 in order; one that is in
    already gives its results again. A null block is one of its own; null keys, tokens and actors count as none."""

    def __init__(self, spark: SparkSession, path: str, jaccard: float = JACCARD, hamming: int = HAMMING, least: int = TOKENS):
        if not 0 < jaccard <= 1 or not 0 <= hamming <= 64 or least < 1:
            raise ValueError("jaccard must be in (0, 1], hamming in [0, 64], least at least 1")
        self.store, self.jaccard, self.hamming, self.least = Segments(spark, path, _SHAPES), jaccard, hamming, least

    def results(self, batch: int | None = None) -> DataFrame:
        """id, batch, seq, unique, duplicate_of, reason, similarity of the rows of a batch, or of all."""
        found = self.store.read("results")
        return found if batch is None else found.where(F.col("batch") == batch)

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """The results of a batch, which is indexed with them."""
        last, segments = self.store.manifest()
        if batch <= last:
            return self.results(batch)
        old = {t: self.store.read(t, segments) for t in ("keys", "titles")}
        mine = materialize(_prepared(rows, self.least), "batch")
        titles = materialize(mine.where("sig is not null").groupBy("sig").agg(*(F.first(c).alias(c) for c in ("block", "n", "tokens", "simhash", "actors"))), "titles")
        edges = materialize(self._edges(titles, old["titles"]), "edges")

        behind = materialize(_behind_index(mine, edges, old["keys"], old["titles"]), "behind")
        unique = _uniques(mine.join(behind, "seq", "left_anti"), edges.where("not indexed"))
        unique = materialize(mine.join(unique, "seq"), "unique")

        number = F.lit(batch).cast("long").alias("batch")
        keys = unique.select("id", "seq", F.explode("keys").alias("key")).groupBy("key").agg(F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq"))
        keys = materialize(keys.join(old["keys"], "key", "left_anti").select("key", "id", number, "seq"), "new-keys")
        new = unique.where("sig is not null").select("sig", "id", number, "seq", "block", "n", "tokens", "simhash", "actors")
        found = _explained(mine, unique, edges, old["keys"].unionByName(keys), old["titles"].unionByName(new).select("sig", "id", "batch", "seq"), batch)
        results = found.select("id", number, "seq", "unique", "duplicate_of", "reason", "similarity")
        tables = {"keys": keys, "titles": new, "results": results}
        self.store.add(batch, {t: df.select(*self.store.read(t, []).columns) for t, df in tables.items()})
        return self.results(batch)

    def _edges(self, titles: DataFrame, old_titles: DataFrame) -> DataFrame:
        """(a, b, similarity, indexed): the signatures of the batch with those like them, of the batch or indexed."""
        # a null block is one of its own
        rows = lambda df: sketches.sketched(df.select(F.col("sig").alias("id"), F.coalesce(F.concat(F.lit("b"), "block"), F.lit("")).alias("block"), "tokens", "simhash"))
        mine = materialize(rows(titles), "sketches")
        pairs = sketches.near(mine, None, self.jaccard, self.hamming).select("a", "b", F.lit(False).alias("indexed"))
        pairs = pairs.unionByName(sketches.near(mine, rows(old_titles), self.jaccard, self.hamming).where("a <> b").select("a", "b", F.lit(True).alias("indexed")))
        pairs = materialize(pairs, "near")
        side = lambda df, x: df.select(F.col("sig").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("tokens", "simhash", "actors")))
        both = pairs.join(side(titles, "a"), "a").join(side(old_titles.select("sig", "tokens", "simhash", "actors").unionByName(titles.select("sig", "tokens", "simhash", "actors").join(old_titles.select("sig"), "sig", "left_anti")), "b"), "b")
        j, d = text.jaccard(F.col("tokens_a"), F.col("tokens_b")), text.hamming(F.col("simhash_a"), F.col("simhash_b"))
        meet = (F.size("actors_a") == 0) | (F.size("actors_b") == 0) | F.arrays_overlap("actors_a", "actors_b")
        good = both.withColumns({"j": j, "d": d}).where((F.col("j") >= self.jaccard) & (F.col("d") <= self.hamming) & meet)
        found = materialize(good.select("a", "b", F.least("j", 1 - F.col("d") / 64).alias("similarity"), "indexed"), "close")
        return found.unionByName(found.where("not indexed").select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "indexed"))


def _prepared(rows: DataFrame, least: int) -> DataFrame:
    none = F.array().cast("array<string>")
    full = rows.select(
        F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), F.array_distinct(F.array_compact(F.coalesce("keys", none))).alias("keys"), F.col("block").cast("string").alias("block"),
        F.array_distinct(F.array_compact(F.coalesce("tokens", none))).alias("tokens"), F.coalesce("simhash", F.lit(0)).cast("long").alias("simhash"), F.array_sort(F.array_distinct(F.array_compact(F.coalesce("actors", none)))).alias("actors"),
    )
    full = full.withColumn("n", F.size("tokens"))
    # 128 bits of what titles are compared by
    sign = F.unhex(F.substring(F.sha2(F.to_json(F.struct("block", F.array_sort("tokens").alias("t"), "simhash", "actors")), 256), 1, 32))
    return full.withColumn("sig", F.when(F.col("n") >= least, sign))


def _behind_index(rows: DataFrame, edges: DataFrame, keys: DataFrame, titles: DataFrame) -> DataFrame:
    """seq of the rows that an indexed one makes duplicates: by a key, the same signature, or one like it."""
    by_key = rows.select("seq", F.explode("keys").alias("key")).join(keys.select("key"), "key", "left_semi").select("seq")
    near = titles.select("sig").union(edges.where("indexed").select("a")).distinct()
    return by_key.union(rows.join(near, "sig", "left_semi").select("seq")).distinct()


def _uniques(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """seq of the rows (seq, keys, sig) that are unique among themselves. edges: (a, b) of signatures, both ways."""
    sign = F.concat(F.lit("s:"), F.hex("sig"))
    marks = rows.select("seq", F.explode(F.concat(F.transform("keys", lambda k: F.concat(F.lit("k:"), k)), F.when(F.col("sig").isNotNull(), F.array(sign)).otherwise(F.array().cast("array<string>")))).alias("mark"), F.lit(False).alias("unique"))
    near = materialize(edges.select(F.concat(F.lit("s:"), F.hex("a")).alias("mark"), F.concat(F.lit("s:"), F.hex("b")).alias("other")), "near")
    # rows without a mark stand behind nothing
    done = [materialize(rows.where(F.col("sig").isNull() & (F.size("keys") == 0)).select("seq"), "unmarked")]
    marks = materialize(marks, "marks")
    while not marks.isEmpty():
        open_ = marks.where("not unique").select("seq", "mark")
        first = marks.groupBy("mark").agg(F.min(F.struct("seq", "unique")).alias("first")).select("mark", "first.*").withColumnsRenamed({"seq": "ahead", "unique": "settled"})
        like = open_.join(near, "mark").select("seq", F.col("other").alias("mark"))
        before = open_.union(like).join(first, "mark").where("ahead < seq").groupBy("seq").agg(F.max("settled").alias("lost"))
        told = open_.select("seq").distinct().join(before, "seq", "left")
        told = materialize(told.select("seq", F.col("lost").isNull().alias("free"), F.coalesce("lost", F.lit(False)).alias("lost")), "told")
        done.append(told.where("free").select("seq"))
        left = marks.join(told.where("lost").select("seq"), "seq", "left_anti").join(told.where("free").select("seq", F.lit(True).alias("now")), "seq", "left")
        left = materialize(left.select("seq", "mark", (F.col("unique") | F.coalesce("now", F.lit(False))).alias("unique")), "left")
        waiting = left.where("not unique").select("mark").distinct()
        wanted = waiting.union(waiting.join(near, "mark").select("other")).distinct()
        marks = materialize(left.join(wanted, "mark", "left_semi").select("seq", "mark", "unique"), "marks")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _explained(rows: DataFrame, unique: DataFrame, edges: DataFrame, keys: DataFrame, places: DataFrame, batch: int) -> DataFrame:
    """rows with unique, duplicate_of, reason and similarity: the owner of the first key that has one, else the
    likest title, of several the earliest. keys and places hold one row for each key and signature."""
    ahead = (F.col("o.batch") < batch) | (F.col("o.seq") < F.col("r.seq"))
    lost = materialize(rows.join(unique.select("seq"), "seq", "left_anti").select("seq", "keys", "sig"), "lost")
    exact = lost.select("seq", F.posexplode("keys").alias("pos", "key")).alias("r").join(keys.alias("o"), "key").where(ahead)
    exact = exact.groupBy("r.seq").agg(F.min(F.struct("pos", F.col("o.id").alias("of"))).alias("x")).select("seq", F.col("x.of").alias("exact_of"))
    alike = edges.select("a", "b", "similarity").unionByName(lost.where("sig is not null").select(F.col("sig").alias("a"), F.col("sig").alias("b"), F.lit(1.0).alias("similarity")).distinct())
    met = lost.select("seq", F.col("sig").alias("a")).join(alike, "a").withColumnRenamed("b", "sig").alias("r").join(places.alias("o"), "sig").where(ahead)
    fuzzy = met.groupBy("r.seq").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("o.batch").alias("b"), F.col("o.seq").alias("q"), F.col("o.id").alias("of"))).alias("f")).select("seq", F.col("f.of").alias("fuzzy_of"), (-F.col("f.s")).alias("near"))
    told = rows.select("id", "seq").join(unique.select("seq", F.lit(True).alias("kept")), "seq", "left").join(exact, "seq", "left").join(fuzzy, "seq", "left")
    has = F.col("exact_of").isNotNull()
    reason = F.when(has, "exact").when(F.col("fuzzy_of").isNotNull(), "fuzzy_title")
    return told.select("id", "seq", F.coalesce("kept", F.lit(False)).alias("unique"), F.coalesce("exact_of", "fuzzy_of").alias("duplicate_of"), reason.alias("reason"), F.when(has, 1.0).otherwise(F.col("near")).alias("similarity"))
