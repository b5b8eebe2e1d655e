"""Benchmark decontamination by winnowing.

Words are hashed, five consecutive words make a gram, and every span of ten words is represented by the least hash
among its six grams: two equal spans always have equal fingerprints, so no shared span of ten words is missed. The
fingerprints of the test items fill a bitmap of a fixed size, which every task gets; spans of documents whose
fingerprint is in it are extended to all their words, by a hash of the whole span, and joined with the items' spans on
both. An item of fewer than ten words is one span of its own length. Texts that are equal are joined once, and spans of
items with the same set of items are one class, so copies on either side multiply nothing.

Defined results: a null or empty text, or one without a word, has no words, no hits and no items; an item without words
takes no part; rows with equal doc_id stay rows of their own; repeated items count once by item_id, a null one as an
empty text; empty tables give no rows or no hits; other columns of documents are kept by ``decontaminated``, whatever their
names. Equality is by two hashes of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.common import PrefixHash, documents, groups_of, lower_ascii, materialize, mix64, powers, small_batches, unique_name

SPAN, GRAM = 10, 5
#: Words, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the fingerprints' bitmap (2 MB, at most 2^18 rows to the driver), bytes hashed and words windowed at once.
SLOT_BITS, BYTES, WORDS = 24, 1 << 20, 1 << 19

_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_BASE = np.uint64(0x9FB21C651E98DF25)
_BASE_INV = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


def _pieces(inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BYTES bytes that cut no word; a longer word is a range of its own."""
    a, n = 0, len(inside)
    while a < n:
        b = min(a + BYTES, n)
        if b < n:
            gaps = np.flatnonzero(~inside[a:b])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                while b < n and inside[b]:
                    ahead = np.flatnonzero(~inside[b : b + BYTES])
                    b = b + int(ahead[0]) if len(ahead) else min(b + BYTES, n)
        yield a, b
        a = b


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data begins, and its hash."""
    low = lower_ascii(np.frombuffer(data, np.uint8))
    inside = _IN_WORD[low]
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in _pieces(inside):
        edge = np.zeros(b - a + 2, bool)
        edge[1:-1] = inside[a:b]
        turn = np.flatnonzero(edge[1:] != edge[:-1])
        starts.append(turn[::2] + a)
        hashes.append(PrefixHash(low[a:b]).of(turn[::2], turn[1::2]))
    return np.concatenate(starts), np.concatenate(hashes)


class _Spans:
    """Fingerprints and hashes of the spans of a run of words."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(len(words), _BASE), out=self.sums[1:])
        self.inverse = powers(len(words) + 1, _BASE_INV)

    def whole(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on."""
        x = self.sums[n:] - self.sums[:-n]
        x *= self.inverse[:-n]
        x ^= np.uint64(n * 0xA0761D6478BD642F & (1 << 64) - 1)
        return mix64(x)

    def prints(self, n: int) -> np.ndarray:
        """The least gram of each span of n words, told apart by n."""
        least = self.whole(min(GRAM, n))
        for _ in range(n - min(GRAM, n)):
            least = np.minimum(least[1:], least[:-1])
        return mix64(least ^ np.uint64(n))


def spans_of(words: np.ndarray, owner: np.ndarray, n: int, seen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Place, fingerprint and hash of the spans of n words that have one owner; with a bitmap, of those in it."""
    for a in range(0, max(0, len(words) - n + 1), WORDS):
        part, own = words[a : a + WORDS + n - 1], owner[a : a + WORDS + n - 1]
        spans = _Spans(part)
        prints = spans.prints(n)
        ok = own[n - 1 :] == own[: len(own) - n + 1]
        if seen is not None:
            slot = prints >> np.uint64(64 - SLOT_BITS)
            ok &= (seen[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        at = np.flatnonzero(ok)
        if len(at):
            yield at + a, prints[at].view(np.int64), spans.whole(n)[at].view(np.int64)


def item_spans(items: DataFrame, id_col: str = "item_id", span: int = SPAN) -> DataFrame:
    """(item, n, print, whole) of each span of each item: n is span, or the item's length where that is less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = hashed_words((text or "").encode())[1]
                n = min(span, len(words))
                if n:
                    for at, prints, whole in spans_of(words, np.zeros(len(words), np.int8), n):
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(at), pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(prints), pa.array(whole)], ["item", "n", "print", "whole"])

    small_batches(items.sparkSession)
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "text")
    return rows.mapInArrow(run, "item string, n int, print long, whole long")


def bitmap(spans: DataFrame) -> np.ndarray:
    """2^SLOT_BITS bits, those of the fingerprints set; at most 2^SLOT_BITS / 64 rows reach the driver."""
    slot = F.shiftrightunsigned("print", 64 - SLOT_BITS)
    bits = spans.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("bits")).toArrow()
    seen = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    seen[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()
    return seen.view(np.uint64)


_HITS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("print", pa.int64()), ("whole", pa.int64())]))


def candidates(docs: DataFrame, seen: np.ndarray, lengths: list[int]) -> DataFrame:
    """row_ (a column of docs), n_words, sign (of texts with candidates alone) and hits: the spans, of the
    given lengths, whose fingerprint is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in groups_of([len(x or b"") for x in texts], BYTES):
                group = [x or b"" for x in texts[a:b]]
                size = np.array([len(x) + 1 for x in group])
                starts, words = hashed_words(b"\n".join(group))
                owner = np.searchsorted(np.cumsum(size), starts, side="right").astype(np.int32)
                counts = np.bincount(owner, minlength=len(group))
                first = np.cumsum(counts) - counts
                found = [(at, np.full(len(at), n, np.int32), p, w) for n in lengths for at, p, w in spans_of(words, owner, n, seen)]
                if found:
                    at, n, prints, whole = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.argsort(owner[at], kind="stable")
                    at, n, prints, whole = at[order], n[order], prints[order], whole[order]
                    held = np.bincount(owner[at], minlength=len(group))
                    values = pa.StructArray.from_arrays([pa.array((at - first[owner[at]]).astype(np.int32)), pa.array(n), pa.array(prints), pa.array(whole)], fields=list(_HITS.value_type))
                else:
                    held, values = np.zeros(len(group), np.int64), pa.array([], _HITS.value_type)
                hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), values)
                signs = [hashlib.md5(x, usedforsecurity=False).digest() if k else None for x, k in zip(group, held.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(signs, pa.binary()), hits], ["row_", "n_words", "sign", "hits"])

    small_batches(docs.sparkSession)
    kind = docs.schema["row_"].dataType.simpleString()
    return docs.select("row_", "text").mapInArrow(run, f"row_ {kind}, n_words long, sign binary, hits array<struct<at:int,n:int,print:long,whole:long>>")


def hit_spans(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(sign, at, n, class) of the candidates that are spans of items; equal texts give them once."""
    each = found.where("sign is not null").select("sign", F.explode("hits").alias("h")).select("sign", "h.*").distinct()
    return each.join(classes, ["n", "print", "whole"]).select("sign", "at", "n", "class")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", span: int = SPAN) -> DataFrame:
    """(key, n_words, n_hit, spans, items) of each row of docs: the words inside any span that an item has, the maximal
    runs of them as (begin, end) in words, and the ids of these items, sorted as text."""
    own = materialize(item_spans(items, item_key, span), "item-spans")
    lengths = sorted(r.n for r in own.select("n").distinct().collect())
    found = materialize(candidates(docs.withColumn("row_", F.col(key)).select("row_", "text"), bitmap(own), lengths), "candidates")
    sets = own.groupBy("n", "print", "whole").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    sets = materialize(sets.withColumn("class", F.md5(F.to_json("ids"))), "item-sets")
    met = materialize(hit_spans(found, sets.select("n", "print", "whole", "class")), "hits")

    in_order = Window.partitionBy("sign").orderBy("at", F.desc("n"))
    reach = F.coalesce(F.max(F.col("at") + F.col("n")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = met.select("sign", "at", "n").distinct().withColumn("reach", reach).withColumn("run", F.sum((F.col("at") > F.col("reach")).cast("int")).over(in_order))
    merged = runs.groupBy("sign", "run").agg(F.min("at").alias("begin"), F.max(F.col("at") + F.col("n")).alias("end"))
    merged = merged.groupBy("sign").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))

    ids = sets.select("class", "ids").dropDuplicates(["class"])
    named = met.select("sign", "class").distinct().join(ids, "class").groupBy("sign").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    by_text = merged.join(named, "sign")

    base = found.select(F.col("row_").alias(key), "n_words", "sign")
    hit = base.where("sign is not null").join(by_text, "sign", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = {"spans": by_text.schema["spans"].dataType, "items": by_text.schema["items"].dataType}
    both = hit.unionByName(base.where("sign is null"), allowMissingColumns=True)
    return both.select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *(none(F.col(c), k).alias(c) for c, k in kinds.items()))


def decontaminated(docs: DataFrame, items: DataFrame, item_key: str = "item_id", span: int = SPAN) -> DataFrame:
    """The rows of docs, whatever their columns, without those that have a hit. Rows of equal text go or stay together."""
    sign = unique_name(docs.columns, "sign_")
    keyed = docs.withColumn(sign, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    hit = contamination(keyed.select(F.col(sign).alias("sign_key"), "text"), items, "sign_key", item_key, span).where("n_hit > 0").select(F.col("sign_key").alias(sign)).distinct()
    return keyed.join(hit, sign, "left_anti").select(docs.columns)


def contamination_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def contamination_sql() -> str:
    """DuckDB's SQL for the digest: all spans of all lengths as text, joined with the items' spans."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    frame = "over (partition by r order by i rows between current row and {} following)"
    grams = " union all ".join(f"select r, i, {m} as m, string_agg(w, ' ') {frame.format(m - 1)} as k, count(*) {frame.format(m - 1)} as c from word where {m} in (select m from iw)" for m in range(1, SPAN + 1))
    return f"""
with d as materialized (select row_number() over () as r, doc_id, {words} as w from documents),
it as (select coalesce(item_id::varchar, '') as item, {words} as w from benchmark),
iw as materialized (select distinct item, least(len(w), {SPAN}) as m, array_to_string(w[s : s + least(len(w), {SPAN}) - 1], ' ') as k from it, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) t(s) where len(w) > 0),
word as materialized (select r, unnest(w) as w, generate_subscripts(w, 1) as i from d),
gram as ({grams}),
hit as materialized (select r, i, gram.m, item from gram join iw on gram.k = iw.k and gram.m = iw.m where c = gram.m),
covered as (select r, count(distinct i + j) as n from hit, unnest(range(0, m)) t(j) group by r),
named as (select r, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by r)
select doc_id, len(w) as n_words, coalesce(covered.n, 0) as n_hit, coalesce(named.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, covered.n is not null as contaminated
from d left join covered on d.r = covered.r left join named on d.r = named.r"""
