"""Text expressions: normal forms, tokens, keys, similarity hashes.

``(?U)`` makes Java's classes Unicode-aware. Built-in functions do all but NFKC with case folding and BLAKE2b,
which have Arrow UDFs; ``plain_normalise`` is the built-in form for text that needs neither.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

_WORD = r"(?U)(\w+)"
#: Query parameters that only track (fixed values).
TRACKING = ("ref", "source", "fbclid", "gclid")
#: Prefixes of a DOI (fixed values).
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:")


@F.pandas_udf(StringType())
def nfkc_casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else s.lower() if s.isascii() else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(ArrayType(StringType()))
def folded_all(x: pd.Series) -> pd.Series:
    """nfkc_casefold of an array's texts."""
    return x.map(lambda found: None if found is None else [None if s is None else unicodedata.normalize("NFKC", s).casefold() for s in found])


@F.pandas_udf(ArrayType(LongType()))
def blake2b_longs(x: pd.Series) -> pd.Series:
    """8-byte BLAKE2b digests of tokens, as signed longs."""
    return x.map(lambda tokens: None if tokens is None else [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True) for t in tokens])


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(_WORD), 1)


def _normal(x: Column) -> Column:
    return F.array_join(tokens(F.translate(x, "-_", "  ")), " ")


def folded(x: Column) -> Column:
    """NFKC with case folding. ASCII text is lowered by the JVM: Python is sent a null in its place."""
    ascii_ = F.octet_length(x) == F.char_length(x)
    return F.when(ascii_, F.lower(x)).otherwise(nfkc_casefold(F.when(~ascii_, x)))


def normalise(x: Column) -> Column:
    return _normal(folded(x))


def plain_normalise(x: Column) -> Column:
    return _normal(F.lower(x))


def token_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalise(x), " "), lambda t: t != ""))


def content_hash(title: Column, body: Column) -> Column:
    """Of the parts that aren't empty; null where the normal form is."""
    normal = normalise(F.array_join(F.array_compact(F.array(F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))), " "))
    return F.when(normal != "", F.sha2(normal, 256))


def collapse(x: Column) -> Column:
    """Lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def normalise_url(url: Column) -> Column:
    """Scheme and host in lower case, without trailing slash, fragment and tracking parameters; what is no URL
    is lower-cased."""
    url = F.trim(url)
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda i: F.regexp_extract(url, whole, i)
    pairs = F.filter(F.split(F.substring(part(4), F.lit(2), F.length(part(4))), "&"), lambda p: ~(F.lower(p).rlike("^utm_") | F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)) & (p != ""))
    query = F.array_join(pairs, "&")
    clean = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(whole), clean).otherwise(F.regexp_replace(F.lower(url), "/+$", ""))


def normalise_doi(x: Column) -> Column:
    """The DOI in lower case, or null where there is none."""
    low = F.lower(F.trim(x))
    for prefix in DOI_PREFIXES:
        low = F.when(low.startswith(prefix), F.substring(low, F.lit(len(prefix) + 1), F.length(low))).otherwise(low)
    low = F.regexp_replace(low, r"[/ .]+$", "")
    return F.when(low.rlike(r"^10\..*/"), low)


def actor_keys(actors: Column) -> Column:
    """id:<external id> or name:<normal name> of array<struct<name, external_id>>."""
    ids, names = (folded_all(F.transform(actors, f)) for f in (lambda a: F.trim(a["external_id"]), lambda a: a["name"]))
    key = lambda i, n: F.when(i != "", F.concat(F.lit("id:"), i)).when(F.trim(n) != "", F.concat(F.lit("name:"), _normal(n)))
    return F.array_distinct(F.array_compact(F.zip_with(ids, names, key)))


def state_actor_keys(actors: Column) -> Column:
    """The same with the actor's kind, and names with single spaces."""
    key = lambda a: F.concat(a["kind"], F.when(F.nullif(F.trim(a["external_id"]), F.lit("")).isNotNull(), F.concat(F.lit(":id:"), F.trim(a["external_id"]))).otherwise(F.concat(F.lit(":name:"), collapse(a["name"]))))
    return F.array_distinct(F.array_compact(F.transform(actors, key)))


@F.pandas_udf(LongType())
def _majority(x: pd.Series) -> pd.Series:
    out, told = np.zeros(len(x), np.int64), [i for i, h in enumerate(x) if h is not None and len(h)]
    if told:
        sizes = np.array([len(x.iloc[i]) for i in told])
        bits = np.unpackbits(np.concatenate([x.iloc[i] for i in told]).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int32)
        out[told] = np.packbits(2 * ones >= sizes[:, None], axis=1).view(">i8").ravel()
    return pd.Series(out)


def simhash(hashes: Column) -> Column:
    """64 bits, as a long: a bit is set where at least half of the hashes have it; 0 for no hashes."""
    return F.when(hashes.isNotNull(), _majority(hashes))


def md5_longs(x: Column) -> Column:
    """The first 60 bits of each token's MD5: hashes that any SQL engine can make."""
    return F.transform(x, lambda t: F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; two empty ones are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def disjoint(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) == 0


def key_terms(x: Column, generic: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of three characters or more, hyphens trimmed, without generic ones."""
    found = F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)([\w-]+)"), 1), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*(generic or ("",)))))


def normalise_phrase(x: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)([\w-]+)"), 1), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    return F.array_join(found, " ")


def segments(title: Column, body: Column) -> Column:
    """Lines cut at sentence ends before a capital, bullets stripped, the title first if no segment equals it."""
    source = F.when(F.coalesce(body, F.lit("")) == "", title).otherwise(body)
    parts = F.flatten(F.transform(F.split(source, r"\r\n|\r|\n"), lambda line: F.split(line, r"(?<=[.!?])\s+(?=[A-Z])")))
    parts = F.transform(F.filter(parts, lambda s: F.trim(s) != ""), lambda s: F.regexp_replace(s, r"^[ *\t\r\n-]+|[ *\t\r\n-]+$", ""))
    head = F.trim(title)
    return F.when((head != "") & ~F.array_contains(parts, head), F.concat(F.array(head), parts)).otherwise(parts)


def first_line(x: Column) -> Column:
    return F.trim(F.substring_index(x, "\n", 1))


def resolved_simhash(stored: Column, title: Column) -> Column:
    """The stored hash where it is up to 16 hexadecimal digits, else that of the title's tokens."""
    digits = F.regexp_extract(F.trim(stored), "^(?:0[xX])?([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, -10).cast("long")).otherwise(simhash(blake2b_longs(token_set(title))))
