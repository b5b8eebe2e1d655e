"""Operators against plain versions that share no code with them."""

import hashlib
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import gif, language, lz, mixing, packing, pii, quality

# --- Lempel-Ziv phrases


def plain_phrases(text):
    """Phrases of an LZ78 parse: each is the shortest prefix of the rest that isn't in the dictionary yet."""
    known, out, at = set(), [], 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n] in known:
            n += 1
        known.add(text[at : at + n])
        out.append(text[at : at + n])
        at += n
    return out


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaaaa", "abababababababa", "to be or not to be, that is to be asked", "äöü日本語日本語𝔘𝔘𝔘" * 5])
def test_lz_parse_equals_a_plain_one(text):
    phrases, ends = plain_phrases(text), []
    if lz._parse(text, set(), "", ends, 0):
        ends.append(len(text))
    assert [text[a:b] for a, b in zip([0, *ends], ends)] == phrases
    # equal phrases have equal hashes, others don't, wherever they begin
    hashes = lz._phrase_hashes(text, ends) if ends else []
    assert len(set(map(int, hashes))) == len(set(phrases)) and len(hashes) == len(phrases)


def test_lz_fingerprint_is_the_minimum_of_each_bin(small):
    for _, text in small[1][:40]:
        ends = []
        if lz._parse(text or "", set(), "", ends, 0):
            ends.append(len(text))
        least = {}
        for h in map(int, lz._phrase_hashes(text, ends) if ends else []):
            bin_ = h >> 57
            least[bin_] = min(h, least.get(bin_, h))
        assert lz.fingerprint(text or "").tolist() == [(least[b] & 0xFFFF) % 65535 + 1 if b in least else 0 for b in range(128)]


# --- GIF


def plain_gif(data):
    """Frames (left, top, width, height, indices, palette) of a GIF without interlace, read bit by bit."""
    assert data[:6] in (b"GIF87a", b"GIF89a")
    at, flags, common = 13, data[10], None
    if flags & 128:
        n = 3 * 2 ** ((flags & 7) + 1)
        common, at = data[at : at + n], at + n
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        left, top, wide, tall, bits = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, palette = at + 10, common
        if bits & 128:
            n = 3 * 2 ** ((bits & 7) + 1)
            palette, at = data[at : at + n], at + n
        size, at, stream = data[at], at + 1, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        number, place = int.from_bytes(stream, "little"), 0
        clear, out = 1 << size, bytearray()
        table, width, last = {}, size + 1, None
        while True:
            code = number >> place & (1 << width) - 1
            place += width
            if code == clear:
                table, width, last = {i: bytes([i]) for i in range(clear)} | {clear: b"", clear + 1: b""}, size + 1, None
                continue
            if code == clear + 1:
                break
            entry = table[code] if code in table else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table[len(table)] = last + entry[:1]
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
        yield left, top, wide, tall, bytes(out), palette


@pytest.mark.parametrize("n", [1, 3, 64, 65, 200])
def test_stored_payload_is_read_by_another_reader(n):
    rng = np.random.default_rng(n)
    payload = (rng.integers(0, 256, n * 192) if n % 2 else rng.integers(97, 103, n * 192)).astype(np.uint8).tobytes()
    frames = list(plain_gif(gif.store_payload(payload)))
    assert b"".join(f[4] for f in frames) == payload and len(frames) == -(-n // 64)
    assert all(f[5] == bytes(x for i in range(256) for x in (i, i, i)) and len(f[4]) == f[2] * f[3] for f in frames)
    assert gif.read_payload(gif.store_payload(payload))[0] == payload


def test_media_digest_of_another_reader(make):
    rows = [(1, None), (2, ""), (3, "Aä" * 5000), (3, "x")]
    for r, (d, text) in zip(sorted(gif.media_digest(make(rows)).collect(), key=lambda r: (r.doc_id, -r.n_bytes)), rows, strict=True):
        raw = (text or "").encode()
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (d, len(raw), len(payload), hashlib.sha256(payload).hexdigest())


def test_header_of_a_huge_canvas_is_an_error(spark):
    head = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0)
    got = gif.gif_frames(spark.createDataFrame([(1, head + b"\x3b"), (2, None)], "id long, gif binary")).collect()
    assert {(r.id, r.frame_index, r.error) for r in got} == {(1, -1, "canvas too large"), (2, -1, "null")}


# --- language and quality


def test_network_equals_plain_loops():
    net = language.ByteConvNet(["x", "y", "z"], (2, 3, 4), 5)
    window = np.frombuffer(b"the quick brown fox jumps ov", np.uint8)
    pooled = []
    for w in net.widths:
        for f in range(net.filters):
            pooled.append(max(sum(net.tables[w][j][window[at + j], f] for j in range(w)) for at in range(len(window) - w + 1)))
    z = [sum(max(p, 0) * net.weight[i, k] for i, p in enumerate(pooled)) + net.bias[k] for k in range(3)]
    want = np.exp(z) / np.exp(z).sum()
    assert np.allclose(net.probabilities(window[None])[0], want, atol=1e-4)


def test_votes_equal_plain_nearest_neighbours():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.3, (60, quality.TERMS)).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    voter = quality.Voter(counts, labels, 8, 5)
    asked = rng.poisson(0.3, (7, quality.TERMS)).astype(np.float32)

    def place(row):
        x = row * voter.idf
        x = x / np.linalg.norm(x) @ voter.project
        return x / np.linalg.norm(x)

    base = [place(r) for r in counts]
    for row, score in zip(asked, voter.scores(asked), strict=True):
        near = sorted(((float(place(row) @ b), int(y)) for b, y in zip(base, labels, strict=True)), reverse=True)[:5]
        weight = [max(c, 0) ** 8 for c, _ in near]
        assert abs(score - sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight)) < 1e-3


# --- pseudonyms


def plain_feistel(key, tag, a, b, ma, mb):
    for i in range(8):
        mask = lambda half: int(hashlib.sha256(f"{key}:{tag}:{i}:{half}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            a = (a + mask(b) % ma) % ma
        else:
            b = (b + mask(a) % mb) % mb
    return a, b


def test_feistel_equals_a_plain_one(spark):
    df = spark.range(500).select((F.col("id") % 19).alias("a"), F.floor(F.col("id") / 19).alias("b"))
    for r in df.select("a", "b", pii.feistel("key", "tag", F.col("a"), F.col("b"), 19, 27).alias("s")).collect():
        assert (r.s.a, r.s.b) == plain_feistel("key", "tag", r.a, r.b, 19, 27)


def pseudonyms(spark, values, kind):
    rows = spark.createDataFrame([(x,) for x in values], "text string")
    got = pii.pseudonymise(rows.withColumn("raw", F.col("text")), "k").select("raw", "text", f"n_{kind}").collect()
    assert all(r[2] == 1 for r in got), [r for r in got if r[2] != 1][:3]
    return {r.raw: r.text for r in got}


def test_dates_are_permuted_among_those_written_alike(spark):
    values = set()
    for year in (1901, 1904, 1999, 2000, 2001, 2096, 2099):
        for m, n in enumerate((31, 29 if year % 4 == 0 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1):
            for d in range(1, n + 1):
                values |= {f"{year}-{m:02d}-{d:02d}"}
                values |= {f"{x}{s}{y}{s}{year}" for s, x, y in (("/", m, d), ("/", d, m), (".", d, m))}
                values |= {f"{x:02d}{s}{y:02d}{s}{year}" for s, x, y in (("/", m, d), ("/", d, m), (".", d, m))}
    new = pseudonyms(spark, sorted(values), "date")
    assert len(set(new.values())) == len(values)
    shape = lambda x: re.sub(r"\d", "9", x)
    assert all(shape(a) == shape(b) for a, b in new.items())
    # fresh ones are dates themselves, so that they are found again
    assert len(set(pseudonyms(spark, sorted(new.values()), "date").values())) == len(values)


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("ssn", [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 7, 665, 667, 899) for g in (1, 50, 99) for s in (1, 77, 9999)]),
        ("ip", [f"{a}.{b}.{c}.7" for a in (0, 1, 10, 127, 223, 224, 255) for b in (0, 9, 255) for c in (0, 1, 254)]),
        ("phone", [f"({a}) {b}-{c:04d}" for a in (201, 415, 989) for b in (200, 555, 999) for c in range(0, 9999, 777)]),
        ("email", [f"{a}{b}@example.org" for a in "abcxyzABC" for b in ("", "1", "99", ".x", "-long-name-that-goes-on-and-on-for-a-while")]),
    ],
)
def test_pseudonyms_differ_and_keep_their_form(spark, kind, values):
    new = pseudonyms(spark, values, kind)
    assert len(set(new.values())) == len(new) == len(set(values))
    shape = lambda x: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", x)))
    assert kind == "ip" or all(shape(a) == shape(b) for a, b in new.items())


def test_ibans_hide_their_bank_codes(spark):
    def iban(country, body):
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{98 - rest:02d}{body}"

    values = [iban("GB", f"{bank}{n:014d}") for bank in ("NWBK", "BARC", "LOYD") for n in range(0, 10**14, 10**13 + 7)]
    new = pseudonyms(spark, values, "iban")
    assert len(set(new.values())) == len(values) and not any(x[4:8] in ("NWBK", "BARC", "LOYD") for x in new.values())
    assert all(int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", x) for x in new.values())


# --- columns of any name


def test_mixing_and_packing_keep_clashing_columns(spark):
    rows = [(i, f"some words {i} " * (i % 5), f"s{i % 2}", i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, source_ int, KEY_ int, part_ int")
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "size", "source_size", "target", "taken"]
    assert all(r.source_ == r.KEY_ == r.part_ == r.doc_id and r.taken <= 2 * r.size for r in got.collect())
    plain = {r.doc_id: r.taken for r in mixing.mix(df.select("doc_id", "text", "source")).collect()}
    assert plain == {r.doc_id: r.taken for r in got.collect()}
    pieces = spark.createDataFrame([(i, 0, i, 100 + i, -i, -i) for i in range(50)], "doc_id long, start long, ids_crc32 long, length long, rank_ int, offset int")
    packed = packing.pack(pieces)
    assert packed.columns == ["doc_id", "start", "ids_crc32", "length", "rank_", "sequence_id", "offset", "sequence_length"]
    assert all(r.rank_ == -r.doc_id and r.offset >= 0 for r in packed.collect())
