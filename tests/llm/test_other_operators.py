"""Media, language, mixing, quality, PII and the pipeline."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import gif, language, mixing, pii, quality, queries

DATA = "/root/testdata/sf0.001"

# --- GIF


def test_lzw_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 300, 5000, 60000):
        for size, top in ((8, 256), (2, 4), (4, 16), (8, 3)):
            data = rng.integers(0, top, n).astype(np.uint8).tobytes()
            assert gif.lzw_decode(gif.lzw_encode(data, size), size, n) == data
    with pytest.raises(gif.GifError):
        gif.lzw_decode(b"\xff\xff", 8, 10)


def test_disposal_transparency_and_palettes():
    red, blue = np.array([[255, 0, 0], [0, 255, 0]], np.uint8), np.array([[0, 0, 255], [9, 9, 9]], np.uint8)
    a = {"pixels": np.zeros((2, 2), np.uint8), "delay_cs": 5, "disposal": 1}
    b = {"pixels": np.array([[0, 1]], np.uint8), "top": 1, "transparent": 1, "palette": blue, "disposal": 3, "delay_cs": 7}
    c = {"pixels": np.ones((1, 1), np.uint8), "disposal": 2}
    d = {"pixels": np.ones((1, 1), np.uint8), "left": 1}
    f = list(gif.decode_gif(gif.encode_gif([a, b, c, d], red, loop=0)))
    assert [x["delay_cs"] for x in f] == [5, 7, 0, 0]
    assert f[1]["rgba"][1].tolist() == [[0, 0, 255, 255], [255, 0, 0, 255]]
    assert f[2]["rgba"][1, 0].tolist() == [255, 0, 0, 255] and f[2]["rgba"][0, 0].tolist() == [0, 255, 0, 255]
    assert f[3]["rgba"][0].tolist() == [[0, 0, 0, 0], [0, 255, 0, 255]]


def test_frames_table(spark):
    good = gif.encode_gif([{"pixels": np.full((4, 3), 255, np.uint8), "delay_cs": 10}, {"pixels": np.zeros((4, 3), np.uint8), "delay_cs": 3}])
    df = spark.createDataFrame([(1, bytearray(good), "x"), (2, None, "x"), (3, bytearray(b"no gif"), "x"), (4, bytearray(good[:-20]), "x")], "id int, gif binary, rgba string")
    got = [(r.id, r.frame_index, r.start_ms, r.delay_ms, r.error) for r in gif.gif_frames(df).orderBy("id", "frame_index").collect()]
    assert got[:3] == [(1, 0, 0, 100, None), (1, 1, 100, 30, None), (2, -1, 0, 0, "null")]
    assert got[3][4] == "no GIF signature" and any(g[0] == 4 and g[4] for g in got)
    first = gif.gif_frames(df).where("id = 1 and frame_index = 0").collect()[0]
    assert sum(first.histogram) == 12 and first.histogram[63] == 12


def test_media_digest(make):
    rows = [(1, None), (2, ""), (3, "ä" * 96), (4, "x" * 30_000), (5, "ä" * 96)]
    for r in gif.media_digest(make(rows)).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = gif.store_payload(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


# --- language


def test_language_accuracy_on_held_out_rows(spark, small):
    df, _ = small
    got = language.language_predictions(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_language_edges(make):
    df = make([(1, None), (2, ""), (3, "12 34 !!"), (4, "plain words"), (4, "plain words")])
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(df, language.train(df)).orderBy("doc_id").collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and got[3] == got[4] == (4, "en", 1.0)
    assert {r.lang_pred for r in language.identify(df, language.train(df.where("doc_id < 3"))).collect()} == {"und"}
    assert language.language_predictions(make([])).count() == 0


def test_pair_tables_equal_the_convolution():
    net = language.ByteConvNet(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    slow = net._softmax(np.concatenate([v.max(axis=1) for v in net._convolve(x)], axis=1))
    assert np.allclose(slow, net.probabilities(x), atol=1e-5)


# --- mixing


def test_mix_equals_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert sorted(map(tuple, queries.op8_mixing(spark, DATA).collect())) == sorted(c.execute(mixing.mix_sql()).fetchall())


def test_mix_edges(spark):
    shape = "doc_id long, text string, source string, size string, other int"
    rows = [(1, "a b c d", "x", "?", 1), (2, None, "x", "?", 1), (3, "e f", None, "?", 1), (4, "", "empty", "?", 1), (5, "g " * 50, "y", "?", 1), (5, "g " * 50, "y", "?", 1)]
    got = mixing.mix(spark.createDataFrame(rows, shape)).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    for mine in by.values():
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1.5 and mine[0].target <= 2 * mine[0].source_size
    assert sum(m[0].target for m in by.values()) == pytest.approx(1.5 * 106)
    assert mixing.mix(spark.createDataFrame([], shape)).count() == 0
    one = mixing.mix(spark.createDataFrame(rows[:1], shape))
    assert [r.taken for r in one.collect()] == [6]
    assert sorted(r.text for r in mixing.copies(one, ["doc_id", "text", "source"]).collect()) == ["a b", "a b c d"]


def test_join_of_many_sources_agrees(spark, monkeypatch):
    shape = "doc_id long, text string, source string"
    df = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 40}") for i in range(400)], shape)
    few = sorted(map(tuple, mixing.mix(df).select("doc_id", "taken", "target").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(df).select("doc_id", "taken", "target").collect())) == few


# --- quality


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


def test_quality_edges(spark, make):
    labels = spark.createDataFrame([(d, d % 2, None) for d in range(1, 30)] + [(3, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    docs = make([(d, "good plain words here" if d % 2 else "BAD!! BAD!! BAD!!") for d in range(1, 30)] + [(40, None), (41, "")])
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[40].score == got[41].score and 0 <= got[40].score <= 1
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert quality.quality_scores(make([]), labels).count() == 0


# --- PII


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms_keep_formats_and_links(make):
    rows = [
        (1, "card 4337166598464399, again 4337-1665-9846-4399; not 4337166598464390"), (2, "ip 42.144.35.254, no 999.1.1.1"), (3, "+1 (988) 555-2485 or 415-555-2671"),
        (4, "DE89 3704 0044 0532 0130 00"), (5, "1987-03-12 12/25/1999 05.11.1975 2023-02-30"), (6, "ssn 123-45-6789 000-12-1234"), (7, "Ann.b42@mail8.example.com ann@x.org"), (8, None), (9, ""), (10, "card 4337166598464399"),
    ]
    got = {r.doc_id: r for r in pii.pii_digest(make(rows), "k").collect()}
    text = {d: r.text for d, r in got.items()}
    a, b, c = re.search(r"card (\d{16}), again (\S+); not (\d+)", text[1]).groups()
    assert a == b.replace("-", "") and luhn(a) and a != "4337166598464399" and c == "4337166598464390" and text[10] == f"card {a}"
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3}, no 999\.1\.1\.1", text[2]) and "42.144" not in text[2]
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or [2-9]\d\d-[2-9]\d\d-\d{4}", text[3]) and "555" not in text[3]
    iban = text[4].replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1 and text[4] != rows[3][1]
    assert text[5].endswith(" 2023-02-30") and got[5].n_date == 3 and re.fullmatch(r"\d{4}-\d\d-\d\d \d\d/\d\d/\d{4} \d\d\.\d\d\.\d{4} 2023-02-30", text[5])
    assert text[6].endswith(" 000-12-1234") and got[6].n_ssn == 1
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[a-z]\d{2}@mail8\.example\.com [a-z]{3}@x\.org", text[7]) and got[7].n_email == 2
    assert (text[8], got[8].n_found, text[9], got[9].n_found) == (None, 0, "", 0)
    assert pii.pii_digest(make([]), "k").count() == 0


def test_feistel_is_a_permutation_and_can_be_undone(spark):
    df = spark.range(7 * 11).select((F.col("id") % 7).alias("a"), F.floor(F.col("id") / 7).alias("b"))
    there = df.select("a", "b", pii.feistel("k", "t", F.col("a"), F.col("b"), 7, 11).alias("s"))
    back = there.select("a", "b", "s", pii.feistel("k", "t", F.col("s.a"), F.col("s.b"), 7, 11, undo=True).alias("u")).collect()
    assert len({(r.s.a, r.s.b) for r in back}) == 77 and all((r.u.a, r.u.b) == (r.a, r.b) for r in back)
    assert all(0 <= r.s.a < 7 and 0 <= r.s.b < 11 for r in back)


def test_clean_documents_stay_and_no_python_runs(small):
    df, _ = small
    out = pii.pseudonymise(df, "k")
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    both = out.select("doc_id", F.col("text").alias("new"), *[f"n_{k}" for k in pii.KINDS]).join(df, "doc_id").collect()
    for r in both:
        found = sum(r[f"n_{k}"] for k in pii.KINDS)
        assert (r.new == r.text) == (found == 0) and len(r.new) >= len(r.text) - 12 * found


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline
    from trendloom.llm.common import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "1234", "en", "src0", 4)], docs.schema)
    columns, docs = docs.columns, docs.union(extra)
    n = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), name, keep=True)
        assert docs.columns == columns
        n[name] = docs.count()
        assert docs.where("doc_id > 9000").count() == 0
    assert n["language_id"] == 200 and n["near_duplicates"] <= n["line_dedup"] <= 200
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= n["mixing"]


def test_registered_queries_have_the_contract_columns(spark):
    want = {"op1_": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op4_": {"doc_id", "n_shingles", "component_id"}, "op6_": {"doc_id", "held_out", "lang_pred", "score"}, "op9_": {"doc_id", "held_out", "score", "predicted"}}
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))
    for prefix, columns in want.items():
        name = next(n for n in found if n.startswith(prefix))
        assert columns <= set(found[name](spark, DATA).columns)


def test_pii_beside_other_numbers_and_words(make):
    texts = [
        "4111 1111 1111 1111 12/25", "4111111111111111 123", "no 12 4111-1111-1111-1111", "BE68 5390 0754 7034 EUR 5",
        "AT61 1904 3002 3457 3201 FROM ME", "BE68 5390 0754 7034 BE68 5390 0754 7034", "PL61 1090 1014 0000 0712 1981 2874 PLN",
    ]
    rows = {r.doc_id: r for r in pii.pii_digest(make(list(enumerate(texts))), "k").collect()}
    assert [(rows[i].n_card, rows[i].n_iban) for i in range(7)] == [(1, 0)] * 3 + [(0, 1)] * 2 + [(0, 2), (0, 1)]
    for i, (start, end) in enumerate([("", " 12/25"), ("", " 123"), ("no 12 ", ""), ("BE", " EUR 5"), ("AT", " FROM ME"), ("BE", ""), ("PL", " PLN")]):
        new = rows[i].text
        assert new.startswith(start) and new.endswith(end) and len(new) == len(texts[i]) and new != texts[i]
    assert "4111 1111" not in rows[0].text and rows[5].text[:19] == rows[5].text[20:] == rows[3].text[:19]


def test_pipeline_keeps_one_row_of_each(spark, make):
    import corpus_pipeline

    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    near = texts[2] + " more"
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (2, texts[0]), (None, texts[2]), (None, near), (None, texts[3]), (3, texts[3]), (4, ""), (4, ""), (5, None)]
    left = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, make(rows), "").collect()]
    ours = [x for x in left if x[1] in (texts[2], near)]
    assert len(ours) == 1 and ours[0][0] is None
    assert sorted(map(repr, (x for x in left if x not in ours))) == sorted(map(repr, [(1, texts[0]), (2, texts[1]), (3, texts[3]), (4, ""), (4, ""), (5, None)]))


def test_pii_replaces_all_of_a_long_local_part(make):
    locals_ = ["abcdefghijklmnopqrstuvwxyz" + end for end in ("", "confiden", "secretly", "Ab.19_c" * 5)]
    new = {r.doc_id: r.text for r in pii.pii_digest(make([(i, x + "@example.org") for i, x in enumerate(locals_)]), "k").collect()}
    for i, x in enumerate(locals_):
        local, host = new[i].split("@")
        assert host == "example.org" and re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", local))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", x)))
        assert local[:26] != x[:26] and (len(x) == 26 or local[26:] != x[26:])
    assert len(set(new.values())) == 4


def test_pseudonyms_of_all_kinds_are_one_to_one(spark, make):
    """Values of all classes of a kind together: pseudonyms differ as the values do, and have their form."""
    rng = np.random.default_rng(8)
    ten = [f"{a}{b:02d}-{c}{d:02d}-{e:04d}" for a in range(10) for c in range(10) for b, d, e in rng.integers(0, [100, 100, 10_000], (12, 3)).tolist()]
    phones = sorted({"124-400-0037", "548-843-5924", *ten})
    ips = sorted({f"{a}.{b}.{c}.{d}" for a in (0, 1, 9, 127, 223, 224, 255) for b, c, d in rng.integers(0, 256, (60, 3)).tolist()})
    ssns = sorted({f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 2, 664, 665, 667, 668, 899) for b, c in rng.integers(1, [100, 10_000], (60, 2)).tolist()})
    dates = sorted({f"{y}-{m:02d}-{d:02d}" for y in (1951, 1999, 2000, 2023, 2024) for m in (1, 2, 12) for d in range(1, 29)} | {"2000-02-29", "2024-02-29"})
    shape = lambda x: re.sub("[0-9]", "9", x)
    for kind, values in (("phone", phones), ("ip", ips), ("ssn", ssns), ("date", dates)):
        done = pii.pii_digest(make(list(enumerate(values))), "k").collect()
        new = {r.doc_id: r.text for r in done}
        assert {r[f"n_{kind}"] for r in done} == {1}, kind
        assert len(set(new.values())) == len(values), kind
        if kind != "ip":
            assert all(shape(new[i]) == shape(x) for i, x in enumerate(values))
    planned = lambda x: x[0] in "23456789" and x[4] in "23456789"
    got = {r.doc_id: r.text for r in pii.pii_digest(make(list(enumerate(phones))), "k").collect()}
    assert all(planned(got[i]) == planned(x) for i, x in enumerate(phones))


def test_pii_keeps_extra_columns_and_repeated_rows(make):
    df = make([(1, "call 548-843-5924"), (1, "call 548-843-5924"), (2, None)]).withColumn("findings_", F.lit(7)).withColumn("note", F.col("doc_id"))
    out = pii.pseudonymise(df, "k").collect()
    assert len(out) == 3 and {r["findings_"] for r in out} == {7} and all(r.note == r.doc_id for r in out)
    assert len({r.text for r in out if r.doc_id == 1}) == 1 and [r.text for r in out if r.doc_id == 2] == [None]


def test_pipeline_keeps_clashing_columns(spark, make):
    import corpus_pipeline

    names = ["gone_", "row_", "copy_", "nth_", "score", "lang_pred", "n_lines", "n_removed", "size", "target", "taken", "source_size"]
    texts = [" ".join(f"{c}word{i}" for i in range(60)) for c in "abcd"]
    docs = make([(i, texts[i % 4]) for i in range(8)]).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "language_id":
            continue  # it is trained on labels, of which these rows have one value
        out = stage(spark, docs, "")
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name
        assert out.columns == docs.columns
