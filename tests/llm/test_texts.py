"""Quality, secrets, media, WARC, URL filter."""

import gzip
import hashlib
import io
import math
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import media, mpeg_audio, quality, queries, secrets, url_filter, warc
from larkspur.llm.shingles import Spans, mix
from larkspur.llm.zip_archive import BytesSource, ZipArchive, write_stored
from tests.oracle import assert_same, connect

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op5_additive_ann", "op7_ngram_jaccard"}))
def test_same_rows_as_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


# -- quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op1_quality_nbsvm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((out.score >= 0) & (out.score <= 1)).all()
    assert (out.predicted == out.quality).mean() > 0.9


def test_quality_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, None), (3, ""), (None, "x"), (4, "bad " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, None), (None, 0), (9, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    empty = quality.fit(docs.limit(0), labels)
    assert quality.score(docs.limit(0), empty).count() == 0
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns


def test_labels_ids_and_sources_are_no_inputs():
    rows = quality.features(pa.array(["a b a", "a b a", None, ""]))
    assert (rows[0] == rows[1]).all() and (rows[2] == rows[3]).all()
    model = quality.fit_rows(rows[:2] + quality.features(pa.array(["c ## d"])), np.array([1, 1, 0]))
    s = model.scores(pa.array(["a b a", "c ## d"]))
    assert s[0] > s[1]


def plain_features(text: str) -> set[int]:
    """The indicators' places, one n-gram at a time."""
    one = lambda v: int(mix(np.array([v], dtype=np.uint64))[0])
    data, out = text.encode(), set()
    for k in (1, 2, 3):
        for i in range(len(data) - k + 1):
            out.add(one(int.from_bytes(data[i : i + k], "big") + (k << 32)) % (1 << 16))
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    hashed = [int(Spans(np.frombuffer(w, dtype=np.uint8), lower=False)(np.array([0]), np.array([len(w)]))[0]) for w in words]
    rest = (1 << 18) - (1 << 16) - (1 << 12)
    out |= {(1 << 16) + h % rest for h in hashed}
    out |= {(1 << 16) + one((a * 3 + b) % (1 << 64)) % rest for a, b in zip(hashed, hashed[1:])}
    for kind, count in ((1, sum(a == b for a, b in zip(words, words[1:]))), (2, sum(a == b == c for a, b, c in zip(words, words[1:], words[2:])))):
        out |= {(1 << 18) - 1 - one((kind << 12) + k) % (1 << 12) for k in range(1, 20) if count >= 2**k - 1}
    return out


def test_quality_against_plain_loops():
    """Features, ratios, descent and scores as loops over Python numbers."""
    rnd = np.random.default_rng(1)
    texts = [" ".join(rnd.choice(["good", "fine", "né", "text", "of", "words"] if i % 2 else ["##", "x1", "zz", "of", "!!"], 12)) for i in range(40)]
    y = [i % 2 for i in range(40)]
    rows = quality.features(pa.array(texts))
    for text, row in zip(texts, rows):
        assert plain_features(text) == set(row.tolist())
    counts = [{}, {}]
    for r, c in zip(rows, y):
        for f in r.tolist():
            counts[c][f] = counts[c].get(f, 0) + 1
    size = 1 << quality.BITS
    total = [size + sum(c.values()) for c in counts]
    ratio = lambda f: math.log((counts[1].get(f, 0) + 1) / total[1]) - math.log((counts[0].get(f, 0) + 1) / total[0])
    scaled = [{f: ratio(f) / len(r) ** quality.NORM for f in r.tolist()} for r in rows]
    w, b, alpha, rng = {}, 0.0, [0.0] * 40, np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for i in rng.permutation(40).tolist():
            sign = 1 if y[i] else -1
            gradient = sign * (sum(w.get(f, 0.0) * v for f, v in scaled[i].items()) + b) - 1
            new = min(max(alpha[i] - gradient / (1 + sum(v * v for v in scaled[i].values())), 0.0), quality.COST)
            step = (new - alpha[i]) * sign
            for f, v in scaled[i].items():
                w[f] = w.get(f, 0.0) + step * v
            b, alpha[i], moved = b + step, new, max(moved, abs(step))
        if moved < 1e-3 * quality.COST:
            break
    model = quality.fit_rows(rows, np.array(y))
    margins = [sum(w.get(f, 0.0) * ratio(f) for f in r.tolist()) / len(r) ** quality.NORM + b for r in rows]
    assert np.allclose(model.margins(pa.array(texts)), margins, atol=1e-4)
    expected = [1 / (1 + math.exp(-(model.slope * m + model.shift))) for m in margins]
    assert np.allclose(model.scores(pa.array(texts)), expected, atol=1e-4) and ((np.array(expected) > 0.5) == np.array(y)).all()


# -- secrets


def brute(t: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_base_spans_against_plain_patterns():
    rnd = np.random.default_rng(3)
    parts = ["password", "TOKEN", "secret", "api_key", "apikey", "Passwd", "=", ":", " ", '"', "'", "abc", "abcdef123", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef01234567", "é", "日", ".", "-", "\n", "ſecret", "to\u212aen"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts, rnd.integers(1, 14)))
        points = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80)))
        assert [(int(points[a]), k, int(points[b])) for a, k, b, _ in secrets.candidates(text.encode()) if k < 3] == brute(text)


def test_ownership(spark):
    copied, own = "0123456789abcdef01234567", "token = a1b2c3d4e5f6"
    random = "Zk3Qm9Xv7Lw2Rt8Yp4Hn6Jd1Bs5Gf"
    rows = [(i, f"x {copied}", f"o{i}", "r") for i in range(4)] + [(9, own, "o1", "r"), (9, own, "o1", "r"), (10, f"key {random} end", "o2", "r"), (11, None, None, None), (None, "", "o", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, repository string").withColumn("spans", F.lit("own"))
    out = secrets.scan(df).collect()
    assert len(out) == 9
    by = {r["doc_id"]: r for r in out}
    assert by[0]["n_copied"] == 1 and by[0]["n_live"] == 0 and by[0]["spans"] == "hex:2:26"
    assert by[9]["n_live"] == 1 and by[9]["n_assign"] == 1
    template = spark.createDataFrame([(i, own, "o1", f"r{i}") for i in range(5)], "doc_id long, text string, owner string, repository string")
    assert {(r["n_live"], r["n_copied"]) for r in secrets.scan(template).collect()} == {(0, 1)}
    assert {(r["n_live"], r["n_copied"]) for r in secrets.scan(template.limit(3)).collect()} == {(1, 0)}
    assert by[10]["spans"] == f"owned:4:{4 + len(random)}" and by[10]["base_sha256"] == by[11]["base_sha256"]
    assert secrets.scan(df.limit(0)).count() == 0


# -- media


def test_mpeg_round_trip_and_resync():
    for n in (0, 1, 576, 577, 5000, 200_000):
        text = bytes(np.random.default_rng(n).integers(1, 250, n, dtype=np.uint8))
        payload = mpeg_audio.padded(text)
        data = mpeg_audio.write(payload, n)
        s = mpeg_audio.scan(data)
        assert s.payload == payload and s.wrong == 0 and s.skipped == 0 and s.checked == len(payload) // 576
        assert s.table["frames"] == len(s.offsets) and s.tags["n_bytes"] == str(n)
        assert s.seconds[0] / s.seconds[1] == len(s.offsets) * 576 / 16000
        assert mpeg_audio.seek(s, s.samples - 1) == s.offsets[-1]
    frame = mpeg_audio._FRAME.size
    body = mpeg_audio.write(mpeg_audio.padded(b"x" * 5000), 5000)
    at = len(body) - 4 * frame
    torn = body[:at] + b"junk \xff\xf2\xd8 \xff\xff\xff" + b"\xff" * 300 + body[at:] + b"TAG" + b"title".ljust(125, b"\x00")
    s = mpeg_audio.scan(torn)
    assert s.payload == mpeg_audio.padded(b"x" * 5000) and s.skipped > 300 and s.tags["id3v1_title"] == "title"
    broken = bytearray(body)
    broken[at + 6] ^= 1
    assert mpeg_audio.scan(bytes(broken)).wrong == 1
    assert mpeg_audio.scan(b"").samples == 0 and mpeg_audio.scan(b"\xff" * 5000).samples == 0


def test_payload_that_looks_like_tags_or_tables():
    for word in (b"TAG", b"VBRI", b"Xing", b"Info", b"ID3\x03\x00\x00\x00\x00\x00\x10"):
        for place in range(0, 580, 1 if word in (b"TAG", b"VBRI") else 7):
            text = b"a" * place + word + b"b" * (700 if place % 2 else 0)
            s = mpeg_audio.scan(mpeg_audio.write(mpeg_audio.padded(text), len(text)))
            assert s.payload == mpeg_audio.padded(text) and s.skipped == 0 and s.wrong == 0, (word, place)


def test_known_header_and_crc():
    h = mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x00]), 0)
    assert (h.version, h.layer, h.bitrate, h.rate, h.size, h.samples) == (1, 3, 128, 44100, 417, 1152)
    assert mpeg_audio.header(bytes([0xFF, 0xFF, 0xFF, 0xFF]), 0) is None
    assert int(mpeg_audio.crc16(np.frombuffer(b"123456789", dtype=np.uint8)[None])[0]) == 0xAEE7  # CRC-16/CMS


def test_media_column(spark):
    df = spark.createDataFrame([(1, "héllo"), (1, "héllo"), (2, None), (None, ""), (3, "y" * 100_000)], "doc_id long, text string").withColumn("media", F.lit("own"))
    rows = media.features(media.store(df)).collect()
    assert len(rows) == 5
    for r in rows:
        text = {1: "héllo", 2: "", None: "", 3: "y" * 100_000}[r["doc_id"]].encode()
        payload = mpeg_audio.padded(text)
        media_bytes = mpeg_audio.write(payload, len(text))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(media_bytes).hexdigest() and r["media_bytes"] == len(media_bytes)
        assert r["frame_offsets"] == [len(media_bytes) - 648 * (len(payload) // 576 - i) for i in range(len(payload) // 576)]
        assert r["n_bytes"] == len(text) and r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-32:])
    assert len({r["media_sha256"] for r in rows}) == 3
    assert media.features(media.store(df.limit(0))).count() == 0


# -- archives


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    members = {"a/x.bin": bytes(range(256)) * 40, "é.txt": b"", "index": b"PK\x05\x06 not an end"}
    data = write_stored(members, zip64=wide)
    z = ZipArchive(BytesSource(data))
    assert {n: z.read(n) for n in z.members} == members
    assert z.read_range("a/x.bin", 256, 10) == bytes(range(10))
    assert {n: zipfile.ZipFile(io.BytesIO(data)).read(n) for n in members} == members
    with pytest.raises(ValueError):
        z.read_range("a/x.bin", 0, 10**6)
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as f:
        f.writestr("deflated", b"z" * 1000, zipfile.ZIP_DEFLATED)
        f.comment = b"a comment"
    z = ZipArchive(BytesSource(made.getvalue()))
    assert z.read("deflated") == b"z" * 1000
    with pytest.raises(ValueError):
        z.read_range("deflated", 0, 1)
    with pytest.raises(ValueError):
        ZipArchive(BytesSource(b"PK nothing"))


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 30
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, None, big), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (None, "u", big), (6, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("own"))
    out = warc.read_archives(warc.write_archives(warc.record_types(df))).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[1]["record_type"] == "response" and by[1]["payload"].decode() == big and by[1]["url"] == "http://a/\r\nX: y"
    assert by[2]["record_type"] == "revisit" and by[2]["refers_to"] == 1 and by[2]["payload_bytes"] == len(big.encode()) and by[2]["url"] is None
    assert by[None]["refers_to"] == 1 and by[4]["record_type"] == "response" and by[5]["payload_bytes"] == 0
    assert warc.read_archives(warc.write_archives(warc.record_types(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        warc.parse_record(gzip.decompress(gzip.compress(b"HTTP/1.1 200\r\n\r\n")))


# -- URLs


def test_rules_and_list(spark):
    urls = ["http://EXAMPLE.com/en/7x", "https://a.example.com/en/8", "x://b.net/de/1?q", "http://example.net/de/8#f", "no scheme/en/", None, "http://net/de/", "http://notnet/de/", "http://www.bad.org:80/p/", "http://bad.org/other", "http://ok.org/p"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("rule", F.lit("own"))
    listed = spark.createDataFrame([("bad.org/p",), ("bad.org/p",), (None,)], "key string")
    out = url_filter.judge(df, queries.URL_RULES, listed).collect()
    assert len(out) == len(urls) + 1
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in out}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("net/de/", "block"), 3: ("example.net/de/8", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: ("net/de/", "block"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "allow"), 10: (None, "allow")}
    assert url_filter.judge(df, queries.URL_RULES, listed.limit(0)).where("verdict = 'block' and rule is null").count() == 0
    assert url_filter.judge(df.limit(0), queries.URL_RULES, listed).count() == 0


def test_rules_of_the_contract(spark):
    assert queries.URL_RULES == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    urls = ["http://b.net/de/1", "http://example.net/de/9", "http://example.net/de/8", "http://a.org/es/1", "http://b.com/en/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("b.net",)], "key string")  # a rule goes before the list
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, queries.URL_RULES, listed).collect()}
    assert got == {0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("org/es/", "block"), 4: ("com/en/", "block")}


def test_bloom_has_no_false_negatives(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.org') as key")
    blocks = url_filter.bloom_blocks(listed, 750)
    asked = spark.range(6000).selectExpr("concat('h', id, '.org') as key", "id")
    m = url_filter._mask(F.col("key"))
    passed = asked.withColumn("block", url_filter._block(F.col("key"), 750)).join(blocks, "block").where(F.col("word").bitwiseAND(m) == m)
    assert passed.where("id < 3000").count() == 3000
    assert passed.where("id >= 3000").count() < 150
