"""Operators over all of their input, beyond the sizes that used to be cut."""

import hashlib

import numpy as np

from larkspur.llm import mpeg_audio, secrets
from larkspur.llm import queries as llm_queries
from larkspur.operators import guard as G
from larkspur.operators import splits as S
from larkspur.plans import registry


def test_knn_sees_all_reference_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "REFERENCE_ROWS", 16)
    monkeypatch.setattr(G, "ASKING_ROWS", 5, raising=False)
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 4 == 0 else float(rng.normal()), None if i % 9 == 0 else float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame([*rows, rows[0]], "id long, x double, z double")
    stats = G.column_stats(df, ["x", "z"])
    got = sorted((r["id"], r["x"], r["z"]) for r in G.knn_fill(df, ["id"], df, ["x", "z"], stats, 5).collect())
    full = np.array([[stats[c]["median"] if v is None else v for c, v in zip("xz", r[1:])] for r in rows])
    sd, want = np.array([stats[c]["sd"] for c in "xz"]), []
    for i, x, z in [*rows, rows[0]]:
        near = sorted((round(float((((full[j] - full[i]) / sd) ** 2).sum()), 9), j) for j in [*range(len(rows)), 0] if j != i)[:5]
        mean = full[[j for _, j in near]].mean(axis=0)
        want.append((i, mean[0] if x is None else x, mean[1] if z is None else z))
    assert np.allclose(np.array(got), np.array(sorted(want)))


def test_grid_can_detect_a_leak(spark, sf):
    found = {r["leakage"]: r["detection_rate"] for r in registry.queries()["benchmark_grid"](spark, sf).collect()}
    assert found["peek_norm"] == 1.0


def test_short_lines_are_merged(spark, tmp_path):
    rows = [(1, "Menu\n\nabcdefghijklmn\n本日は休業"), (2, "menu\n\n  \nabcdefghijklmX\nother"), (3, "本日は休業\n          \nMenu"), (4, "abcdefgh\n          ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in llm_queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "\n  \nother", 3: "          ", 4: rows[3][1]}


def test_payload_that_looks_like_a_tag_or_table():
    for n in (576, 1152, 2880):
        text = bytearray(b"x" * n)
        text[21:25], text[n - 71 : n - 68] = b"VBRI", b"TAG"
        s = mpeg_audio.scan(mpeg_audio.write(bytes(text), n))
        assert s.payload == bytes(text) and s.table["kind"] == "Xing" and "id3v1_title" not in s.tags and s.skipped == 0


def test_components_are_packed_by_one_rule(spark, monkeypatch):
    monkeypatch.setattr(S, "PACK_LIMIT", 0, raising=False)
    rows = [(i, i, i // (1 + i % 4) // 3, i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, subject long, batch long, y int")
    plan = S.make_split_plan(df, "combined", id_col="id", constraints=["subject", "batch"], v=4, repeats=2, check=False)
    own = {r["subject"]: r["component"] for r in S.constraint_components(df, ["subject", "batch"]).collect()}
    want = set()
    for repeat in (1, 2):
        loads = [0] * 4
        for c in sorted(set(own.values()), key=lambda c: hashlib.md5(f"1|pack|{repeat}|{c}".encode()).hexdigest()):
            k, levels = loads.index(min(loads)), [g for g in own if own[g] == c]
            loads[k] += len(levels)
            want |= {(g, repeat, k + 1) for g in levels}
    assert {(r["id"], r["repeat_id"], r["fold"]) for r in plan.assign.collect()} == want


def test_overlapping_keywords():
    assert [x[:3] for x in secrets.candidates(b"secretoken=abcdef123")] == [(5, 0, 20)]
