"""Near duplicates of documents and lines, neighbours, mixing, the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import additive_ann, jaccard_join, line_dedup, links, mixing, queries
from larkspur.llm.storage import Scratch
from larkspur.llm.shingles import intersection_size, parity_sketch, shingle_sets


def components_of(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def linked(sets: list[frozenset]) -> list[tuple[int, int]]:
    index, out = {}, []
    for i, s in enumerate(sets):
        for j, k in Counter(j for t in s for j in index.get(t, ())).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                out.append((i, j))
        for t in s:
            index.setdefault(t, []).append(i)
    return out


def near_copies(seed: int, n: int = 90) -> list[str]:
    """Texts with long chains of near copies, shared passages, and copies."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 40))
    texts = []
    for _ in range(6):
        base = list(rng.choice(words, int(rng.integers(8, 160))))
        for _ in range(n // 6):
            if rng.random() < 0.7 and texts:
                base = list(base)
                base[int(rng.integers(len(base)))] = str(rng.choice(words))
            texts.append(" ".join(base) + (" " + passage if rng.random() < 0.3 else ""))
    return texts


def lower(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def word_shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def thue_morse(n: int) -> tuple[str, str]:
    """Two texts that any polynomial hash modulo a power of two confuses."""
    a, b = "A", "B"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, seed):
    texts = near_copies(seed) + ["a b c", "A  b\tc", "a b c d e", "a b c d e f", "", None, "   ", "x " * 30_000, *thue_morse(1024), "Ünï É x y z w", "ünï É x y z w"]
    df = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("component_id", F.lit("own"))
    sets = [word_shingles(t) for t in texts]
    root = components_of(len(texts), linked(sets))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df).collect()}
    assert out == {i + 10: (len(sets[i]), (root[i] if sets[i] else i) + 10) for i in range(len(texts))}


def test_frequent_tokens_share_combinations():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for n, changed in ((300, 40), (60, 8), (12, 1), (4, 1), (3, 0)):
        for _ in range(30):
            x = np.sort(rng.choice(base, n, replace=False))
            rest = np.setdiff1d(base, x)
            y = np.sort(np.concatenate((rng.choice(x, n - changed, replace=False), rng.choice(rest, changed, replace=False)))) if changed else x
            both = intersection_size(x, y)
            if 100 * both < 75 * (len(x) + len(y) - both):
                continue
            order = {int(t): int(f) for t, f in zip(base, rng.integers(33, 60, len(base)))}
            sx, sy = (jaccard_join.signatures(s, np.array([order[int(t)] for t in s])) for s in (x, y))
            assert len(np.intersect1d(sx, sy))


def test_jaccard_odd_tables(spark):
    df = spark.createDataFrame([(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (None, "other text")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard_join.components(df).collect())) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 5]
    assert jaccard_join.components(df.limit(0)).count() == 0
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    a, b = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64)), np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    x, y = (np.frombuffer(parity_sketch(s).tobytes(), dtype=np.uint64) for s in (a, np.concatenate((a[:450], b))))
    assert int(np.bitwise_count(x ^ y).sum()) <= 150


@pytest.mark.parametrize("most", [links.EDGES, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, most):
    monkeypatch.setattr(links, "EDGES", most)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 150), (150, 170)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    with Scratch(spark) as at:
        got = {r["item"]: r["root"] for r in links.components(df, df.count(), at).collect()}
        assert links.components(df.limit(0), 0, at).count() == 0
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[200] == got[170] == 150


def test_large_mixed_groups_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 4)
    rows = [(1, i) for i in range(23)]
    sketch = bytes(256)
    mixed = spark.createDataFrame([(s, i, i // 2, 23) for s, i in rows], "sig long, item long, root long, n long")
    facts = spark.createDataFrame([(i, 10, bytearray(sketch)) for _, i in rows], "item long, size long, sketch binary")
    pairs = {(r["a"], r["b"]) for r in links.cross_pairs(mixed, facts, 0.75).collect()}
    assert pairs == {(i, j) for i in range(23) for j in range(i + 1, 23) if i // 2 != j // 2}


# -- lines


def brute_lines(rows: list[tuple[int, str | None]]) -> dict[int, str | None]:
    places = [(d, i, x) for d, t in sorted(rows) if t is not None for i, x in enumerate(t.split("\n"))]
    keys = list(dict.fromkeys(lower(x) for _, _, x in places if len(x) >= 15))
    sets = [frozenset(k[i : i + 8] for i in range(len(k) - 7)) for k in keys]
    root = dict(zip(keys, components_of(len(keys), linked(sets))))
    seen, kept = set(), {}
    for d, _, x in places:
        kept.setdefault(d, [])
        if (k := lower(x)) in root:
            if root[k] in seen:
                continue
            seen.add(root[k])
        kept[d].append(x)
    return {d: None if t is None else t if t == "" else "\n".join(kept[d]) if kept[d] else None for d, t in rows}


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(200)] + ["é", "日本"]
    pool = [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(int(rng.integers(0, 6))):
            x = str(rng.choice(pool))
            if rng.random() < 0.5:
                parts = x.split(" ")
                parts[int(rng.integers(len(parts)))] = str(rng.choice(words))
                x = " ".join(parts)
            lines.append(x.upper() if rng.random() < 0.1 else x)
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short"), (104, "short"), (105, "line " * 40_000), (106, "\n".join(thue_morse(1024)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_kept": F.lit("own"), "extra": F.lit(1)})
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "extra", "n_lines", "n_kept"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(rows)


def test_lines_odd_tables(spark):
    line = "one line that is long enough to be compared"
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, f"{line}\nand another line of the second text")], "doc_id long, text string")
    out = sorted(((r["doc_id"] or -1, r["text"], r["n_kept"]) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert out == sorted([(-1, line, 1), (1, None, 0), (1, None, 0), (2, "and another line of the second text", 1)], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_that_share_a_hash(spark, monkeypatch):
    """Eight items for all lines: the second hash tells them apart."""

    class Weak(line_dedup.Spans):
        def both(self, start, end):
            h, check = super().both(start, end)
            return h % 8, check

    import larkspur.llm.line_dedup as module

    real = module._survey

    def survey(buckets, key_type, short):
        run, schema = real(buckets, key_type, short)

        def weak(batches):
            module.Spans = Weak
            yield from run(batches)

        return weak, schema

    monkeypatch.setattr(module, "_survey", survey)
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(50)]
    pool = [" ".join(rng.choice(words, 9)) for _ in range(30)]
    rows = [(d, "\n".join(rng.choice(pool, 4))) for d in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()} == brute_lines(rows)


def test_sets_that_share_an_id(spark, monkeypatch):
    real = jaccard_join.set_id
    monkeypatch.setattr(jaccard_join, "set_id", lambda tokens: (real(tokens)[0] % 4, real(tokens)[1]))
    run_survey, run_contents = jaccard_join._survey, jaccard_join._contents
    weak = jaccard_join.set_id

    def survey(*args):
        run, schema = run_survey(*args)

        def inner(batches):
            jaccard_join.set_id = weak
            yield from run(batches)

        return inner, schema

    monkeypatch.setattr(jaccard_join, "_survey", survey)
    texts = near_copies(7, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [word_shingles(t) for t in texts]
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(df).collect()}
    assert out == dict(enumerate(components_of(len(texts), linked(sets))))


# -- neighbours


def test_neighbours_recall(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float)
    out = queries.op5_additive_ann(spark, sf).toPandas()
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = additive_ann.distances(x[ids == q][0], x)
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        own = out[out.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and (np.diff(own.score) >= 0).all()
        assert all(abs(s - d[ids == v][0]) == 0 for v, s in zip(own.vec_id, own.score))
        hit += len(set(best) & set(own.vec_id))
    assert hit / (10 * (ids % 100 == 0).sum()) >= 0.9


def test_neighbours_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    out = [(r["query_id"], r["rank"], r["vec_id"]) for r in additive_ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1), (0, 2, 8), (0, 3, 100), (100, 1, 8), (100, 2, 1), (100, 3, 0)]
    assert additive_ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert additive_ann.search(df, F.col("vec_id") == -1).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(0).normal(size=(600, 12)).astype(np.float32)
    q = additive_ann.fit(x, books=3, codes=16)
    error = lambda beam: float(((x - q.decode(q.encode(x, beam))) ** 2).sum())
    assert error(8) <= error(1)


# -- mixing


def test_exponent_meets_its_target(spark):
    totals = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    a = mixing.exponent_for(totals, limit=2.0)
    assert a == pytest.approx(1 - math.log(2) / math.log(7), abs=1e-6)
    goal = 1.05
    a = mixing.exponent_for(totals, entropy=goal)
    w = np.array([0.7, 0.2, 0.1]) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(goal, abs=1e-6)
    assert mixing.exponent_for(totals, limit=1.0) == 1.0


def test_mix_keeps_all_and_fits_the_budget(spark):
    rows = [(i, "a", "w " * 10) for i in range(300)] + [(1000 + i, "b", "w " * (i % 7)) for i in range(60)] + [(2000, None, "x y z"), (2001, "empty", ""), (2002, "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("epoch", F.lit("own"))
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "source", "text", "n_tokens", "epoch"]
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 2
    assert times[0] == 1 and times[2000] == 2
    cut = mixing.mix(df, budget=500)
    assert cut.agg(F.sum("n_tokens")).first()[0] <= 500 + 3
    assert mixing.mix(df.limit(0)).count() == 0
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).select("doc_id", "epoch").collect())) == sorted(map(tuple, out.select("doc_id", "epoch").collect()))


# -- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "ngram_jaccard", "mixing", "sentencepiece"]
    seen = docs
    for name, stage in cp.STAGES[:-1]:
        from larkspur.llm.storage import written

        nxt = written(stage(spark, seen, sf), name)
        assert nxt.columns == docs.columns
        if name != "mixing":
            assert nxt.count() <= seen.count() and nxt.groupBy("doc_id").count().where("count > 1").count() == 0
        else:
            assert nxt.select("doc_id").distinct().count() == seen.count()
        seen = nxt
    out = cp.run(spark, sf)
    assert out.count() == seen.count() and out.where("n_tokens < 3").count() == 0


def pipeline_fixture() -> tuple[list, list]:
    rng = np.random.default_rng(11)
    good = [f"word{i}" for i in range(300)]
    bad = [f"#{i}!" for i in range(60)]
    docs, labels = [], []
    for i in range(60):
        words = good if i % 3 else bad
        lines = [" ".join(rng.choice(words, 9)) for _ in range(int(rng.integers(1, 5)))]
        docs.append((i, "\n".join(lines), "en", f"s{i % 4}"))
        labels.append((i, int(i % 3 > 0), 0))
    docs += [(100, docs[1][1], "en", "s1"), (101, docs[1][1] + "\n" + docs[2][1] + " more", "en", "s2"), (102, None, "en", "s0"), (103, "", "en", None), (104, "word1 " * 30_000, None, "s0"), (None, docs[4][1], "en", "s0")]
    docs += [docs[5], docs[5]]
    return docs, labels


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """documents with nulls, repeated rows, a long text, and columns named as the operators' own."""
    docs, labels = pipeline_fixture()
    where = str(tmp_path_factory.mktemp("corpus"))
    own = {c: F.lit(77) for c in ("n_kept", "n_lines", "epoch", "rk", "drop", "__rk", "__s", "item", "root", "score", "c0")}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumns(own)
    df.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def plain_pipeline(docs: list[tuple], scores: dict) -> list[tuple]:
    """What is left of docs before mixing: (doc_id, text)."""
    rows = [(d, t) for d, t, *_ in docs if scores[d, t] >= queries.QUALITY_FROM]
    kept_lines = brute_lines_short([r for r in rows])
    rows = [(d, kept_lines[d, t]) for d, t in rows if t is None or t == "" or kept_lines[d, t] is not None]
    rows = list(dict.fromkeys(rows))
    sets = [word_shingles(t) for _, t in rows]
    root = components_of(len(rows), linked(sets))
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least = {}
    for i, r in enumerate(root):
        if sets[i] and (r not in least or order(i) < order(least[r])):
            least[r] = i
    return [x for i, x in enumerate(rows) if not sets[i] or least[root[i]] == i]


def brute_lines_short(rows: list[tuple]) -> dict:
    """As brute_lines, with short lines, repeated rows and null ids."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    blank = lambda x: not re.search(r"[^\x20\x09-\x0D]", x)
    places = [(d, t, x) for d, t in order for x in t.split("\n")]
    keys = list(dict.fromkeys(lower(x) for _, _, x in places if len(x) >= 15 or not blank(x)))
    sets = [frozenset(k[i : i + 8] for i in range(len(k) - 7)) for k in keys]
    root = dict(zip(keys, components_of(len(keys), linked(sets))))
    seen, kept = set(), {}
    for d, t, x in places:
        kept.setdefault((d, t), [])
        if (k := lower(x)) in root:
            if root[k] in seen:
                continue
            seen.add(root[k])
        kept[d, t].append(x)
    return {(d, t): None if t is None else t if t == "" else "\n".join(kept[d, t]) if kept[d, t] else None for d, t in rows}


def test_pipeline_against_plain_loops(spark, small_corpus):
    import corpus_pipeline as cp
    from larkspur.llm import quality, tokenize
    from larkspur.llm.storage import written

    docs = spark.read.parquet(f"{small_corpus}/documents.parquet")
    labels = spark.read.parquet(f"{small_corpus}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels), keep=["doc_id", "text"]).collect()
    expected = plain_pipeline([tuple(r)[:4] for r in docs.select("doc_id", "text", "lang", "source").collect()], {(r["doc_id"], r["text"]): r["score"] for r in scored})
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    seen = docs
    for name, stage in cp.STAGES[:3]:
        seen = written(stage(spark, seen, small_corpus), name)
        assert seen.columns == docs.columns and {tuple(r) for r in seen.select("n_kept", "n_lines", "epoch", "rk", "drop", "__rk", "item", "root").distinct().collect()} <= {(77,) * 8}
        assert seen.where("n_chars <> length(text)").count() == 0
    assert sorted(((r["doc_id"], r["text"]) for r in seen.collect()), key=key) == sorted(expected, key=key)
    mixed = written(cp.mixing_stage(spark, seen, small_corpus), "mixing")
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.select("epoch", "__s", "c0").distinct().collect()} == {(77, 77, 77)}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) == {d for d, _ in expected} and max(times.values()) <= 2
    out = cp.run(spark, small_corpus)
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in tokenize.round_trip_digests(spark.createDataFrame(expected, "doc_id long, text string"), queries.piece_model_path()).collect()}
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in out.collect()} == digests
    assert Counter(r["doc_id"] for r in out.collect()) == times


def test_pipeline_stages_on_an_empty_table(spark, small_corpus):
    import corpus_pipeline as cp

    none = spark.read.parquet(f"{small_corpus}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, small_corpus).count() == 0
