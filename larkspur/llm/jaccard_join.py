"""Exact Jaccard components of documents by token-combination prefixes.

A document's set is its distinct five-word shingles; documents link where
``100 * |intersection| >= 75 * |union|``. Documents of equal sets are one item
from the start, so copies are never expanded into pairs.

The prefix theorem used twice: order all tokens alike for all sets. Of a set of
n tokens, a partner shares at least o = ceil(0.75 n); so a prefix of n - o + m
tokens holds at least m shared ones, and the two prefixes at least the smaller
of their m's.

1. Census. Tokens are ordered by hash, prefixes take m = ceil(n / 8). Prefix
   tokens are dealt out by value, each once for some ten thousand documents,
   and each document gets the number of its prefix tokens that another
   document has too. Documents with too few go: they have no partner. (In
   ordinary corpora that is most of them.)
2. Index. The rest are ordered by rising document frequency. A token that one
   item has is never indexed; a rare one (up to RARE items) is a signature by
   itself; frequent ones fall into hash classes, and two of one class make a
   signature. A prefix is extended until its indexable tokens, less one for
   each class it touches, exceed n - o; then two linked sets share a signature.
   The number of classes is a power of two near n / 4, so a set has about n / 2
   combinations; sets of unequal sizes use the classes of both sizes.
3. Verify. Items that share a signature are compared exactly (links.py), and
   links are merged to components by distributed rounds.

Tokens are 64-bit hashes; the census compares 48 bits of them, which can only
keep more documents. Sets are told apart by two 64-bit hashes: where one
belongs to several sets, the second becomes part of the item.

Defined results: without words or text a document's set is empty, it links
with nothing and is its own component; a component's id is the smallest id of
its documents, nulls aside (null if all are null); repeated rows get one row
each. Other columns of the input are not read. Very long texts are whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import links
from larkspur.llm.packs import bucket_edges, buckets_for, pack48, unpack48
from larkspur.llm.shingles import distinct_sorted, intersection_size, mix, parity_sketch, shingle_sets
from larkspur.llm.storage import Scratch, by_row, few, fresh, gathered, sized, with_keys, written

NEED, WHOLE = 75, 100  # 100 * intersection >= 75 * union
RARE = 32
FLUSH = 500_000  # tokens a task holds before it sends them
PACK = 128_000  # tokens of sets in a pack; larger rows would fill the executors' network and Arrow buffers
_NOBODY = 65535  # in place of a token's owner: several, who are counted already
_U = np.uint64


def overlap(n: int) -> int:
    """Tokens that a set of n shares with any partner, at least."""
    return -(-NEED * n // WHOLE)


def extra(n: int) -> int:
    return -(-n // 8)


def set_id(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit ids of a set of hashes, of independent keys."""
    item = mix((mix(tokens) * _U(0x9E3779B97F4A7C15)).sum(keepdims=True) + mix(np.bitwise_xor.reduce(mix(tokens + _U(77)), keepdims=True)) + _U(len(tokens)))
    check = mix(mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(keepdims=True) ^ _U(len(tokens)))
    return int(item[0].astype(np.int64)), int(check[0].astype(np.int64))


# -- census


def _survey(buckets: int, key_type: T.DataType):
    """Rows of three kinds: one for each document (bucket -1), prefix tokens in packs by bucket, and counts of tokens shared within a pack (bucket -2)."""
    schema = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("doc_id", key_type), T.StructField("rk", T.LongType()), T.StructField("ordinal", T.LongType()),
        T.StructField("item", T.LongType()), T.StructField("check", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("owners", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        task = TaskContext.get().partitionId() << 36
        ordinal, base, held, owners, size, seen = 0, 0, [], [], 0, set()

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(n, f.type)) for f in arrow], schema=arrow)

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            own = np.repeat(np.array(owners, dtype=np.uint16), [len(x) for x in held])
            order = np.argsort(keys)
            keys, own = keys[order], own[order]
            # a token that several have is counted for them here, and sent once without an owner
            same = keys[1:] == keys[:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            who, n = np.unique(own[shared], return_counts=True)
            if len(who):
                yield rows(bucket=[-2], ordinal=[task + base], tokens=[(who.astype(np.int64) + task + base).tobytes()], owners=[n.astype(np.int32).tobytes()])
            own[shared] = _NOBODY
            first = np.concatenate(([True], ~same))
            keys, own = keys[first], own[first]
            edges = bucket_edges(keys, buckets)
            spans = [(b, a, c) for b, (a, c) in enumerate(zip(edges[:-1], edges[1:])) if c > a]
            yield rows(bucket=[b for b, _, _ in spans], ordinal=[task + base] * len(spans), tokens=[pack48(keys[a:c]) for _, a, c in spans], owners=[own[a:c].tobytes() for _, a, c in spans])

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                ids, sizes, first = [], [], ordinal
                for tokens in shingle_sets(batch.column("text")):
                    n = len(tokens)
                    ids.append(set_id(tokens) if n else (None, None))
                    sizes.append(n)
                    if n and ids[-1] not in seen:  # copies within a task are told once
                        seen.add(ids[-1])
                        held.append(distinct_sorted(tokens[: n - overlap(n) + extra(n)] >> _U(16)))
                        owners.append(ordinal - base)
                        size += len(held[-1])
                    ordinal += 1
                    if size >= FLUSH or ordinal - base >= _NOBODY:
                        if held:
                            yield from flush()
                        base, size = ordinal, 0
                        held, owners = [], []
                        seen.clear()
                yield rows(bucket=[-1] * batch.num_rows, doc_id=batch.column("doc_id"), rk=batch.column("rk"), ordinal=task + first + np.arange(batch.num_rows), item=[i for i, _ in ids], check=[c for _, c in ids], n=sizes)
        if held:
            yield from flush()

    return run, schema


def _shared_counts(packs: DataFrame, within: DataFrame) -> DataFrame:
    """(ordinal, shared): of each document's prefix tokens, those that another document has too. within: the counts within packs."""

    def by_task(owners: np.ndarray, n: np.ndarray) -> pa.Table:
        home = owners >> 36
        cut = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(owners) else np.empty(0, dtype=np.int64)
        ends = np.append(cut[1:], len(owners))
        return pa.table({"home": home[cut], "ordinals": pa.array([owners[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), "counts": pa.array([n[a:b].astype(np.int32).tobytes() for a, b in zip(cut, ends)], pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        keys, owners = [], []
        for tokens, own, base in zip(group.column("tokens"), group.column("owners"), group.column("ordinal").to_pylist()):
            keys.append(unpack48(tokens.as_py()))
            own = np.frombuffer(own.as_py(), dtype=np.uint16).astype(np.int64)
            owners.append(np.where(own == _NOBODY, -1, own + base))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys)
        keys, owners = keys[order], owners[order]
        equal = keys[1:] == keys[:-1]
        owners = owners[np.concatenate(([False], equal)) | np.concatenate((equal, [False]))]
        return by_task(*np.unique(owners[owners >= 0], return_counts=True))

    def add(group: pa.Table) -> pa.Table:
        who = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in group.column("ordinals")])
        n = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int32) for x in group.column("counts")])
        found, at = np.unique(who, return_inverse=True)
        return pa.table({"ordinal": found, "shared": np.bincount(at, n).astype(np.int64)})

    counted = packs.select("bucket", "ordinal", "tokens", "owners").groupBy("bucket").applyInArrow(count, "home long, ordinals binary, counts binary")
    return counted.unionAll(within).groupBy("home").applyInArrow(add, "ordinal long, shared long")


# -- index


def _packed_sets(df: DataFrame) -> DataFrame:
    """(home, items, sizes, tokens): the sets of distinct items in packs of about PACK tokens. df: item, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId() << 24, 0
        items, content, size = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(c) // 8 for c in content], dtype=np.int64)
            return pa.RecordBatch.from_pydict({"home": [task + k], "items": [np.array(items, dtype=np.int64).tobytes()], "sizes": [sizes.tobytes()], "tokens": [b"".join(content)]})

        for batch in batches:
            for item, data in zip(batch.column("item").to_pylist(), batch.column("content")):
                items.append(item)
                content.append(data.as_py())
                size += len(content[-1]) // 8
                if size >= PACK:
                    yield flush()
                    items, content, size, k = [], [], 0, k + 1
        if items:
            yield flush()

    return df.select("item", "content").mapInArrow(run, "home long, items binary, sizes binary, tokens binary")


def _frequencies(packs: DataFrame, buckets: int) -> DataFrame:
    """(home, bucket, frequency): for the sorted distinct tokens of each pack, by value ranges, the number of items that have each."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, data in zip(batch.column("home").to_pylist(), batch.column("tokens")):
                tokens, n = np.unique(np.frombuffer(data.as_py(), dtype=np.uint64), return_counts=True)
                edges = np.searchsorted(tokens, np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)).tolist() + [len(tokens)]
                spans = [(b, a, c) for b, (a, c) in enumerate(zip(edges[:-1], edges[1:])) if c > a]
                yield pa.RecordBatch.from_pydict({"home": [home] * len(spans), "bucket": pa.array([b for b, _, _ in spans], pa.int32()), "tokens": [tokens[a:c].tobytes() for _, a, c in spans], "counts": [n[a:c].astype(np.uint32).tobytes() for _, a, c in spans]})

    def count(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column("tokens")]
        held = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in group.column("counts")])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        flat, ends = np.bincount(at, held)[at].astype(np.uint32), np.cumsum([len(p) for p in parts])
        return pa.table({"home": group.column("home"), "bucket": group.column("bucket"), "frequency": pa.array([flat[b - len(p) : b].tobytes() for p, b in zip(parts, ends)], pa.binary())})

    return packs.select("home", "tokens").mapInArrow(deal, "home long, bucket int, tokens binary, counts binary").groupBy("bucket").applyInArrow(count, "home long, bucket int, frequency binary")


def classes_of(n: int) -> int:
    """The number of classes of frequent tokens for sets of n: a power of two, at most n - overlap + 1."""
    return 1 << (n - overlap(n) + 1).bit_length() - 1


def signatures(tokens: np.ndarray, frequency: np.ndarray, rare: int = RARE) -> np.ndarray:
    """The distinct signatures of a set: linked sets share one. tokens and their frequencies, in any order."""
    n = len(tokens)
    single = mix(np.empty(0, dtype=np.uint64))
    need = n - overlap(n) + 1 - int((frequency == 1).sum())
    if n < 3 or need <= 0:  # smaller sets are linked with equal ones only
        return single
    order = np.lexsort((tokens, frequency))
    tokens, frequency = tokens[order], frequency[order]
    few = tokens[(frequency > 1) & (frequency <= rare)]
    single = mix(few[:need])
    need -= len(few)
    if need <= 0:
        return single
    many, out = tokens[frequency > rare], [single]
    bands, last = [], classes_of(n)
    band = classes_of(max(3, overlap(n)))
    while band <= last:
        bands.append(band)
        band *= 2
    for band in bands:
        own = (many >> _U(20)) % _U(band)
        _, first = np.unique(own, return_index=True)
        counted = np.ones(len(many), dtype=np.int64)
        counted[first] = 0  # one of each class
        end = int(np.searchsorted(np.cumsum(counted), need)) + 1
        by = np.argsort(own[:end], kind="stable")
        t, c = many[:end][by], own[:end][by]
        for gap in range(1, end):  # pairs of one class, by their distance in it
            same = np.flatnonzero(c[gap:] == c[:-gap])
            if not len(same):
                break
            x, y = t[same], t[same + gap]
            out.append(mix(mix(np.minimum(x, y) + _U(band)) + np.maximum(x, y) * _U(0xD6E8FEB86659FD93)))
    return np.unique(np.concatenate(out))


def _members(packs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(sig, item): each pack meets the frequencies of its tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sigs, owners = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
        by_bucket = np.argsort(right.column("bucket").to_numpy())
        sorted_frequency = np.concatenate([np.frombuffer(right.column("frequency")[int(i)].as_py(), dtype=np.uint32) for i in by_bucket] + [np.empty(0, dtype=np.uint32)])
        for row in range(left.num_rows):
            items, sizes = (np.frombuffer(left.column(c)[row].as_py(), dtype=np.int64) for c in ("items", "sizes"))
            tokens = np.frombuffer(left.column("tokens")[row].as_py(), dtype=np.uint64)
            frequency = sorted_frequency[np.unique(tokens, return_inverse=True)[1]]
            ends = np.cumsum(sizes)
            for item, a, b in zip(items, ends - sizes, ends):
                s = signatures(tokens[a:b], frequency[a:b])
                sigs.append(s)
                owners.append(np.full(len(s), item))
        return pa.table({"sig": np.concatenate(sigs).astype(np.int64), "item": np.concatenate(owners)})

    return packs.groupBy("home").cogroup(frequencies.groupBy("home")).applyInArrow(run, "sig long, item long")


def stored_sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=np.uint64) for x in column]


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = intersection_size(x, y)
    return WHOLE * both >= NEED * (len(x) + len(y) - both)


def _contents(docs: DataFrame) -> DataFrame:
    """(item, check, size, sketch, content) of each row of docs that has a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                sets = [s for s in shingle_sets(whole.column("text").slice(at, 256)) if len(s)]
                ids = [set_id(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array([i for i, _ in ids], pa.int64()), "check": pa.array([c for _, c in ids], pa.int64()), "size": pa.array([len(s) for s in sets], pa.int64()),
                    "sketch": pa.array([parity_sketch(s).tobytes() for s in sets], pa.binary()), "content": pa.array([s.tobytes() for s in sets], pa.binary()),
                })

    return docs.select("text").mapInArrow(run, "item long, check long, size long, sketch binary, content binary")


def _groups(docs: DataFrame, at: Scratch) -> DataFrame:
    """rk, doc_id, n, root: every row with its set's component (null for an empty set). docs: doc_id, rk, text."""
    buckets = buckets_for(docs)
    run, schema = _survey(buckets, docs.schema["doc_id"].dataType)
    survey = at.write(sized(docs, docs).mapInArrow(run, schema), "survey")
    rows = survey.where("bucket = -1").select("doc_id", "rk", "ordinal", "item", "check", "n")
    empty, rows = rows.where("n = 0"), rows.where("n > 0")
    clash = rows.groupBy("item").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo != hi").select("item", F.lit(True).alias("several"))
    clash = at.write_few(clash, "set-clashes")
    told = lambda df: df.drop("check")
    if clash.limit(1).count():
        own = F.when(F.col("several"), F.xxhash64("item", "check")).otherwise(F.col("item"))
        told = lambda df: df.join(few(clash, 32), "item", "left").withColumn("item", own).drop("several", "check")
    rows = told(rows)
    within = survey.where("bucket = -2").select(F.shiftright("ordinal", 36).alias("home"), F.col("tokens").alias("ordinals"), F.col("owners").alias("counts"))
    shared = _shared_counts(survey.where("bucket >= 0"), within)
    # a partner of a set of n has at least ceil(0.75 n) tokens: the smaller of both m's
    least = F.ceil(F.ceil(F.col("n") * NEED / WHOLE) / 8)
    left = rows.join(shared, "ordinal").where(F.col("shared") >= least)
    chosen = at.write_few(left.groupBy("item").agg(F.min("rk").alias("rk")).select("rk"), "chosen")
    sets = at.write(sized(told(_contents(with_keys(docs, chosen, "rk", "left_semi"))), docs), "sets")
    if sets.groupBy("item").count().where("count > 1").limit(1).count():  # of repeated rows
        sets = at.write(sets.dropDuplicates(["item"]), "sets")
    packs = at.write(_packed_sets(sets.repartition(max(1, buckets // 4))), "packs")
    pairs, members = links.grouped(at.write_few(_members(packs, _frequencies(packs, buckets)), "signatures"), at)
    facts, contents = sets.select("item", "size", "sketch"), sets.select("item", "content")
    check = lambda pairs: links.verified(at.write_few(links.plausible(pairs, facts, NEED / WHOLE), "pairs"), contents, stored_sets, alike)
    roots = links.linked_components(pairs, at.write_few(members, "members"), facts, check, NEED / WHOLE, at)
    rooted = rows.join(few(roots, 32), "item", "left").select("rk", "doc_id", "n", F.coalesce("root", "item").alias("root"))
    return rooted.unionAll(empty.select("rk", "doc_id", "n", F.lit(None).cast("long").alias("root")))


def document_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rk, doc_id, n, root: every row with its set's size and component (null for an empty set), written.

    doc_id is the row's key, and rk a hash of its key and text.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("rk"), F.col(text).alias("text"))
    with Scratch(df.sparkSession) as at:
        return written(gathered(_groups(docs, at)), "document-groups")


def components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id: each row with the smallest key that links reach."""
    rows = document_groups(df, key, text)
    linked = rows.where("root is not null")
    least = few(written(gathered(linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))), "least"))
    made = linked.join(least, "root").select("doc_id", "n", "component_id").unionAll(rows.where("root is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return made.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, of each component only the one of the smallest key (nulls last); of equal rows, one.

    Rows with empty sets stay, each distinct one.
    """
    rows = document_groups(df, key, text)
    rk = fresh(df, "rk")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rk"))
    linked = rows.where("root is not null")
    least = linked.groupBy("root").agg(F.min(first).alias("least"), F.max(first).alias("most")).where("least != most").select("root", "least")
    grouped = linked.join(few(written(gathered(least), "least"), 96), "root").where(first != F.col("least")).select("doc_id", "rk")
    gone = written(gathered(grouped.distinct()), "copies")
    repeated = written(gathered(rows.groupBy("doc_id", "rk").count().where("count > 1").select("doc_id", "rk")), "repeated")
    named = df.withColumn(rk, F.xxhash64(F.col(key).cast("string"), F.col(text)))
    left = by_row(named, few(gone), "left_anti", key, rk)
    if not repeated.limit(1).count():
        return sized(left.drop(rk), df)
    once = by_row(left, few(repeated), "left_semi", key, rk).dropDuplicates([rk, key])
    return by_row(left, few(repeated), "left_anti", key, rk).unionByName(once).drop(rk)
