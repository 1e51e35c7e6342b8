"""Fuzzy line deduplication over a corpus, by MinHash.

A line is what newlines separate. Lines that are equal but for the case of A-Z
are one item. Items of at least LEAST_SHINGLES shingles of SHINGLE characters
get a one-permutation MinHash signature of BANDS * ROWS bins, empty bins filled
from bins drawn at random; each band of ROWS values is a key, and items that
share a key are compared by the exact Jaccard similarity of their shingle sets.
At similarity 0.75 a pair shares a key with probability 0.997, at 0.85 with
over 0.99999. Links from 0.75 on are merged to components by distributed
rounds, and the first line of each component (by document id, then place)
stays; all others go, exact repeats included.

With short=True, as op10_line_dedup and the pipeline have it, lines with fewer
shingles are items too: those with one or more are compared like others, and
those without (under SHINGLE characters) go where they are repeated exactly.
Only blank lines (white space of ASCII) with fewer shingles are left alone.
Without it, all lines under LEAST_SHINGLES shingles are.

Items are told apart by two 64-bit hashes: where one belongs to several texts,
the second becomes part of the item.

Defined results: a null text stays null and an empty one empty; repeated rows
(same id and text) count as one document and keep the same lines; a null id
comes before others. A document all of whose lines go has a null text in
dedup_lines() where it had one before; the pipeline drops it. Other columns,
whatever their names, are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.llm import links
from larkspur.llm.packs import bucket_edges, buckets_for, pack48, unpack48
from larkspur.llm.shingles import _SPACE, Spans, distinct_sorted, intersection_size, mix, parity_sketch, text_slices
from larkspur.llm.storage import Scratch, by_row, few, fresh, gathered, sized, with_keys, written

SHINGLE = 8
LEAST_SHINGLES = 8
BANDS, ROWS = 16, 4
NEED, WHOLE = 75, 100
FLUSH = 500_000  # keys a task holds before it sends them
SKETCH = 1024  # bits
SMALL = 3  # items of a key that give all their pairs at once
_BINS = BANDS * ROWS
_U = np.uint64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PROBES = 96


def _donors() -> np.ndarray:
    """For each bin, the order in which others are asked for a value."""
    draw = mix(np.arange(_BINS * _PROBES, dtype=np.uint64) + _U(0xA0761D6478BD642F))
    return (draw % _U(_BINS)).astype(np.int64).reshape(_BINS, _PROBES)


_DONORS = _donors()


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and each text's first line (one more)."""
    newline = np.flatnonzero(data == 10)
    # a text with n newlines has n + 1 lines; an empty text has one, empty
    per_text = np.diff(np.searchsorted(newline, offsets)) + 1
    first = np.concatenate(([0], np.cumsum(per_text)))
    starts = np.empty(first[-1], dtype=np.int64)
    heads = np.zeros(first[-1], dtype=bool)
    heads[first[:-1]] = True
    starts[heads], starts[~heads] = offsets[:-1], newline + 1
    ends = np.empty_like(starts)
    tails = np.zeros(first[-1], dtype=bool)
    tails[first[1:] - 1] = True
    ends[tails], ends[~tails] = offsets[1:], newline
    return starts, ends, first


def _shingles(spans: Spans, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes by line, the line of each, and each line's number of shingles."""
    begin = (data & 0xC0) != 0x80
    plain = bool(begin.all())  # a byte is a character
    if plain:
        a, b = starts, ends
    else:
        upto = np.concatenate(([0], np.cumsum(begin)))
        a, b = upto[starts], upto[ends]
    points = None if plain else np.append(np.flatnonzero(begin), len(data))
    bad = np.zeros((len(data) if plain else len(points) - 1) + 1, dtype=bool)  # characters without a shingle: newlines, and the last ones of a line
    bad[-1] = True
    newline = np.flatnonzero(data == 10)
    bad[newline if plain else upto[newline]] = True
    for k in range(1, SHINGLE):
        bad[np.maximum(b - k, 0)] = True
    at = np.flatnonzero(~bad)
    count = np.maximum(b - a - SHINGLE + 1, 0)
    start = at if plain else points[at]
    hashes = spans.of_eight(start)
    if not plain:
        size = points[at + SHINGLE] - start
        wide = np.flatnonzero(size > 8)
        hashes[wide] = spans(start[wide], start[wide] + size[wide])
    return hashes, np.repeat(np.arange(len(count)), count), count


def _band_keys(hashes: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """(lines, BANDS) keys of 48 bits, of lines numbered from 0 that all have shingles."""
    mins = np.full(lines * _BINS, _EMPTY)
    np.minimum.at(mins, line * _BINS + (hashes >> _U(58)).astype(np.int64), hashes)
    empty = np.flatnonzero(mins == _EMPTY)
    filled = mins.copy()
    row, own = empty // _BINS, empty % _BINS
    for k in range(_PROBES):
        if not len(empty):
            break
        got = mins[row * _BINS + _DONORS[own, k]]
        ok = got != _EMPTY
        filled[empty[ok]] = got[ok] + _U(k + 1)
        empty, row, own = empty[~ok], row[~ok], own[~ok]
    if len(empty):  # hardly ever: the line's least value
        filled[empty] = mins.reshape(lines, _BINS).min(axis=1)[row]
    v = filled.reshape(lines, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (lines, BANDS))
    for r in range(ROWS):
        key = mix((key ^ v[:, :, r]) * _U(0x9E3779B97F4A7C15))
    return key >> _U(16)


def _survey(buckets: int, key_type: T.DataType, short: bool):
    """Rows of two kinds: each line with its item (bucket -1; none for a line that is left alone), and the keys of items in packs by bucket."""
    schema = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("doc_id", key_type), T.StructField("rk", T.LongType()), T.StructField("line", T.IntegerType()),
        T.StructField("item", T.LongType()), T.StructField("check", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("items", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held_keys, held_items, size = [], [], 0

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in arrow], schema=arrow)

        def flush() -> pa.RecordBatch:
            items, at = np.unique(np.concatenate(held_items), return_index=True)  # copies within a task are told once
            keys, own = np.concatenate(held_keys)[at].reshape(-1), np.repeat(items, BANDS)
            order = np.argsort(keys)
            keys, own = keys[order], own[order]
            edges = bucket_edges(keys, buckets)
            spans = [(b, a, c) for b, (a, c) in enumerate(zip(edges[:-1], edges[1:])) if c > a]
            return rows(len(spans), bucket=[b for b, _, _ in spans], keys=[pack48(keys[a:c]) for _, a, c in spans], items=[own[a:c].tobytes() for _, a, c in spans])

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                parts = []
                for row, _, data, offsets in text_slices(batch.column("text")):
                    starts, ends, first = _lines(data, offsets)
                    spans = Spans(data)
                    items, checks = spans.both(starts, ends)
                    hashes, line, count = _shingles(spans, data, starts, ends)
                    solid = np.concatenate(([0], np.cumsum(~_SPACE[data])))
                    solid = (solid[ends] > solid[starts]) & short  # lines that aren't blank
                    long = (count >= LEAST_SHINGLES) | (solid & (count > 0))
                    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                    keep = np.flatnonzero(long | solid)
                    parts.append((row + of[keep], (np.arange(len(of)) - first[of])[keep], items[keep], checks[keep]))
                    if long.any():
                        if not long.all():
                            hashes, line = hashes[long[line]], (np.cumsum(long) - 1)[line[long[line]]]
                        held_keys.append(_band_keys(hashes, line, int(long.sum())))
                        held_items.append(items[long])
                        size += BANDS * len(held_items[-1])
                    if size >= FLUSH:
                        yield flush()
                        held_keys, held_items, size = [], [], 0
                if parts:
                    of, line, items, checks = (np.concatenate(x) for x in zip(*parts))
                    yield rows(len(of), bucket=np.full(len(of), -1), doc_id=batch.column("doc_id").take(pa.array(of)), rk=batch.column("rk").take(pa.array(of)), line=line, item=items.astype(np.int64), check=checks.astype(np.int64))
        if size:
            yield flush()

    return run, schema


def _members(packs: DataFrame) -> DataFrame:
    """(sig, item, n): items of each key that n items have, over SMALL. Of smaller groups of two or more: all pairs (n = 0, the pair in sig and item)."""

    def group(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack48(x.as_py()) for x in table.column("keys")])
        items = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("items")])
        order = np.argsort(keys)
        keys, items = keys[order], items[order].view(np.int64)
        same = keys[1:] == keys[:-1]
        shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))[: len(keys)]
        keys, items = keys[shared], items[shared]
        order = np.lexsort((items, keys))
        keys, items = keys[order], items[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])
        keys, items = keys[new], items[new]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        pairs = [np.empty((0, 2), dtype=np.int64)]
        for n in range(2, SMALL + 1):
            own = starts[sizes == n]
            pairs += [np.stack((items[own + i], items[own + j]), axis=1) for i in range(n) for j in range(i + 1, n)]
        pairs = np.concatenate(pairs)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        if len(pairs):
            pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))]
        n = np.repeat(sizes, sizes)
        large = n > SMALL
        return pa.table({"sig": np.concatenate((pairs[:, 0], keys[large].astype(np.int64))), "item": np.concatenate((pairs[:, 1], items[large])), "n": np.concatenate((np.zeros(len(pairs), dtype=np.int64), n[large]))})

    return packs.groupBy("bucket").applyInArrow(group, "sig long, item long, n long")


def line_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line; lines hold no newlines."""
    out = []
    for _, _, data, offsets in text_slices(column):
        hashes, _, count = _shingles(Spans(data), data, offsets[:-1], offsets[1:])
        ends = np.cumsum(count)
        out += [distinct_sorted(hashes[b - n : b]) for n, b in zip(count, ends)]
    return out


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = intersection_size(x, y)
    return WHOLE * both >= NEED * (len(x) + len(y) - both)


def _contents(docs: DataFrame) -> DataFrame:
    """(item, content) of the lines that are asked for. docs: text, want (an array of item and line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                want = batch.column("want")
                bounds = want.offsets.to_numpy()
                for row, to, data, offsets in text_slices(batch.column("text")):
                    starts, ends, first = _lines(data, offsets)
                    asked = want.values.slice(bounds[row], bounds[to] - bounds[row])
                    of = np.repeat(np.arange(to - row), np.diff(bounds[row : to + 1]))
                    place = first[of] + asked.field("line").to_numpy()
                    yield pa.RecordBatch.from_pydict({"item": asked.field("item"), "content": pa.array([data[a:b].tobytes() for a, b in zip(starts[place], ends[place])], pa.binary())})

    return docs.select("text", "want").mapInArrow(run, "item long, content binary")


def _described(contents: DataFrame) -> DataFrame:
    """item, size, sketch of contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sets = line_sets(batch.column("content"))
                yield pa.RecordBatch.from_pydict({"item": batch.column("item"), "size": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array([parity_sketch(s, SKETCH).tobytes() for s in sets], pa.binary())})

    return contents.mapInArrow(run, "item long, size long, sketch binary")


def _told_apart(places: DataFrame, members: DataFrame, several: DataFrame, at: Scratch) -> tuple[DataFrame, DataFrame]:
    """places and members with a new item for each text of those that share one."""
    clash = at.write_few(several.where("lo != hi").select("item"), "line-clashes")
    names = places.join(few(clash, 32), "item").select("item", "check", F.xxhash64("item", "check").alias("new")).distinct()
    names = few(at.write_few(names, "line-names"))
    places = places.join(names, ["item", "check"], "left").withColumn("item", F.coalesce("new", "item")).drop("new")
    by_item = names.select(F.col("item").alias("old"), "new")
    renamed = lambda df, c: df.join(by_item.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    pairs = renamed(renamed(members.where("n = 0"), "sig"), "item").where("sig != item")
    large = renamed(members.where("n > 0"), "item").drop("n").distinct()
    large = large.join(large.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sig")
    return at.write(places, "line-places"), at.write(pairs.select("sig", "item", "n").unionAll(large.select("sig", "item", "n")), "line-members")


def _drops(docs: DataFrame, short: bool, at: Scratch) -> DataFrame:
    """doc_id, rk, drop: the places of lines that go. docs: doc_id, rk, text."""
    run, schema = _survey(buckets_for(docs), docs.schema["doc_id"].dataType, short)
    survey = at.write(sized(docs, docs).mapInArrow(run, schema), "lines")
    places = survey.where("bucket = -1").select("doc_id", "rk", "line", "item", "check")
    members = at.write_few(_members(survey.where("bucket >= 0").select("bucket", "keys", "items")), "line-members")
    counted = lambda: at.write_few(places.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")).where("n > 1"), "line-several")
    several = counted()
    if several.where("lo != hi").limit(1).count():
        places, members = _told_apart(places, members, several, at)
        several = counted()
    pairs, members = members.where("n = 0").select(F.least("sig", "item").alias("a"), F.greatest("sig", "item").alias("b")).distinct(), members.where("n > 0")
    pairs = at.write_few(pairs, "line-pairs")
    # only items at several places, or with a key in common with others, matter from here on
    candidates = at.write_few(members.select("item").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct(), "line-candidates")
    matter = at.write_few(several.select("item").unionAll(candidates).distinct(), "line-matter")
    places = at.write(with_keys(places.drop("check"), matter, "item", "left_semi"), "line-places")
    place = F.struct("doc_id", "rk", "line")
    classes = at.write_few(places.groupBy("item").agg(F.min(place).alias("first"), F.max(place).alias("last")), "line-classes")
    # the text of each candidate item, from its first place
    wanted = with_keys(classes, candidates, "item", "left_semi").select("item", "first.doc_id", "first.rk", "first.line")
    wanted = at.write_few(wanted.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("item", "line")).alias("want")), "wanted")
    contents = at.write(sized(_contents(by_row(docs, few(wanted, 48, ["want"], 32), "inner")), docs), "line-contents")
    if contents.groupBy("item").count().where("count > 1").limit(1).count():  # of repeated rows
        contents = at.write(contents.dropDuplicates(["item"]), "line-contents")
    check = lambda pairs: links.verified(pairs, contents, line_sets, alike)
    roots = links.linked_components(pairs, members, _described(contents), check, NEED / WHOLE, at)
    # lines of items that occur at two places or more, or belong to a component: all but the first go
    rooted = at.write_few(classes.join(few(roots, 32), "item", "left"), "line-roots")
    linked = rooted.where("root is not null")
    least = linked.groupBy("root").agg(F.min("first").alias("keep"))
    alone = rooted.where("root is null and first != last").select("item", F.col("first").alias("keep"))
    verdict = few(at.write_few(alone.unionAll(linked.join(least, "root").select("item", "keep")), "line-verdict"), 96)
    gone = places.join(verdict, "item").where(~place.eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "rk").agg(F.array_sort(F.collect_set("line")).alias("drop"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", short: bool = False, counts: tuple[str, str] = ("n_lines", "n_kept")) -> DataFrame:
    """All columns of df, text without the lines that go, then two counts: of lines, and of those kept.

    A text all of whose lines went is null. Columns of df that are named as the
    counts are replaced.
    """
    rk, drop = fresh(df, "rk"), fresh(df, "drop")
    docs = df.withColumn(rk, F.xxhash64(F.col(key).cast("string"), F.col(text)))
    with Scratch(df.sparkSession) as at:
        drops = _drops(docs.select(F.col(key).alias("doc_id"), F.col(rk).alias("rk"), F.col(text).alias("text")), short, at)
        drops = written(gathered(drops.withColumnRenamed("drop", drop)), "line-drops")
    joined = by_row(docs, few(drops, 48, [drop], 4), "left", key, rk)
    touched = F.col(drop).isNotNull()
    n = (F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_kept = n - F.coalesce(F.size(drop), F.lit(0))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(drop), i))
    shorter = F.when(n_kept > 0, F.array_join(kept, "\n"))
    names = [c for c in df.columns if c not in counts]
    zero = F.lit(0).cast("long")
    made = joined.select(*[F.when(touched, shorter).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in names], F.coalesce(n, zero).alias(counts[0]), F.coalesce(n_kept, zero).alias(counts[1]))
    return sized(made, df)
