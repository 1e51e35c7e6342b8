"""From signatures to connected components, without all pairs of a group.

Items (distinct texts, not copies) are indexed by signatures; only items that
share one can be linked. A group of two is a pair. Large groups of alike items
share many signatures, so their pairs are made in three steps:

1. Each group of a signature gives a star: its leader with each other member.
   The leader is the member whose signatures have the largest groups, the
   likely source of the others; groups of much the same members have the same
   leader and give the same pairs.
2. Links found so far make components. A group whose members are all in one
   component needs no more pairs. The others give stars again, for a few
   rounds: a random member of the group's largest component with each member
   of another one.
3. What groups are still of several components give all pairs of members of
   different components, which is exact: all pairs of a group are verified,
   pruned by a bound, or connected already. Groups of over BLOCK members are
   dealt out as pairs of blocks.

Components come from union-finds in every partition and then, up to EDGES edges
in all, from one in a single task of bounded memory; beyond, from rounds of
joins (every edge points to the smallest neighbour of its larger end, then of
its smaller end) over written tables. Nothing is collected to the driver. All
tables are written to the caller's Scratch folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import Scratch, few

BLOCK = 2048
STAR_ROUNDS = 2  # after the first
EDGES = 1_000_000  # that one task merges at most: 16 MB, some 200 MB of Python objects
SHARE = 50_000  # rows of small groups that one call compares, about
FACT_BYTES = 512  # of an item's size and sketch where they are broadcast
_PAIR = "a long, b long"


def _union_find(edges: DataFrame, whole: bool) -> DataFrame:
    """Stars with the components of each partition's edges: (a, b) with a the smallest. whole: the partition has all edges, so trees are never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        def flush() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array([r for _, r in pairs], pa.int64()), "b": pa.array([x for x, _ in pairs], pa.int64())})

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 500_000 and not whole:
                yield flush()
        yield flush()

    return edges.select("a", "b").mapInArrow(run, _PAIR)


def components(edges: DataFrame, n: int, at: Scratch, rounds: int = 60) -> DataFrame:
    """(item, root): every end of n edges with the smallest item it is connected to. edges: a, b, never null."""
    forest = _union_find(edges.where("a != b"), False)
    if n <= EDGES:
        e = _union_find(forest.repartition(1), True)
    else:
        e = _rounds(at.write_few(forest.distinct(), "edges"), at, rounds)
    ends = F.explode(F.array(F.struct(F.col("b").alias("item"), F.col("a").alias("root")), F.struct(F.col("a").alias("item"), F.col("a").alias("root"))))
    return e.select(ends.alias("e")).select("e.*").distinct()


def _rounds(e: DataFrame, at: Scratch, rounds: int) -> DataFrame:
    state = None
    for _ in range(rounds):
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))  # larger neighbours to the least one
        large = large.where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        nxt = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a != b").distinct()
        e = at.write_few(nxt, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return e
        state = now
    raise RuntimeError("components did not settle")


def grouped(members: DataFrame, at: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs, groups): a, b of the groups of two; sig, item, n of larger ones. members: a written table of sig, item, distinct."""
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("a"), F.max("item").alias("b")).where("n > 1")
    sizes = at.write_few(sizes, "sizes")
    large = few(at.write_few(sizes.where("n > 2").select("sig", "n"), "large"), 32)
    return sizes.where("n = 2").select("a", "b"), members.join(large, "sig").select("sig", "item", "n")


def star_pairs(members: DataFrame, at: Scratch) -> DataFrame:
    """(a, b), a < b: the leader of each signature's group with the others. members: sig, item, n.

    Items are ranked by one long, the weight above 40 bits of hash, so that the
    leaders are found by hash aggregation; two items of one rank may stand for
    each other, and what that leaves out the later steps find.
    """
    rank = F.shiftleft(F.least(F.sum("n"), F.lit((1 << 22) - 1)), 40).bitwiseOR(F.shiftrightunsigned(F.xxhash64("item"), 24))
    ranks = at.write_few(members.groupBy("item").agg(rank.alias("rank")), "ranks")
    ranked = members.select("sig", "item").join(few(ranks, 32), "item")
    lead = ranked.groupBy("sig").agg(F.max("rank").alias("top"))
    pairs = ranked.join(lead, "sig").where("rank != top").select("item", "top").distinct()
    leaders = ranks.groupBy(F.col("rank").alias("top")).agg(F.min("item").alias("lead"))
    return _distinct_pairs(pairs.join(leaders, "top"))


def _distinct_pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("item", "lead").alias("a"), F.greatest("item", "lead").alias("b")).distinct()


def mixed_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """sig, item, n, root: the members of groups of several components. members: sig, item, n; roots: a written table."""
    labelled = members.select("sig", "item", "n").join(few(roots, 32), "item", "left").withColumn("root", F.coalesce("root", "item"))
    mixed = labelled.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("sig")
    return labelled.join(mixed, "sig").select("sig", "item", "n", "root")


def bridge_pairs(mixed: DataFrame, salt: int) -> DataFrame:
    """(a, b), a < b, distinct: a random member of each group's largest component with the members of the others."""
    parts = mixed.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("k"), F.min_by("item", F.struct(F.xxhash64(F.lit(salt), "item"), "item")).alias("lead"))
    main = parts.groupBy("sig").agg(F.max_by(F.struct("root", "lead"), F.struct("k", F.xxhash64(F.lit(salt), "root"), "root")).alias("m")).select("sig", F.col("m.root").alias("main"), F.col("m.lead").alias("lead"))
    return _distinct_pairs(mixed.join(main, "sig").where("root != main"))


def cross_pairs(mixed: DataFrame, facts: DataFrame, tolerance: float) -> DataFrame:
    """(a, b), a < b, distinct: members of one group in different components that sizes and sketches don't rule out.

    mixed: as of mixed_members(); facts: item, size, sketch. Two sets can be
    linked only if the smaller size is at least tolerance times the larger, and
    if they differ in at most (1 - tolerance) / (1 + tolerance) of the sum of
    their sizes; their sketches differ in no more bits than the sets in values.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = mixed.join(facts, "item").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    # many groups are small: each task takes a share of them at once
    rows = mixed.agg(F.sum(blocks)).first()[0] or 0
    shares = max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // SHARE)
    dealt = dealt.select(F.pmod(F.xxhash64("sig", lo, hi), F.lit(shares)).alias("share"), "sig", lo.alias("lo"), hi.alias("hi"), "own", "item", "root", "size", "sketch")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sig, lo, hi, own, item, root, n = (rows.column(c).to_numpy() for c in ("sig", "lo", "hi", "own", "item", "root", "size"))
        words = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(item), -1)
        order = np.lexsort((item, n, hi, lo, sig))
        sig, lo, hi, own, item, root, n, words = (x[order] for x in (sig, lo, hi, own, item, root, n, words))
        head = np.concatenate(([True], (sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        group = np.cumsum(head)
        firsts, seconds, left = [], [], np.arange(len(item))
        for gap in range(1, len(item)):  # each row with the one gap places on, of its group and not too large
            left = left[left + gap < len(item)]
            right = left + gap
            ok = (group[left] == group[right]) & (n[left] >= tolerance * n[right] - 1e-9)
            left = left[ok]  # sizes rise within a group: what fails here fails from here on
            if not len(left):
                break
            right = left + gap
            ask = np.flatnonzero((root[left] != root[right]) & ((lo[left] == hi[left]) | (own[left] != own[right])))
            for at in range(0, len(ask), 65_536):
                i = left[ask[at : at + 65_536]]
                j = i + gap
                apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1)
                keep = apart <= (1 - tolerance) / (1 + tolerance) * (n[i] + n[j]) + 1e-9
                firsts.append(np.minimum(item[i], item[j])[keep])
                seconds.append(np.maximum(item[i], item[j])[keep])
        none = np.empty(0, dtype=np.int64)
        return pa.table({"a": np.concatenate([*firsts, none]), "b": np.concatenate([*seconds, none])})

    return dealt.groupBy("share").applyInArrow(run, _PAIR).distinct()


def linked_components(pairs: DataFrame, members: DataFrame, facts: DataFrame, verify: Callable[[DataFrame], DataFrame], tolerance: float, at: Scratch) -> DataFrame:
    """(item, root) of all items with a link. pairs, members: of grouped(), members written. verify: pairs (a, b) -> those that are links."""
    first = pairs.unionAll(star_pairs(members, at)).distinct()
    found = at.write_few(verify(first), "links")
    n = found.count()
    roots = at.write_few(components(found, n, at), "roots", 2 * n)
    mixed = members
    for salt in range(STAR_ROUNDS + 1):
        mixed = at.write_few(mixed_members(mixed, roots), "mixed")
        if not mixed.limit(1).count():
            break
        more = bridge_pairs(mixed, salt) if salt < STAR_ROUNDS else cross_pairs(mixed, facts, tolerance)
        more = at.write_few(verify(more), "links")
        if k := more.count():
            n = k + roots.count()
            edges = roots.select(F.col("root").alias("a"), F.col("item").alias("b")).unionAll(more)
            roots = at.write_few(components(edges, n, at), "roots", 2 * n)
    return roots


def plausible(pairs: DataFrame, facts: DataFrame, tolerance: float) -> DataFrame:
    """Pairs (a, b) that sizes and sketches don't rule out."""
    a = facts.select(F.col("item").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    b = facts.select(F.col("item").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb"))
    if few(facts, FACT_BYTES) is not facts:
        a, b = F.broadcast(a), F.broadcast(b)
    sized = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") >= F.lit(tolerance) * F.greatest("na", "nb") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            apart = np.bitwise_count(x ^ y).sum(axis=1)
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = pa.array(apart <= (1 - tolerance) / (1 + tolerance) * total + 1e-9)
            yield batch.select(["a", "b"]).filter(keep)

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, _PAIR)


def verified(pairs: DataFrame, contents: DataFrame, sets: Callable[[pa.Array], list], alike: Callable[[object, object], bool]) -> DataFrame:
    """Pairs (a, b) whose contents are alike. contents: item, content; sets: from a column of contents to what alike compares, each content once for a batch."""
    b = contents.select(F.col("item").alias("b"), F.col("content").alias("cb"))
    a = contents.select(F.col("item").alias("a"), F.col("content").alias("ca"))

    def made(batch: pa.RecordBatch, key: str, content: str) -> list:
        _, first, at = np.unique(batch.column(key).to_numpy(), return_index=True, return_inverse=True)
        own = sets(batch.column(content).take(pa.array(first)))
        return [own[i] for i in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keep = [alike(x, y) for x, y in zip(made(batch, "a", "ca"), made(batch, "b", "cb"))]
                yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "ca", "cb").mapInArrow(run, _PAIR)
