"""Near-duplicate vectors by sorted projection passes.

In each pass vectors get a key of concatenated random hyperplane signs and are
sorted by it; neighbours in that order are compared by cosine in double
precision, and all verified pairs of all passes are united. No task gives out
pairs: of the links it finds only edges that span them, no more than it has
rows, and when the components are known each one's links are counted exactly by
pairs of blocks, which give out one number per row. Rows are dealt out
in chunks by their rank in the whole order, each with the ranks beside it that
its windows reach, so the number of partitions changes nothing.

How crowded the order is around each row is measured: the leading bits that a
window of rows at most have in common with it, in each pass, give the chance
that a pair at the threshold has not met. A pair is met as often as its less
crowded end says. Rows for which the passes do not reach the recall wanted are
compared with each other, all pairs in exact blocks, so the recall holds at
every size and however skewed the vectors are. The number of passes suits
evenly spread vectors, few of which are crowded then.
Equal vectors are collapsed beforehand and counted by weight.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; so do vectors of
other lengths than each other. Components of any finite size are compared
(scaled by the largest first). Repeated rows link with each other; rows that
share an id are vectors of their own. A null id has no component. Columns of other names are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.components import connected_components
from revlens.session import Scratch

#: A chunk of the order is CHUNK ranks, compared in blocks of BLOCK; a block of crowded rows is SIDE rows.
KEY_BITS, BLOCK, CHUNK, SIDE = 48, 128, 4096, 8192
SCALE = 10**6
FOUND = "u long, v long, miss long"


def _same(threshold: float) -> float:
    """Probability that a pair at ``threshold`` has the same sign on a random plane."""
    return 1 - math.acos(threshold) / math.pi


def passes_needed(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at ``threshold`` has met in some window with probability ``recall``, if a bit more than halving isolates a window."""
    bits = math.ceil(math.log2(n / window)) + 1 if n > window else 0
    meet = min(0.999, _same(threshold) ** bits)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _depths(keys: np.ndarray, window: int) -> np.ndarray:
    """Leading bits of each of the sorted ``keys`` that at most ``window`` rows share: one more than those any longer run around it has in common."""
    if len(keys) <= window:
        return np.zeros(len(keys), dtype=np.int64)
    common = KEY_BITS - np.frexp((keys[:-window] ^ keys[window:]).astype(np.float64))[1].astype(np.int64)
    edge = np.full(window, -1, dtype=np.int64)
    return 1 + np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, common, edge]), window + 1).max(1)


def _misses(threshold: float) -> np.ndarray:
    """By depth: the logarithm of the chance that a pair at ``threshold`` does not share that many bits, in whole units of 1 / SCALE so that sums are exact."""
    meet = _same(threshold) ** np.arange(KEY_BITS + 2.0)
    meet[-1] = 0  # more rows than a window have the whole key
    return np.rint(np.log1p(-np.minimum(meet, 1 - 1e-12)) * SCALE).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _keyed(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    schema = "pass int, key long, dims int, node long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(KEY_BITS, dtype=np.int64)[::-1]
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for width in np.unique(dims):
                part = batch.filter(pa.array(dims == width)) if (dims != width).any() else batch
                if not part.num_rows:
                    continue
                data = _matrix(part.column(1))
                for p in range(passes):
                    planes = np.random.default_rng([seed, p, int(width)]).standard_normal((int(width), KEY_BITS))
                    key = ((data @ planes > 0) * weights).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, p, dtype=np.int32)), pa.array(key), part.column(2), part.column(0)], names=["pass", "key", "dims", "node"])

    return vectors.select("node", "vector", F.size("vector").alias("dims")).mapInArrow(run, schema)


def _numbered(keyed: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """``keyed`` with ``rank``, the place in the order of its pass and length, whatever the ranges were."""
    order = ["pass", "dims", "key", "node"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # written once: the ranges of a second evaluation could be others
    ordered = scratch.save(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    before = Window.partitionBy("pass", "dims").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("pass", "dims", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    starts = starts.select("pass", "dims", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")).alias("shift"))
    return ordered.join(F.broadcast(starts), ["pass", "dims", "part"]).select(*order, (F.col("at") + F.col("shift")).alias("rank"))


def _together(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Whole groups of rows equal in the first ``keys`` columns, of batches sorted by them."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
        for a, b in zip(edges, edges[1:], strict=False):
            name = tuple(marks[a].tolist())
            if held and name != now:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = name
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


class Forest:
    """Least places that linked places are connected with."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.least[i], self.least[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.least, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.least[self.least]
                if (up == self.least).all():
                    break
                self.least = up

    def edges(self, ids: np.ndarray) -> pa.RecordBatch:
        """One edge for each place that is not the least of its own."""
        at = np.flatnonzero(self.least != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[self.least[at]]), pa.nulls(len(at), pa.int64())], names=["u", "v", "miss"])


def _linked(numbered: DataFrame, vectors: DataFrame, threshold: float, window: int, parts: int) -> DataFrame:
    """Edges (u, v) that span the links within the windows of each order, and the miss of each node there. Chunks have the ranks on both sides that their windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        misses = _misses(threshold)
        for (_, _, chunk), rows in _together(batches, 3):
            rank, ids = (rows.column(k).to_numpy() for k in (3, 5))
            unit = _matrix(rows.column(6).chunk(0))
            first, last = np.searchsorted(rank, [chunk * CHUNK, (chunk + 1) * CHUNK]).tolist()
            if first == last:
                continue
            depth = _depths(rows.column(4).to_numpy(), window)[first:last]
            yield pa.RecordBatch.from_arrays([pa.array(ids[first:last]), pa.nulls(last - first, pa.int64()), pa.array(misses[depth])], names=["u", "v", "miss"])
            forest = Forest(len(ids))
            for a in range(first, last, BLOCK):
                b, start = min(last, a + BLOCK), max(0, a - window)
                i, j = np.nonzero(np.tril(unit[a:b] @ unit[start:b].T >= threshold, a - start - 1))
                forest.link(a + i, start + j)
            yield forest.edges(ids)

    around = F.sequence(F.floor((F.col("rank") - window) / F.lit(CHUNK)), F.floor((F.col("rank") + window) / F.lit(CHUNK)))
    dealt = numbered.withColumn("chunk", F.explode(around)).where("chunk >= 0").join(vectors.select("node", "vector"), "node")
    dealt = dealt.select("pass", "dims", "chunk", "rank", "key", "node", "vector").repartition(parts, "pass", "dims", "chunk")
    return dealt.sortWithinPartitions("pass", "dims", "chunk", "rank").mapInArrow(run, FOUND)


def _blocks(rows: DataFrame, group: str, parts: int) -> DataFrame:
    """``rows`` (group, node, weight, vector) dealt to pairs of blocks of about SIDE rows of each group, sorted by group, b1, b2."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(SIDE)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(group, F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", "weight", "vector")
    return dealt.repartition(parts, group, "b1", "b2").sortWithinPartitions(group, "b1", "b2")


def _compared(crowd: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Edges (u, v) that span all links of ``crowd``, by pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, b1, b2), rows in _together(batches, 3):
            block, ids, unit = rows.column(3).to_numpy(), rows.column(4).to_numpy(), _matrix(rows.column(6).chunk(0))
            left, right = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
            other, forest = unit[right], Forest(len(ids))
            for s in range(0, len(left), BLOCK):
                at = left[s : s + BLOCK]
                i, j = np.nonzero(unit[at] @ other.T >= threshold)
                forest.link(at[i], right[j])
            yield forest.edges(ids)

    return _blocks(crowd.withColumn("dims", F.size("vector")), "dims", parts).mapInArrow(run, FOUND)


def _counted(members: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(node, linked): total weight of other members of its component that each node is linked with, in parts, one for each pair of blocks."""

    def told(ids: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked)], names=["node", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, b1, b2), rows in _together(batches, 3):
            block, ids, weight, unit = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy(), _matrix(rows.column(6).chunk(0))
            left, right = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
            other, linked = unit[right], np.zeros(len(ids), dtype=np.int64)
            for s in range(0, len(left), BLOCK):
                at = left[s : s + BLOCK]
                same = unit[at] @ other.T >= threshold
                if b1 == b2:
                    same[np.arange(len(at)), np.arange(s, s + len(at))] = False
                else:
                    linked[right] += weight[at] @ same
                linked[at] += same @ weight[right]
            yield told(ids, linked)

    return _blocks(members, "component", parts).mapInArrow(run, "node long, linked long")


def dedup(frame: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, window: int = 256, recall: float = 0.995, seed: int = 17) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    scratch = Scratch(frame.sparkSession, "embedding")
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    # a generator of one row keeps the optimizer from computing a whole column anew for every element that refers to it
    whole = lambda c, name: F.explode(F.array(c)).alias(name)
    rows = frame.select(F.col(vec_id).alias("vec_id"), whole(F.when(usable & F.col(vec_id).isNotNull(), wide), "vector"))
    # by the largest component first, so that no square overflows or vanishes
    rows = rows.select("vec_id", "vector", whole(F.array_max(F.transform("vector", lambda x: F.abs(x))), "top"))
    rows = rows.select("vec_id", whole(F.when(F.col("top") > 0, F.transform("vector", lambda x: x / F.col("top"))), "vector"))
    rows = rows.select("vec_id", "vector", whole(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)), "norm"))
    rows = rows.select("vec_id", whole(F.transform("vector", lambda x: x / F.col("norm")), "vector"))
    rows = rows.withColumn("h1", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector")))
    groups = rows.where("vector is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    groups = scratch.save(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    n = groups.count()
    passes = passes_needed(n, threshold, window, recall)
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = _numbered(_keyed(groups, passes, seed), scratch, parts)
    found = scratch.save(_linked(numbered, groups, threshold, window, parts), "found")
    missed = found.where("miss is not null").groupBy(F.col("u").alias("node")).agg(F.sum("miss").alias("miss")).where(F.col("miss") > round(math.log(1 - recall) * SCALE))
    crowd = scratch.save(groups.join(missed, "node", "left_semi").select("node", "weight", "vector"), "crowd")
    edges = found.where("miss is null").unionByName(_compared(crowd, threshold, parts)).select("u", "v").distinct()
    parts_of = scratch.save(connected_components(edges, scratch), "parts_of")
    members = scratch.save(groups.join(parts_of, "node").select("component", "node", "rep", "weight", "vector"), "members")
    degree = scratch.save(_counted(members, threshold, parts).groupBy("node").agg(F.sum("linked").alias("linked")), "degree")
    least = members.groupBy("component").agg(F.min("rep").alias("least"))
    told = groups.select("h1", "h2", "node", "rep", "weight").join(degree, "node", "left").join(parts_of.join(least, "component").select("node", "least"), "node", "left")
    told = told.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    scratch.drop("ordered", "found", "crowd")
    out = rows.drop("vector").join(told, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
