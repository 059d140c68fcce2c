"""Jaccard self-join of documents on sets of word n-grams, by prefix trees.

1. Which n-grams occur in more than one document is found exactly: chunks of
   documents send their distinct hashes, cut by hash range, to one task per
   range, which answers with a count per document. A document can have a link
   only if a share of its n-grams as large as the threshold is repeated, so
   the others are done.
2. For the remaining distinct sets n-grams are ordered globally, rarest first.
   Two linked sets share an n-gram among the first ``n - ceil(t * n) + 1``;
   sets that share such a prefix n-gram with the group's least id are connected,
   and every link lies within one connected candidate group.
3. Candidate groups are cut by set size (linked sizes differ by the threshold
   at most) and, where large, into pairs of blocks. Each block pair is stored as
   a trie over the ordered n-grams, which every set of the block walks: nodes
   keep the overlap so far for all sets below them, and a subtree goes as soon
   as the overlap plus the longest remainder below cannot reach what is needed.

Equal sets are one class from the start and are never expanded into pairs.

Defined results: texts that are null or have no word have an empty set and link
with nothing; texts of fewer than n words have their whole sequence as one
n-gram. Rows that share an id are one node: whoever reaches one of their texts
reaches the others, and links are counted for each text. A null id is linked
with nothing and its component is null. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.components import connected_components
from revlens.llm.textscan import U, chunks, shingles, words
from revlens.session import Scratch, arrow_rows

#: Bytes of text of a chunk whose hashes are sorted together.
SORT_BYTES = 4 << 20
#: Sets of a block and their n-grams, about; a pair of blocks is one task's trie.
BLOCK, BLOCK_TOKENS = 512, 1 << 20
#: N-grams of one trie edge.
EDGE = 64
LOCAL = 0xFFFF

_HEADER = [("ids", "array<bigint>"), ("digests", "array<bigint>"), ("sizes", "array<int>"), ("s1", "array<bigint>"), ("s2", "array<bigint>"), ("own", "array<int>")]
_HEADER_TYPES = [pa.list_(pa.int64() if "bigint" in kind else pa.int32()) for _, kind in _HEADER]
_SENT = "range int, chunk bigint, docs int, vals binary, places binary, " + ", ".join(f"{n} {k}" for n, k in _HEADER)
_ANSWERED = "chunk bigint, docs int, counts binary, " + ", ".join(f"{n} {k}" for n, k in _HEADER)


def _name(tokens: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _send(docs: DataFrame, n: int, ranges: int) -> DataFrame:
    """Per chunk a header row and one row of hashes per range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for chunk in chunks(batches, "text", SORT_BYTES):
            name = (task << 32) | number
            number += 1
            _, _, hashes, first = words(chunk)
            sets = shingles(hashes, first, n)
            sizes = np.array([len(s) for s in sets], dtype=np.int32)
            every = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
            place = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(every)
            every, place = every[order], place[order]
            new = np.ones(len(every), dtype=bool)
            new[1:] = every[1:] != every[:-1]
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(every)))
            twice = np.repeat(times > 1, times)
            own = np.bincount(place[twice], minlength=len(sets)).astype(np.int32)
            single = np.where(times > 1, LOCAL, place[at]).astype(np.uint16)
            unique = every[at]
            part = ((unique >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
            low = (unique & U(0xFFFFFFFF)).astype(np.uint32)
            cuts = np.searchsorted(part, np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(cuts))
            names = [_name(s) for s in sets]
            header = [chunk.column("doc_id").cast(pa.int64()), chunk.column("digest"), pa.array(sizes), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array(own)]
            rows = len(full) + 1
            lists = [pa.ListArray.from_arrays(pa.array([None] * len(full) + [0, len(sets)], pa.int32()), h) for h in header] if len(full) else [pa.ListArray.from_arrays(pa.array([0, len(sets)], pa.int32()), h) for h in header]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(full, name % ranges).astype(np.int32)), pa.array(np.full(rows, name)), pa.array(np.full(rows, len(sets), dtype=np.int32)),
                    pa.array([low[cuts[r] : cuts[r + 1]].tobytes() for r in full] + [None], pa.binary()), pa.array([single[cuts[r] : cuts[r + 1]].tobytes() for r in full] + [None], pa.binary()),
                    *lists,
                ],
                names=["range", "chunk", "docs", "vals", "places", *[h for h, _ in _HEADER]],
            )

    return docs.mapInArrow(run, _SENT)


def _answer(sent: DataFrame) -> DataFrame:
    """Per chunk and range: how many n-grams of each document, alone in their chunk, other chunks have too."""

    def settle(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        vals = np.concatenate([np.frombuffer(r[2], dtype=np.uint32) for r in rows])
        order = np.argsort(vals)
        ordered = vals[order]
        same = ordered[1:] == ordered[:-1]
        repeated = np.zeros(len(vals), dtype=bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        counts, at = [], 0
        for _, docs, _, places in rows:
            place = np.frombuffer(places, dtype=np.uint16)
            hit = place[repeated[at : at + len(place)] & (place != LOCAL)]
            at += len(place)
            counts.append(np.bincount(hit, minlength=docs).astype(np.uint16 if len(hit) < 65536 else np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(counts, pa.binary()), *[pa.nulls(len(rows), t) for t in _HEADER_TYPES]], names=["chunk", "docs", "counts", *[h for h, _ in _HEADER]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            header = batch.filter(pa.compute.is_null(batch.column(3)))
            if header.num_rows:
                yield pa.RecordBatch.from_arrays([header.column(1), header.column(2), pa.nulls(header.num_rows, pa.binary()), *header.columns[5:]], names=["chunk", "docs", "counts", *[h for h, _ in _HEADER]])
            for part, chunk, docs, vals, places in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if vals is None:
                    continue
                if part != now and rows:
                    yield settle(rows)
                    rows = []
                now = part
                rows.append((chunk, docs, vals, places))
        if rows:
            yield settle(rows)

    return sent.mapInArrow(run, _ANSWERED)


def _gather(answered: DataFrame) -> DataFrame:
    """Per document: id, text digest, set size and name, and how many of its n-grams are repeated."""
    names = ["doc_id", "digest", "n", "s1", "s2", "n_repeated"]

    def told(header: list, counts: np.ndarray) -> pa.RecordBatch:
        ids, digests, sizes, s1, s2, own = header
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array((np.array(own, dtype=np.int64) + counts).astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, header, counts = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, docs = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if chunk != now:
                    if header:
                        yield told(header, counts)
                    now, header, counts = chunk, None, np.zeros(docs, dtype=np.int64)
                raw = batch.column(2)[k].as_py()
                if raw is None:
                    header = [batch.column(3 + i)[k].as_py() for i in range(len(_HEADER))]
                else:
                    counts += np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * docs else np.uint32)
        if header:
            yield told(header, counts)

    return answered.mapInArrow(run, "doc_id bigint, digest bigint, n int, s1 bigint, s2 bigint, n_repeated int")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            _, _, hashes, first = words(chunk)
            sets = [s for s in shingles(hashes, first, n) if len(s)]
            names = [_name(s) for s in sets]
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            tokens = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], names=["s1", "s2", "tokens"])

    return docs.mapInArrow(run, "s1 bigint, s2 bigint, tokens array<bigint>")


class Trie:
    """Sequences over 0..width-1 as a tree whose edges hold up to EDGE items, one level of edges after the other."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray, width: int):
        self.lengths = np.array([len(s) for s in sequences])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        parent = np.zeros(len(sequences), dtype=np.int64)
        alive = np.arange(len(sequences))
        for at in range(0, int(self.lengths.max(initial=1)), EDGE):
            alive = alive[self.lengths[alive] > at]
            edge = np.full((len(alive), EDGE + 1), width, dtype=np.int64)
            edge[:, 0] = parent[alive]
            for row, k in enumerate(alive):
                piece = sequences[k][at : at + EDGE]
                edge[row, 1 : 1 + len(piece)] = piece
            nodes, below = np.unique(edge, axis=0, return_inverse=True)
            below = below.reshape(-1)
            parent[alive] = below
            rest = np.zeros(len(nodes), dtype=np.int64)
            np.maximum.at(rest, below, np.maximum(self.lengths[alive] - at - EDGE, 0))
            least = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(least, below, sizes[alive])
            ending = self.lengths[alive] <= at + EDGE
            self.levels.append((nodes[:, 0], nodes[:, 1:], rest, least, alive[ending], below[ending]))

    def overlaps(self, present: np.ndarray, size: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequences not pruned, and their overlaps with the set marked in ``present`` (one more slot than items, False)."""
        found, overlap = [], []
        above, live = np.zeros(1, dtype=np.int64), np.ones(1, dtype=bool)
        for parent, items, rest, least, ends, node in self.levels:
            go = np.flatnonzero(live[parent])
            if not len(go):
                break
            count, alive = np.zeros(len(parent), dtype=np.int64), np.zeros(len(parent), dtype=bool)
            count[go] = above[parent[go]] + present[items[go]].sum(1)
            alive[go] = (count[go] + rest[go]) * (num + den) >= num * (size + least[go])
            keep = alive[node]
            found.append(ends[keep])
            overlap.append(count[node[keep]])
            above, live = count, alive
        return (np.concatenate(found), np.concatenate(overlap)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def link_block(reps: np.ndarray, sizes: np.ndarray, weights: np.ndarray, sequences: list[np.ndarray], lower: np.ndarray, block: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each set and the least id it is connected with, for pairs of lower sets and of a lower with an upper set, across blocks if there are two."""
    m = len(reps)
    items, local = np.unique(np.concatenate(sequences), return_inverse=True)
    cuts = np.cumsum([len(s) for s in sequences])[:-1]
    local = np.split(local.reshape(-1), cuts)
    trie = Trie(local, sizes, len(items))
    links, parent = np.zeros(m, dtype=np.int64), np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    two = bool((block != block[0]).any())
    present = np.zeros(len(items) + 1, dtype=bool)
    for x in np.flatnonzero(lower):
        present[local[x]] = True
        others, overlap = trie.overlaps(present, int(sizes[x]), num, den)
        present[local[x]] = False
        linked = others[(overlap * (num + den) >= num * (sizes[x] + sizes[others])) & (~lower[others] | (others > x)) & ((block[others] != block[x]) | (not two))]
        links[x] += weights[linked].sum()
        links[linked] += weights[x]
        for y in linked.tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return links, reps[[root(i) for i in range(m)]]


def _verify(groups: DataFrame, num: int, den: int) -> DataFrame:
    names = ["node", "linked", "root"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending")])
        reps, sizes, weights = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "size"))
        lower, block = table.column("lower").to_numpy(zero_copy_only=False), table.column("block").to_numpy()
        lists = table.column("tokens").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sequences = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        if len(reps) < 2 or not lower.any():
            links, roots = np.zeros(len(reps), dtype=np.int64), reps
        else:
            links, roots = link_block(reps, sizes, weights, sequences, lower, block, num, den)
        keep = links > 0
        return pa.table([pa.array(reps[keep]), pa.array(links[keep]), pa.array(roots[keep])], names=names)

    return groups.groupBy("comp", "band", "b1", "b2").applyInArrow(run, "node bigint, linked bigint, root bigint")


def join(frame: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row: doc_id, digest (of the text), n_shingles, n_links, component_id. Links have Jaccard >= num / den."""
    spark = frame.sparkSession
    scratch = Scratch(spark, "ngrams")
    docs = frame.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    ranges = max(64, 4 * docs.rdd.getNumPartitions())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    with arrow_rows(spark, 256):
        sent = _send(docs, n, ranges).repartition(parts, "range").sortWithinPartitions("range")
        answered = scratch.save(_answer(sent), "answered")
        meta = scratch.save(_gather(answered.repartition(parts, "chunk").sortWithinPartitions("chunk")), "meta")
    scratch.drop("answered")
    active = meta.where((F.col("n") > 0) & (F.col("n_repeated").cast("long") * den >= F.col("n").cast("long") * num)).select("digest").distinct()
    named = meta.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    with arrow_rows(spark, 1000):
        sets = _sets(docs.join(active, "digest", "left_semi").select("text"), n).groupBy("s1", "s2").agg(F.first("tokens").alias("tokens"))
        # written with a number of its own for each class, since ids may name several
        classes = scratch.save(sets.join(named, ["s1", "s2"]).withColumn("n", F.size("tokens")).withColumn("node", F.monotonically_increasing_id()), "classes")
    tokens = classes.select("node", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    ordered = classes.select("node", "n", "size").join(shared, "node").where(F.size("shared").cast("long") * den >= F.col("n").cast("long") * num)
    ordered = scratch.save(ordered.select("node", "n", "size", F.transform("shared", lambda s: s["token"]).alias("tokens")), "ordered")
    needed = F.ceil(F.col("n") * num / F.lit(den)).cast("int")  # exact: n * num is far below 2**53 and den small
    prefix = ordered.select("node", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - needed + 1)).alias("token"))
    centres = prefix.groupBy("token").agg(F.min("node").alias("v"), F.max("node").alias("top")).where("v < top").drop("top")
    candidates = connected_components(prefix.join(centres, "token").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), scratch, "candidates")
    step = math.log(den / num) * 1.0001  # linked sizes fall in the same or in adjacent bands
    members = ordered.join(candidates.select("node", F.col("component").alias("comp")), "node")
    members = members.withColumn("own", F.floor(F.log("n") / F.lit(step)).cast("int"))
    members = members.withColumn("band", F.explode(F.array("own", F.col("own") - 1))).withColumn("lower", F.col("band") == F.col("own")).drop("own")
    members = scratch.save(members, "members")
    bands = members.groupBy("comp", "band").agg(F.count("*").alias("k"), F.sum(F.size("tokens").cast("long")).alias("t"), F.max("lower").alias("any_lower")).where("k > 1 and any_lower")
    bands = bands.select("comp", "band", F.greatest(F.ceil(F.col("k") / F.lit(BLOCK)), F.ceil(F.col("t") / F.lit(BLOCK_TOKENS))).cast("int").alias("blocks"))
    dealt = members.join(bands, ["comp", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("comp", "band", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "node", "n", "size", "tokens", "lower", "block")
    # by all four keys: rows dealt by (comp, band) already would keep every block pair of a group in one task
    dealt = dealt.repartition(parts, "comp", "band", "b1", "b2")
    linked = scratch.save(_verify(dealt, num, den), "linked")
    scratch.drop("members", "ordered")
    sums = linked.groupBy("node").agg(F.sum("linked").alias("linked"))
    parts_of = scratch.save(connected_components(linked.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct(), scratch, "components"), "parts_of")
    least = parts_of.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    reached = classes.select("s1", "s2", "node").join(sums, "node", "left").join(parts_of.join(least, "component").select("node", "least"), "node", "left")
    told = named.join(reached, ["s1", "s2"], "left").select("s1", "s2", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("least", "rep").alias("component"))
    out = meta.join(told, ["s1", "s2"], "left")
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = scratch.save(out.select(
        "doc_id", "digest", F.col("n").cast("long").alias("n_shingles"), F.when(real, F.col("links")).otherwise(0).cast("long").alias("n_links"),
        F.when(real, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    ), "rows")
    return _by_id(out, scratch)


def _by_id(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with components united that hold texts of one id."""
    several = rows.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("v"), F.max("component_id").alias("top")).where("v < top").drop("top")
    if several.isEmpty():
        return rows
    ends = rows.where("n_shingles > 0").join(several, "doc_id").where("component_id <> v").select(F.col("component_id").alias("u"), "v").distinct()
    united = connected_components(ends, scratch, "ids").select(F.col("node").alias("component_id"), F.col("component").alias("_least"))
    joined = rows.join(united, "component_id", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("_least", "component_id")).otherwise(F.col("component_id")))
    return joined.select(*rows.columns)
