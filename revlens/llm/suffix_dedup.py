"""Repeated byte strings, found by merging Burrows-Wheeler transforms, and their removal.

Every string of ``length`` bytes that starts in more than one place is covered,
in all its places. Equal strings have equal least hashes over their k-byte
pieces, so maximal runs of starts with one least hash ("segments") are dealt
out by it, and starts whose hash occurs once need no more work. Equal segments
are one with a weight. A bounded batch of the remaining segments is settled in
one task: the segments form two shards, each shard's rotations are sorted on
their own, and the two transforms are merged by interleave refinement. Each
round reads the symbols before the rotations in interleaved order, here words
of 40 bytes, and deals the interleave out by them stably; after m rounds it is
ordered by 40 m bytes, and the boundaries between blocks are where the common
prefix ends. Blocks left at ``length`` bytes with weight two or more are the
repeated intervals. No suffix is sorted again.

A least hash with too many segments for one task is dealt anew: its segments
are cut by the least hash over longer pieces, and at last over the whole
string, where one segment is left per hash. That keeps every task bounded, and
the result does not depend on it.

Defined results: null texts are empty; texts shorter than ``length`` are left
alone; repeated rows are places of their own, so both lose what they share.
Matches never cross documents. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.textscan import CHUNK_BYTES, Chunk, U, chunks, mix, prefix_codes, range_hash
from revlens.session import Scratch, arrow_rows

WORD = 40
#: Bytes of segments that are merged together, and bytes beyond which one hash is dealt anew.
BATCH, HOT = 60_000, 1_000_000
END = 0xFF  # never a byte of UTF-8


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done, span = values, 1
    while span * 2 <= width:
        done = np.minimum(done[:-span], done[span:])
        span *= 2
    rest = width - span
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def segments(chunk: Chunk, length: int, piece: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one least hash: document, first start in it, number of starts, key, hash of the bytes; and keys met twice within one window."""
    none = np.zeros(0, dtype=np.int64)
    data, offsets = chunk.data, chunk.offsets
    if len(data) < length:
        return none, none, none, none.view(U), none.view(U), none.view(U)
    sums, down = prefix_codes(data)
    at = np.arange(len(data) - piece + 1)
    hashes = range_hash(sums, down, at, at + piece) if piece < length else mix(range_hash(sums, down, at, at + piece))
    width = length - piece + 1
    least = _least(hashes, width)
    size = np.diff(offsets)
    valid = np.zeros(len(least) + 1, dtype=np.int8)
    long = size >= length
    valid[offsets[:-1][long]] += 1
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    start, stop = np.flatnonzero(new), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    twice = none.view(U)
    if width > 1 and len(start):
        top = np.where(valid, least, U(0))
        padded = np.concatenate([np.zeros(width - 1, dtype=U), top, np.zeros(width - 1, dtype=U)])
        chosen = np.flatnonzero(hashes == ~_least(~padded, width))
        value = hashes[chosen]
        twice = value[1:][(value[1:] == value[:-1]) & (np.diff(chosen) < width)]
    return doc, start - offsets[doc], stop - start, least[start], range_hash(sums, down, start, stop + length - 1), twice


def _runs(units: DataFrame, length: int, piece: int) -> DataFrame:
    """``units`` (u1, u2, weight, body) -> one row per segment; rows with n = 0 only raise their key's count."""
    names = ["u1", "u2", "weight", "key", "seg", "j0", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "body", CHUNK_BYTES // 2):
            doc, j0, n, key, seg, twice = segments(chunk, length, piece)
            u1, u2, weight = (chunk.column(c).to_numpy() for c in ("u1", "u2", "weight"))
            doc = np.append(doc, np.zeros(len(twice), dtype=np.int64))
            pad = np.zeros(len(twice), dtype=np.int64)
            key = np.append(key, twice).view(np.int64)
            seg = np.append(seg, twice).view(np.int64)
            columns = [u1[doc], u2[doc], np.append(weight[doc[: len(j0)]], pad + 1), key, seg, np.append(j0, pad).astype(np.int32), np.append(n, pad).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return units.select("u1", "u2", "weight", "body").mapInArrow(run, "u1 long, u2 long, weight long, key long, seg long, j0 int, n int")


def _dense(values: np.ndarray) -> np.ndarray:
    codes = np.unique(values, return_inverse=True)[1].reshape(-1)
    return codes.astype(np.uint16 if len(values) <= 65536 else np.uint32)


def _ahead(codes: np.ndarray, sizes: list[int], shift: int) -> np.ndarray:
    """Codes ``shift`` places on, around the end of each shard."""
    return np.concatenate([np.roll(part, -shift) for part in np.split(codes, np.cumsum(sizes)[:-1])])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = np.uint32 if a.dtype == np.uint16 else np.uint64
    return _dense(a.astype(wide) << wide(8 * a.dtype.itemsize) | b)


def _words(shards: list[np.ndarray]) -> list[np.ndarray]:
    """Order-preserving codes, common to the shards, of the WORD bytes from each place on."""
    sizes = [len(s) for s in shards]
    codes8 = np.zeros(sum(sizes), dtype=U)
    text = np.concatenate(shards)
    for i in range(8):
        codes8 = codes8 << U(8) | _ahead(text, sizes, i)
    codes8 = _dense(codes8)
    codes16 = _pair(codes8, _ahead(codes8, sizes, 8))
    codes32 = _pair(codes16, _ahead(codes16, sizes, 16))
    return np.split(_pair(codes32, _ahead(codes8, sizes, 32)), [sizes[0]])


def _order(words: np.ndarray, length: int) -> np.ndarray:
    """One shard's rotations by their first ``length`` bytes, by doubling of its own words."""
    size, codes, span = [len(words)], words, WORD
    while span < length:
        shift = min(span, length - span)
        codes = _pair(codes, _ahead(codes, size, shift))
        span += shift
    return np.argsort(codes, kind="stable")


def merge(shards: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Per shard and place, the block of rotations that agree on ``length`` bytes."""
    words = _words(shards)
    orders = [_order(w, length) for w in words]
    before = [np.roll(w, WORD)[o] for w, o in zip(words, orders, strict=True)]  # the transform: the word before each rotation
    interleave = np.repeat(np.array([False, True]), [len(s) for s in shards])
    block = np.zeros(len(interleave), dtype=np.int64)
    symbol = np.empty(len(interleave), dtype=words[0].dtype)
    for _ in range(0, length, WORD):
        symbol[~interleave], symbol[interleave] = before
        dealt = np.argsort(symbol, kind="stable")
        interleave, symbol_now, block = interleave[dealt], symbol[dealt], block[dealt]
        boundary = (symbol_now[1:] != symbol_now[:-1]) | (block[1:] != block[:-1])
        block = np.concatenate([[0], np.cumsum(boundary)])
    out = []
    for k, order in enumerate(orders):
        own = np.empty(len(order), dtype=np.int64)
        own[order] = block[interleave == bool(k)]
        out.append(own)
    return out


def repeated_intervals(bodies: list[bytes], weights: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Per segment, the intervals of starts whose string has total weight two or more."""
    half = (len(bodies) + 1) // 2 if len(bodies) > 1 else 1
    gap = bytes([END]) * WORD
    shards = [np.frombuffer(gap + gap.join(part) + gap, dtype=np.uint8) for part in (bodies[:half], bodies[half:])]
    blocks = merge(shards, length)
    spans, at = [], 0
    for k, body in enumerate(bodies):
        if k in (0, half):
            at = WORD
        own = blocks[0 if k < half else 1]
        spans.append(own[at : at + len(body) - length + 1])
        at += len(body) + WORD
    every = np.concatenate(spans)
    total = np.bincount(every, weights=np.repeat(np.array(weights, dtype=float), [len(s) for s in spans]))
    out = []
    for span in spans:
        hit = np.concatenate([[False], total[span] >= 2, [False]])
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def _merged(parts: DataFrame, length: int) -> DataFrame:
    """``parts`` (key, seg, weight, body) sorted by key -> (key, seg, starts): batches of whole keys are merged."""
    intervals = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def settle(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        found = repeated_intervals([r[3] for r in rows], [r[2] for r in rows], length)
        keep = [(r[0], r[1], [{"a": a, "b": b} for a, b in f]) for r, f in zip(rows, found, strict=True) if f]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.int64()), pa.array([k[2] for k in keep], intervals)], names=["key", "seg", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, int, bytes]] = []
        waiting: list[tuple[int, int, int, bytes]] = []
        held = grown = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "seg", "weight", "body")], strict=True):
                if group and row[0] != group[-1][0]:
                    if waiting and held + grown > BATCH:
                        yield settle(waiting)
                        waiting, held = [], 0
                    waiting, held, group, grown = waiting + group, held + grown, [], 0
                group.append(row)
                grown += len(row[3]) + WORD
        if waiting and held + grown > BATCH:
            yield settle(waiting)
            waiting = []
        if waiting or group:
            yield settle(waiting + group)

    return parts.select("key", "seg", "weight", "body").mapInArrow(run, "key long, seg long, starts array<struct<a:int,b:int>>")


def _cut(units: DataFrame, owned: DataFrame, length: int) -> DataFrame:
    """Bytes of the segments that each unit owns. ``owned``: (u1, u2, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, parts in zip(batch.column("body"), batch.column("parts").to_pylist(), strict=True):
                raw = body.as_buffer().to_pybytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[c] for p in parts], t) for c, t in (("key", pa.int64()), ("seg", pa.int64()), ("weight", pa.int64()), ("hot", pa.bool_()))]
                    + [pa.array([raw[p["j0"] : p["j0"] + p["n"] + length - 1] for p in parts], pa.binary())],
                    names=["key", "seg", "weight", "hot", "body"],
                )

    joined = units.select("u1", "u2", "body").join(owned, ["u1", "u2"]).select("body", "parts")
    return joined.mapInArrow(run, "key long, seg long, weight long, hot boolean, body binary")


def _united(told: DataFrame) -> DataFrame:
    """Adjacent and overlapping intervals of each unit's sorted ``starts`` as one."""
    intervals = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts in batch.column(2).to_pylist():
                own: list[dict[str, int]] = []
                for s in starts:
                    if own and s["a"] <= own[-1]["b"]:
                        own[-1]["b"] = max(own[-1]["b"], s["b"])
                    else:
                        own.append(s)
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, intervals)], names=["u1", "u2", "starts"])

    return told.select("u1", "u2", "starts").mapInArrow(run, "u1 long, u2 long, starts array<struct<a:int,b:int>>")


def _pieces(length: int) -> list[int]:
    """Lengths of the hashed pieces, from the first dealing to the last."""
    return sorted({max(1, length * 28 // 100), length * 3 // 4, length})


def _repeats(units: DataFrame, scratch: Scratch, length: int, hot_bytes: int, level: int = 0) -> DataFrame:
    """(u1, u2, starts): for each unit, intervals of starts of strings that start elsewhere too."""
    spark, pieces = scratch.spark, _pieces(length)
    runs = scratch.save(_runs(units, length, pieces[level]), f"runs{level}")
    often = runs.groupBy("key").agg(F.sum("weight").alias("places")).where("places > 1").select("key")
    active = scratch.save(runs.where("n > 0").join(often, "key"), f"active{level}")
    scratch.drop(f"runs{level}")
    parts = active.groupBy("key", "seg").agg(F.sum("weight").alias("weight"), F.min(F.struct("u1", "u2", "j0", "n")).alias("owner"))
    sizes = active.groupBy("key", "seg").agg(F.max("n").alias("n"), F.sum("weight").alias("weight")).groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + F.lit(length - 1 + WORD)).alias("bytes"), F.max("weight").alias("most"))
    alone = (F.col("kinds") == 1) & (F.col("most") > 1)  # one segment, met more than once: all its starts are repeated
    judged = scratch.save(parts.join(sizes, "key").select("key", "seg", "weight", "owner", alone.alias("alone"), ((F.col("bytes") > hot_bytes) & F.lit(level + 1 < len(pieces))).alias("hot")), f"parts{level}")
    owned = judged.where(~F.col("alone")).select(F.col("owner.u1").alias("u1"), F.col("owner.u2").alias("u2"), F.struct("key", "seg", "weight", "hot", F.col("owner.j0").alias("j0"), F.col("owner.n").alias("n")).alias("part"))
    owned = owned.groupBy("u1", "u2").agg(F.collect_list("part").alias("parts"))
    with arrow_rows(spark, 500):
        bodies = scratch.save(_cut(units.dropDuplicates(["u1", "u2"]) if level else units, owned, length).dropDuplicates(["key", "seg"]), f"bodies{level}")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = bodies.where(~F.col("hot")).repartition(count, "key").sortWithinPartitions("key", "seg")
    with arrow_rows(spark, 2000):
        found = scratch.save(_merged(cold, length), f"found{level}")
    found = found.unionByName(judged.where("alone").select("key", "seg", F.array(F.struct(F.lit(0).alias("a"), F.col("owner.n").alias("b"))).alias("starts")))
    hot = bodies.where("hot").select(F.col("key").alias("u1"), F.col("seg").alias("u2"), "weight", "body")
    if level + 1 < len(pieces) and not hot.isEmpty():
        deeper = _repeats(hot, scratch, length, hot_bytes, level + 1)
        found = found.unionByName(deeper.select(F.col("u1").alias("key"), F.col("u2").alias("seg"), "starts"))
    told = active.select("key", "seg", "u1", "u2", "j0").join(found, ["key", "seg"])
    told = told.select("u1", "u2", F.explode(F.transform("starts", lambda s: F.struct((s["a"] + F.col("j0")).alias("a"), (s["b"] + F.col("j0")).alias("b")))).alias("s"))
    told = told.groupBy("u1", "u2", "s").agg(F.lit(1).alias("one")).groupBy("u1", "u2").agg(F.sort_array(F.collect_list("s")).alias("starts"))
    return scratch.save(_united(told), f"told{level}")


def _digest(body: Column) -> list[Column]:
    return [F.xxhash64(body).alias("u1"), F.xxhash64(F.lit("b"), body).alias("u2")]


def dedup(frame: DataFrame, text: str = "text", length: int = 200, hot_bytes: int = HOT) -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (removed bytes, end exclusive) and ``kept`` (binary) in place of ``text``."""
    if length % WORD:
        raise ValueError(f"length must be a multiple of {WORD}")
    scratch = Scratch(frame.sparkSession, "suffixes")
    added = ["n_bytes", "n_removed", "n_spans", "spans", "kept"]
    kept = [c for c in frame.columns if c not in [*added, text]]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    units = frame.select(body.alias("body")).select("body", *_digest(F.col("body")), F.lit(1).cast("long").alias("weight")).where(F.octet_length("body") >= length)
    found = _repeats(units, scratch, length, hot_bytes)
    base = frame.select(*kept, body.alias("_body")).select("*", F.xxhash64("_body").alias("_u1"), F.xxhash64(F.lit("b"), "_body").alias("_u2"))
    joined = base.join(found.select(F.col("u1").alias("_u1"), F.col("u2").alias("_u2"), F.col("starts").alias("_starts")), ["_u1", "_u2"], "left").select(*kept, "_body", "_starts")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([frame.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in added[:3]] + [T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            sizes, removed, spans, left = [], [], [], []
            for raw, starts in zip(batch.column(len(kept)), batch.column(len(kept) + 1).to_pylist(), strict=True):
                data = raw.as_buffer().to_pybytes()
                own: list[list[int]] = []
                for s in sorted((s["a"], s["b"] + length - 1) for s in starts or ()):
                    if own and s[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], s[1])
                    else:
                        own.append(list(s))
                edges = [0, *[e for s in own for e in s], len(data)]
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in own))
                spans.append([{"start": a, "end": b} for a, b in own])
                left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, spans_type), pa.array(left, pa.binary())], names=kept + added)

    return joined.mapInArrow(run, schema)
