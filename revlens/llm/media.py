"""Chroma fingerprints of audio columns, and the alignment of recordings.

Audio is cut into frames whose spectrum is folded to twelve pitch classes. Over
the integral image of these chroma frames sixteen box filters compare areas of
time and pitch; each response is quantised to two bits of Gray code, and the
sixteen codes of a frame are packed into one integer. Recordings that share
integers vote for the offset between them; at the offset with most votes the
share of differing bits over the overlap decides.

Recordings with equal fingerprints are one class and are never expanded into
pairs. Repeats of one integer in a row count once, so that silence cannot
flood the votes.

Defined results: null, malformed or too short audio has an empty fingerprint
and matches nothing; WAV files of other rates are resampled; silence has the fingerprint of all-equal areas. Repeated
rows share a class. Ties between offsets go to the smallest shift, then to the
earlier one. Other columns pass through :func:`fingerprint`.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.session import Scratch

FRAME, HOP, PITCHES = 1024, 512, 12
#: Quantiser: responses below -EDGE, below 0, below EDGE and above, as Gray code.
EDGE = 0.04
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: (kind, first pitch, pitches, frames): kinds are pitch halves, time halves, quadrants, middle pitches, middle frames.
FILTERS = [(k % 5, (5 * k) % PITCHES, (6, 12, 4, 12)[k % 4], (4, 6, 8)[k % 3]) for k in range(16)]
SPAN = max(f[3] for f in FILTERS)
#: Places of one integer that are met together.
SHARE = 4096


def _widened(raw: bytes, width: int) -> np.ndarray:
    """Samples of 8 (unsigned), 16, 24 or 32 bits between -1 and 1."""
    if width == 1:
        return (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) / 128
    if width == 3:
        parts = np.frombuffer(raw[: len(raw) // 3 * 3], dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        return ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    return np.frombuffer(raw, dtype=f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))


def resampled(signal: np.ndarray, have: int, rate: int) -> np.ndarray:
    """``signal`` at another rate: bands above the lower one's half are cut, then values are read between samples."""
    if have == rate or not len(signal):
        return signal
    taps = 32 * max(1, -(-have // rate)) + 1
    if have > rate:
        at = np.arange(taps) - taps // 2
        kernel = np.sinc(at * rate / have) * np.hanning(taps + 2)[1:-1]
        signal = np.convolve(signal, (kernel / kernel.sum()).astype(np.float32), "same")
    at = np.arange(int(len(signal) * rate / have)) * (have / rate)
    return np.interp(at, np.arange(len(signal)), signal).astype(np.float32)


def samples(raw: bytes | None, rate: int) -> np.ndarray:
    """Mono samples at ``rate`` of a WAV file of any rate, channels and 8 to 32 bits, or of bare 16-bit little-endian samples."""
    if not raw:
        return np.zeros(0, dtype=np.float32)
    if raw[:4] == b"RIFF":
        try:
            with wave.open(io.BytesIO(raw)) as f:
                data, channels, have = _widened(f.readframes(f.getnframes()), f.getsampwidth()), f.getnchannels(), f.getframerate()
        except (wave.Error, EOFError):
            return np.zeros(0, dtype=np.float32)
        return resampled(data[: len(data) // channels * channels].reshape(-1, channels).mean(1), have, rate)
    return np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2").astype(np.float32) / 32768


def chroma(signal: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12 pitch classes, each frame of unit length or zero."""
    if len(signal) < FRAME:
        return np.zeros((0, PITCHES), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1).astype(np.complex64)) ** 2
    tone = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((tone > 55) & (tone < rate * 0.45))
    fold = np.zeros((len(tone), PITCHES), dtype=np.float32)
    fold[used, np.round(12 * np.log2(tone[used] / 440)).astype(int) % PITCHES] = 1
    out = np.sqrt(power @ fold)
    length = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(length > 1e-4, out / np.maximum(length, 1e-4), 0)


def packed(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer per place where all filters fit."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, dtype=np.int32)
    image = np.zeros((len(frames) + 1, 2 * PITCHES + 1))
    image[1:, 1:] = np.concatenate([frames, frames], axis=1).cumsum(0).cumsum(1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        at = np.arange(n)
        return (image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]) / ((t1 - t0) * (p1 - p0))

    out = np.zeros(n, dtype=np.uint32)
    for kind, p, height, width in FILTERS:
        half_p, half_t = p + height // 2, width // 2
        whole = area(0, width, p, p + height)
        if kind == 0:
            response = area(0, width, p, half_p) - area(0, width, half_p, p + height)
        elif kind == 1:
            response = area(0, half_t, p, p + height) - area(half_t, width, p, p + height)
        elif kind == 2:
            response = (area(0, half_t, p, half_p) + area(half_t, width, half_p, p + height) - area(0, half_t, half_p, p + height) - area(half_t, width, p, half_p)) / 2
        elif kind == 3:
            response = area(0, width, p + height // 4, p + height - height // 4) - whole
        else:
            response = area(width // 4, width - width // 4, p, p + height) - whole
        out = out << np.uint32(2) | GRAY[np.searchsorted([-EDGE, 0.0, EDGE], response, "right")]
    return out.view(np.int32)


def fingerprint(frame: DataFrame, audio: str = "audio", rate: int = 4000, out: str = "fingerprint") -> DataFrame:
    """Replaces ``audio`` (binary) by ``out`` (array of int). Narrow."""
    kept = [c for c in frame.columns if c not in (audio, out)]
    schema = T.StructType([frame.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [packed(chroma(samples(raw.as_py(), rate), rate)) for raw in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(prints, pa.list_(pa.int32()))], names=[*kept, out])

    return frame.select(*kept, audio).mapInArrow(run, schema)


def _bit_errors(a: Column, b: Column, offset: Column) -> Column:
    """Share of differing bits where b, moved back by ``offset``, overlaps a."""
    first = F.greatest(F.lit(0), -offset)
    n = F.least(F.size(a) - first, F.size(b) - first - offset)
    pairs = F.zip_with(F.slice(a, first + 1, n), F.slice(b, first + offset + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x) / (32.0 * n)


def align(frame: DataFrame, queries: Column, row_id: str = "id", prints: str = "fingerprint", votes: int = 1, errors: float = 0.2) -> DataFrame:
    """Recordings that match those where ``queries`` holds.

    One row per query row and class of equal recordings: query_id, match_id
    (least id of the class), n_copies (rows of the class other than the query),
    offset (frames that the match is behind), n_votes, bit_error. ``votes`` and
    ``errors`` are the least votes and the most bit errors of a match; the
    overlap must be half of the shorter recording at least.
    """
    scratch = Scratch(frame.sparkSession, "media")
    rows = frame.select(F.col(row_id).alias("id"), F.col(prints).alias("fp"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & (F.size("fp") > 0))
    rows = scratch.save(rows.withColumns({"h1": F.xxhash64("fp"), "h2": F.xxhash64(F.lit(1), "fp")}), "rows")
    classes = scratch.save(rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.max("asks").alias("asks"), F.first("fp").alias("fp")), "classes")
    changes = F.filter(F.transform("fp", lambda v, i: F.struct(v.alias("v"), i.alias("at"))), lambda s: (s["at"] == 0) | (s["v"] != F.col("fp")[F.greatest(s["at"] - 1, F.lit(0))]))
    posts = classes.select("rep", "asks", F.explode(changes).alias("s")).select("rep", "asks", F.col("s.v").alias("v"), F.col("s.at").alias("at"))
    # an integer that many places hold is dealt out in shares of its places, each of which meets every place asked
    posts = scratch.save(posts, "posts")
    shares = posts.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > SHARE).select("v", F.ceil(F.col("n") / F.lit(SHARE)).cast("int").alias("shares"))
    posts = posts.join(shares, "v", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    asked = posts.where("asks").select(F.col("rep").alias("q"), "v", F.col("at").alias("q_at"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    stored = posts.select("rep", "v", "at", F.pmod(F.xxhash64("rep", "at"), F.col("shares")).cast("int").alias("share"))
    hits = asked.join(stored, ["v", "share"]).where("q <> rep").groupBy("q", "rep", (F.col("at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("n_votes"))
    best = hits.groupBy("q", "rep").agg(F.max(F.struct("n_votes", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("early"))).alias("b"))
    best = best.select("q", "rep", F.col("b.n_votes").alias("n_votes"), (-F.col("b.early")).alias("offset")).where(F.col("n_votes") >= votes)
    fps = classes.select("rep", "fp", "n")
    judged = best.join(fps, "rep").join(fps.select(F.col("rep").alias("q"), F.col("fp").alias("q_fp")), "q")
    first = F.greatest(F.lit(0), -F.col("offset"))
    overlap = F.least(F.size("q_fp") - first, F.size("fp") - first - F.col("offset"))
    judged = judged.where(overlap * 2 >= F.least(F.size("q_fp"), F.size("fp"))).withColumn("bit_error", _bit_errors(F.col("q_fp"), F.col("fp"), F.col("offset"))).where(F.col("bit_error") <= errors)
    own = classes.where("asks and n > 1").select(F.col("rep").alias("q"), "rep", (F.col("n") - 1).alias("n"), F.lit(0).alias("offset"), F.size("fp").cast("long").alias("n_votes"), F.lit(0.0).alias("bit_error"))
    found = judged.select("q", "rep", "n", "offset", "n_votes", "bit_error").unionByName(own)
    asking = rows.where("asks").join(classes.where("asks").select("h1", "h2", F.col("rep").alias("q")), ["h1", "h2"]).select("id", "q")
    return asking.join(found, "q").select(F.col("id").alias("query_id"), F.col("rep").alias("match_id"), F.col("n").alias("n_copies"), "offset", "n_votes", "bit_error")
