"""Language identification with a string kernel.

Kernel: the cosine of presence vectors over the blended spectrum of letter
1-, 2- and 3-grams (runs of other characters are one word boundary). Training
takes a bounded sample per language; some of it are Nystroem landmarks, and
one-versus-rest kernel ridge regression is solved in the space they span. The
landmark part of the score is linear in the presence vector, so a batch of
texts is scored by one product of its presence matrix with the landmark
expansion.

Defined results: null texts and texts without a letter are ``und`` with score
0; with nothing to learn from every text is; more than ``MAX_LANGUAGES`` languages
are an error. Equal scores take the first
language in code order. Rows whose language is null are not learned from.
Repeated rows are scored alike; columns of the frame pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.byte_bpe import LETTER, code_point_classes
from revlens.llm.folds import least_hashed, row_key
from revlens.llm.textscan import Chunk, chunks
from revlens.session import Scratch

#: Sampled rows and landmarks per language (distinct rows of least hash).
ROWS_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 256, 64
#: Landmarks of all languages together; many languages share them evenly.
LANDMARKS = 4096
#: Languages that are learned; more is an error, since the model of each is kept by the driver and every worker.
MAX_LANGUAGES = 500
#: Bits of a code point in an n-gram's code, and what stands where a shorter n-gram has none.
BITS, ONE, TWO = 21, 0x1FFFFE, 0x1FFFFF
#: Cells of a direct table of n-grams; a model with more letters looks its n-grams up by search.
TABLE = 1 << 24
#: Cells of a presence matrix.
CELLS = 1 << 24


@dataclass(frozen=True)
class Model:
    grams: np.ndarray  # codes of the landmarks' n-grams, ascending
    weights: np.ndarray  # n-gram x language
    languages: list[str]


def _joined(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    texts = [chunk.text_of(k).tobytes().decode("utf-8").lower() for k in range(len(chunk))]
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    return points, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)


def _neighbours(points: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of letters, and the codes before, at and after them; ``letter`` is each code point's code, 0 for none."""
    c = letter[points]
    here = np.flatnonzero(c)
    return here, np.where(here > 0, c[here - 1], 0), c[here], c[np.minimum(here + 1, len(c) - 1)]


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.where(code_point_classes() == LETTER, np.arange(0x110000), 0))
    return _LETTERS[0]


def _spectrum(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams and the position each is at; every letter is told apart."""
    here, before, mid, after = _neighbours(points, _letters())
    code = lambda a, b, c: (a << (2 * BITS)) | (b << BITS) | c
    return np.concatenate([code(ONE, 0, mid), code(TWO, mid, after), code(before, mid, after)]), np.concatenate([here, here, here])


class Lookup:
    """Positions of texts' n-grams among a model's, counted from 1; 0 for others."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        parts = [(grams >> (BITS * k)) & ((1 << BITS) - 1) for k in (2, 1, 0)]
        known = np.unique(np.concatenate(parts)) if len(grams) else np.zeros(0, dtype=np.int64)
        known = known[(known > 0) & (known < ONE)]
        self.side = len(known) + 2  # 0 for no letter, the last for letters of no landmark
        self.table = None
        if self.side**3 + self.side**2 + self.side <= TABLE:
            self.letter = np.where(_letters() > 0, self.side - 1, 0)
            self.letter[known] = np.arange(1, len(known) + 1)
            a, b, c = (np.where(p < ONE, self.letter[np.minimum(p, 0x10FFFF)], 0) for p in parts)
            self.table = np.zeros(self.side**3 + self.side**2 + self.side, dtype=np.int32)
            at = np.where(parts[0] == ONE, c, np.where(parts[0] == TWO, self._two(b, c), self._three(a, b, c)))
            self.table[at] = np.arange(1, len(grams) + 1)

    def _two(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.side + b * self.side + c

    def _three(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.side + self.side**2 + (a * self.side + b) * self.side + c

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each n-gram is among the model's, and its position in the text."""
        if self.table is not None:
            here, before, mid, after = _neighbours(points, self.letter)
            return self.table[np.concatenate([mid, self._two(mid, after), self._three(before, mid, after)])], np.concatenate([here, here, here])
        codes, at = _spectrum(points)
        if not len(self.grams):
            return np.zeros(len(codes), dtype=np.int64), at
        near = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        return np.where(self.grams[near] == codes, near + 1, 0), at


def _gram_sets(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            points, ends = _joined(chunk)
            codes, at = _spectrum(points)
            row = np.searchsorted(ends, at, "right")
            sets = [np.unique(codes[row == k]) for k in range(len(chunk))]
            yield pa.RecordBatch.from_arrays([chunk.column("lang"), chunk.column("rank"), pa.array(sets, type=pa.list_(pa.int64()))], names=["lang", "rank", "grams"])

    return sample.mapInArrow(run, "lang string, rank int, grams array<bigint>")


def solve(sets: list[np.ndarray], target: np.ndarray, marks: list[int], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the landmarks and their weights per language: kernel ridge regression in the space that the landmarks span.

    min over a of |C a - Y|^2 + ridge n a' K a with C the kernel of rows and
    landmarks, K that of landmarks; a row's kernel with a landmark is linear in
    the row's presence vector. Products are summed over blocks of n-grams, so
    no dense matrix of rows and n-grams is held.
    """
    grams = np.unique(np.concatenate([sets[k] for k in marks]))
    length = np.sqrt(np.array([max(1, np.isin(s, grams, assume_unique=True).sum()) for s in sets]))
    place = [np.searchsorted(grams, np.intersect1d(grams, s, assume_unique=True)) for s in sets]

    def block(first: int, last: int) -> np.ndarray:
        out = np.zeros((len(sets), last - first), dtype=np.float32)
        for k, p in enumerate(place):
            a, b = np.searchsorted(p, [first, last])
            out[k, p[a:b] - first] = 1 / length[k]
        return out

    width = max(1, CELLS // len(sets))
    cuts = [(a, min(len(grams), a + width)) for a in range(0, len(grams), width)]
    cross = np.zeros((len(sets), len(marks)))
    for a, b in cuts:
        part = block(a, b)
        cross += part @ part[marks].T
    inner = cross[marks]
    alpha = np.linalg.lstsq(cross.T @ cross + ridge * len(sets) * inner + 1e-9 * np.eye(len(marks)), cross.T @ target, rcond=None)[0]
    return grams, np.concatenate([block(a, b)[marks].T.astype(float) @ alpha for a, b in cuts])


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = 1e-3) -> Model:
    """Learns from ``docs`` (doc_id, text, lang). The driver gets the n-gram sets of ``rows`` texts per language; a text that repeats under one id counts once."""
    scratch = Scratch(docs.sparkSession, "language")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", row_key().alias("key"))
    chosen = least_hashed(known, "lang", rows, MAX_LANGUAGES)
    sample = known.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key", "rank").agg(F.first("text").alias("text"))
    sample = scratch.save(sample, "sample")
    got = sorted(((r["lang"], r["rank"], np.array(r["grams"])) for r in _gram_sets(sample).where(F.size("grams") > 0).collect()), key=lambda r: r[:2])
    scratch.drop("sample")
    if not got:
        return Model(np.zeros(0, dtype=np.int64), np.zeros((0, 0)), [])
    languages = sorted({r[0] for r in got})
    each = max(1, min(landmarks, LANDMARKS // len(languages)))
    marks = [k for k, r in enumerate(got) if k < each or got[k - each][0] != r[0]]
    target = np.where(np.array([r[0] for r in got])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    return Model(*solve([r[2] for r in got], target, marks, ridge), languages)


def predict(frame: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replaces ``text`` by ``lang_pred`` and ``score``. Narrow."""
    added = ["lang_pred", "score"]
    kept = [c for c in frame.columns if c != text and c not in added]
    schema = T.StructType([frame.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = Lookup(model.grams)
        weights = model.weights.astype(np.float32)
        names = np.array(["und", *model.languages], dtype=object)
        for chunk in chunks(batches, text, rows=max(16, CELLS // (len(model.grams) + 1))):
            points, ends = _joined(chunk)
            found, at = lookup.find(points)
            present = np.zeros((len(chunk), len(model.grams) + 1), dtype=np.float32)
            rows = np.repeat(np.arange(len(chunk)), np.diff(ends, prepend=0))
            present[rows[at], found] = 1
            lettered = present.any(axis=1)
            present = present[:, 1:]
            if model.languages:
                values = (present @ weights).astype(float) / np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
                best = values.argmax(axis=1)
                score = np.clip((values[np.arange(len(chunk)), best] + 1) / 2, 0, 1)
            else:
                best, score, lettered = np.zeros(len(chunk), dtype=int), np.zeros(len(chunk)), np.zeros(len(chunk), dtype=bool)
            columns = [chunk.column(c) for c in kept] + [pa.array(names[np.where(lettered, best + 1, 0)], type=pa.string()), pa.array(np.where(lettered, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=kept + added)

    return frame.select(*kept, text).mapInArrow(run, schema)
