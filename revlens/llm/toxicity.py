"""Toxic passages by maximum-scoring segments of token log-odds.

Learning: the numbers of toxic and of clean documents that hold a token give
log-odds under a Dirichlet prior, a floor of one half plus a part shaped like
the pooled distribution; a token enters the model when its log-odds exceeds its standard error by
``z_min``. All other tokens share one negative drift, so that a long clean text
scores below zero and segment scores follow extreme-value statistics.

Scoring: one linear pass (Ruzzo and Tompa) finds all maximal segments. With
``lambda`` the positive root of E[exp(lambda * score)] = 1 over the clean
distribution, a segment of score S in a text of n tokens is expected
E = K * n * exp(-lambda * S) times by chance (Karlin and Altschul); segments of
E <= ``e_max`` are the toxic passages. The text's evidence is the sum of
-log(E) over them, and a one-dimensional logistic fit turns evidence into a
probability. The fit sees evidence of rows that did not choose the terms: the
sample is cut into folds, and each fold is scored by a model of the others.

Defined results: null and empty texts have no passage and get the base
probability; unlabelled or null-labelled rows are not learned from; several
labels of one id count as toxic if any is; without any label the score is 0.
Repeated rows score alike; columns of the frame pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.folds import labelled_sample
from revlens.llm.textscan import PUNCTUATION, chunks, words
from revlens.session import Scratch

#: Distinct labelled rows learned from, of each class (those of least hash); what the model can hold follows from it.
ROWS_PER_CLASS = 10_000
#: Parts of the sample, each scored by a model of the others for the calibration.
FOLDS = 4
PASSAGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # hashes, ascending
    weights: np.ndarray
    drift: float
    lam: float
    k: float
    e_max: float
    slope: float = 0.0
    base: float = -40.0


def maximal_segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments of a sequence that scores ``drift`` except at ``positions``; (score, first, last) by index of hit.

    Each hit starts as its own segment. A new segment is joined to the latest
    earlier one whose left sum is smaller, if that one's right sum is smaller
    too; otherwise it stays apart. Each segment keeps the place of the latest
    one with a smaller left sum, so the search skips what lies between and the
    whole pass is linear.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, place of the latest smaller left sum
    total, last = 0.0, -1
    for i, (at, score) in enumerate(zip(positions, scores, strict=True)):
        total += drift * (at - last - 1)
        left, right, first = total, total + score, i
        total, last = right, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, i, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(right - left, first, last) for left, right, first, last, _ in stack]


def _scored(chunk, model: Model) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
    """Evidence and passages (code points) of each text."""
    starts, ends, hashes, first = words(chunk, PUNCTUATION)
    if len(model.terms) and len(hashes):
        slot = np.minimum(np.searchsorted(model.terms, hashes), len(model.terms) - 1)
        hits = np.flatnonzero(model.terms[slot] == hashes)
        weight = model.weights[slot[hits]]
    else:
        hits, weight = np.zeros(0, dtype=np.int64), np.zeros(0)
    cut = np.searchsorted(hits, first)
    for k in range(len(chunk)):
        a, b = cut[k], cut[k + 1]
        if a == b:
            yield 0.0, []
            continue
        n = int(first[k + 1] - first[k])
        where, origin = hits[a:b], first[k]
        found, evidence = [], 0.0
        for score, i, j in maximal_segments((where - origin).tolist(), weight[a:b].tolist(), model.drift):
            log_e = np.log(model.k * n) - model.lam * score
            if log_e <= np.log(model.e_max):
                evidence -= log_e
                found.append((starts[where[i]], ends[where[j]], score))
        if found:
            points = np.zeros(chunk.offsets[k + 1] - chunk.offsets[k] + 1, dtype=np.int64)
            np.cumsum((chunk.text_of(k) & 0xC0) != 0x80, out=points[1:])
            found = [(int(points[s - chunk.offsets[k]]), int(points[e - chunk.offsets[k]]), float(v)) for s, e, v in found]
        yield evidence, found


def with_passages(frame: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds ``evidence``, ``score`` and ``passages``; drops ``text`` unless ``keep_text``. Narrow."""
    added = ["evidence", "score", "passages"]
    kept = [c for c in frame.columns if c not in added and (keep_text or c != text)]
    schema = T.StructType([frame.schema[c] for c in kept] + [T.StructField("evidence", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(PASSAGE))])
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text):
            evidence, found = zip(*_scored(chunk, model), strict=True)
            evidence = np.array(evidence)
            score = 1 / (1 + np.exp(-(model.base + model.slope * np.log1p(evidence))))
            passages = pa.array([[{"start": s, "end": e, "score": v} for s, e, v in x] for x in found], type=passage)
            yield pa.RecordBatch.from_arrays([chunk.column(c) for c in kept] + [pa.array(evidence), pa.array(score), passages], names=kept + added)

    return frame.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def _token_counts(labelled: DataFrame) -> DataFrame:
    """Per token and fold: toxic and clean documents that hold it (y1, y0), and its occurrences in clean ones. ``labelled``: text, toxic, fold."""
    schema = "token long, fold int, toxic int, docs long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            _, _, hashes, first = words(chunk, PUNCTUATION)
            group = chunk.column("fold").to_numpy(zero_copy_only=False) * 2 + chunk.column("toxic").to_numpy(zero_copy_only=False)
            per_text = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            for g in np.unique(group).tolist():
                own = [x for x, t in zip(per_text, group, strict=True) if t == g]
                token, inverse, docs = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True, return_counts=True)
                n = np.bincount(inverse, weights=np.concatenate([x[1] for x in own]), minlength=len(token)).astype(np.int64)
                same = lambda v, m=len(token): pa.array(np.full(m, v, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), same(g // 2), same(g % 2), pa.array(docs.astype(np.int64)), pa.array(n)], names=["token", "fold", "toxic", "docs", "n"])

    counts = labelled.mapInArrow(run, schema)
    part = lambda toxic, c: F.sum(F.when(F.col("toxic") == toxic, F.col(c)).otherwise(0))
    return counts.groupBy("token", "fold").agg(part(1, "docs").alias("y1"), part(0, "docs").alias("y0"), part(0, "n").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Base and slope by Newton steps with a slight ridge on the slope."""
    design = np.stack([np.ones(len(x)), x], axis=1)
    beta, ridge = np.zeros(2), np.array([1e-6, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (w * (y - p)) - ridge * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _root(p0: np.ndarray, weights: np.ndarray, drift: float) -> float:
    """The positive lambda with E[exp(lambda * score)] = 1."""
    rest = max(1e-12, 1 - p0.sum())

    def excess(lam: float) -> float:
        return float((p0 * np.exp(np.minimum(lam * weights, 600))).sum() + rest * np.exp(lam * drift) - 1)

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def _learned(counts: DataFrame, n1: float, n0: float, prior_floor: float, prior_strength: float, z_min: float, min_weight: float, drift: float, e_max: float) -> Model:
    """Terms, weights and segment statistics from ``counts`` (token, y1, y0, clean) of n1 toxic and n0 clean documents."""
    held, clean = counts.agg(F.sum(F.col("y1") + F.col("y0")), F.sum("clean")).first()
    prior = F.lit(prior_floor) + F.lit(prior_strength) * (F.col("y1") + F.col("y0")) / F.lit(float(held or 1))
    a1, a0 = F.col("y1") + prior, F.col("y0") + prior
    odds = F.log(a1 / (F.lit(n1) + 2 * prior - a1)) - F.log(a0 / (F.lit(n0) + 2 * prior - a0))
    scored = counts.where(F.col("y1") > 0).select("token", odds.alias("weight"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"), ((F.col("clean") + prior_floor) / F.lit(float(clean or 0) + 1)).alias("p0"))
    rows = sorted(scored.where((F.col("z") >= z_min) & (F.col("weight") >= min_weight)).select("token", "weight", "p0").collect(), key=lambda r: r["token"])
    terms = np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)
    weights, p0 = np.array([r["weight"] for r in rows], dtype=float), np.array([r["p0"] for r in rows], dtype=float)
    order = np.argsort(terms)
    lam = _root(p0, weights, drift) if len(rows) else 1.0
    k = float((p0 * np.exp(lam * weights)).sum()) if len(rows) else 1.0
    return Model(terms[order], weights[order], drift, lam, k, e_max)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, prior_floor: float = 0.5, prior_strength: float = 10.0, z_min: float = 3.0, min_weight: float = 2.0, drift: float = -0.25, e_max: float = 0.05) -> Model:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). The sample and so what reaches the driver is bounded by ``rows_per_class``; rows that repeat id and text count once."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    settings = prior_floor, prior_strength, z_min, min_weight, drift, e_max
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = labelled_sample(docs.select("doc_id", "text"), truth, "toxic", rows_per_class, 2, scratch)
    sample = scratch.save(sample.select("toxic", "text", (F.col("rank") % FOLDS).alias("fold")), "sample")
    sizes = {r["toxic"]: r["n"] for r in truth.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    held = {(r["toxic"], r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    n = [sum(v for (t, _), v in held.items() if t == toxic) for toxic in (0, 1)]
    if not all(n):
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), drift, 1.0, 1.0, e_max, 0.0, 40.0 if n[1] else -40.0)
    # one row per token with its counts of each fold, from which all models are read without another shuffle
    kinds = ("y1", "y0", "clean")
    own = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for c in kinds for k in range(FOLDS)]
    counts = scratch.save(_token_counts(sample).groupBy("token").agg(*own), "counts")

    def total(but: int | None = None) -> DataFrame:
        """Counts of all folds but one."""
        return counts.select("token", *[sum((F.col(f"{c}_{k}") for k in range(FOLDS) if k != but), F.lit(0)).alias(c) for c in kinds])

    model = _learned(total(), float(n[1]), float(n[0]), *settings)
    evidence = []
    for k in range(FOLDS):
        m = [n[t] - held.get((t, k), 0) for t in (0, 1)]
        other = _learned(total(k), float(m[1]), float(m[0]), *settings) if all(m) else model
        evidence += with_passages(sample.where(F.col("fold") == k), other).select("evidence", "toxic").collect()
    x, y = (np.array([r[c] for r in evidence], dtype=float) for c in ("evidence", "toxic"))
    share = np.array([sizes[t] / n[t] for t in (0, 1)])
    base, slope = _logistic(np.log1p(x), y, share[y.astype(int)])
    scratch.drop("known", "sample", "counts")
    return replace(model, slope=slope, base=base)
