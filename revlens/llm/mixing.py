"""Mixing documents to target domain weights by soft membership.

A classifier learned from a labelled table (softmax regression on presence of
hashed byte 3-grams) gives every document a posterior over domains. Rates
r >= 0 are then fitted so that the expected tokens of each domain,
sum_d r_d * tokens_d * posterior_dk, meet its target, by projected gradient on
the weighted least squares

    min_r>=0  1/2 res' S res,   res = (sum_d t_d r_d p_d - target) / sum_d t_d

from r = 1. S is the inverse second moment of the posteriors, which makes a
step of length one stable. A document's rate depends on the documents only
through the K-vectors S res of the rounds so far, so no rate is ever stored or
shuffled: a round is one scan of (tokens, posterior) with a sum of K numbers.

Defined results: null and empty texts have the classifier's prior posterior
and no tokens; their rate is fitted alike. With no labelled row there is one
domain, ``all``. Labels of one id are united: the least domain name counts.
Repeated rows are documents of their own. A domain without mass in the corpus
has no reachable target and is left out of the fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.folds import labelled_sample
from revlens.llm.textscan import LOWER, Chunk, chunks, words
from revlens.session import Scratch

#: Distinct rows per domain that the classifier learns from (those of least hash), and domains; more domains are an error.
ROWS_PER_DOMAIN, MAX_DOMAINS = 256, 256
FEATURES = 4096
#: Texts whose presence vectors are held together, 16 MB of them.
ROWS = 1024
Target = Callable[[np.ndarray, list[str]], np.ndarray]


@dataclass(frozen=True)
class Mixer:
    domains: list[str]
    weights: np.ndarray  # (FEATURES + 1) x K, the last row for the constant
    steps: list[np.ndarray] = field(default_factory=list)  # S res of each round


def _presence(chunk: Chunk) -> np.ndarray:
    """Documents x FEATURES: unit rows of 3-gram presence."""
    data, offsets = LOWER[chunk.data].astype(np.uint32), chunk.offsets
    out = np.zeros((len(chunk), FEATURES), dtype=np.float32)
    if len(data) >= 3:
        code = ((data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)).astype(np.int64)
        row = np.repeat(np.arange(len(chunk)), np.diff(offsets))[: len(code)]
        inside = np.arange(len(code)) + 3 <= offsets[row + 1]
        out[row[inside], code[inside]] = 1
    out /= np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))
    return out


def posteriors(present: np.ndarray, mixer: Mixer) -> np.ndarray:
    z = present @ mixer.weights[:-1].astype(np.float32) + mixer.weights[-1]
    e = np.exp(z - z.max(1, keepdims=True))
    return (e / e.sum(1, keepdims=True)).astype(float)


def rates(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps so far."""
    r = np.ones(len(posterior))
    for step in steps:
        r = np.maximum(0.0, r - posterior @ step)
    return r


def _softmax(x: np.ndarray, y: np.ndarray, k: int, decay: float = 1e-4, rounds: int = 300, tolerance: float = 1e-3) -> np.ndarray:
    """Softmax regression by accelerated gradient, classes weighted alike, until nothing moves by more than a share of the largest.

    Weights stay in the span of the rows, so where rows are fewer than features
    the same steps are made on the rows' coefficients, with the rows' products.
    """
    x = np.concatenate([x, np.ones((len(x), 1), dtype=np.float32)], axis=1)
    target = np.zeros((len(x), k), dtype=np.float32)
    target[np.arange(len(x)), y] = 1
    share = (1 / np.maximum(np.bincount(y, minlength=k), 1))[y, None].astype(np.float32) / k
    few = len(x) < x.shape[1]
    products = x @ x.T if few else x
    w = np.zeros((products.shape[1], k), dtype=np.float32)
    ahead, momentum = w, 1.0
    for _ in range(rounds):
        z = products @ ahead
        e = np.exp(z - z.max(1, keepdims=True))
        residual = share * (e / e.sum(1, keepdims=True) - target)
        following = ahead - (residual if few else x.T @ residual) - decay * ahead
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = following + np.float32((momentum - 1) / later) * (following - w)
        moved = float(np.abs(following - w).max())
        w, momentum = following, later
        if moved <= tolerance * float(np.abs(w).max()):
            break
    return (x.T @ w if few else w).astype(float)


def learn(docs: DataFrame, labelled: DataFrame, rows: int = ROWS_PER_DOMAIN) -> Mixer:
    """Classifier from ``docs`` (doc_id, text) and ``labelled`` (doc_id, domain)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    truth = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, rows=ROWS):
            sets = pa.array([np.flatnonzero(p).astype(np.int32) for p in _presence(chunk)], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([chunk.column("domain"), chunk.column("rank"), sets], names=["domain", "rank", "features"])

    sample = labelled_sample(docs.select("doc_id", "text").where(F.length("text") > 0), truth, "domain", rows, MAX_DOMAINS, scratch)
    got = scratch.save(sample.mapInArrow(run, "domain string, rank int, features array<int>"), "sample").collect()
    scratch.drop("known", "sample")
    got = sorted(got, key=lambda r: (r["domain"], r["rank"]))
    x = np.zeros((len(got), FEATURES), dtype=np.float32)
    for k, r in enumerate(got):
        x[k, r["features"]] = 1
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    names = sorted({r["domain"] for r in got}) or ["all"]
    weights = _softmax(x, np.array([names.index(r["domain"]) for r in got]), len(names)) if got else np.zeros((FEATURES + 1, 1))
    return Mixer(names, weights)


def assign(frame: DataFrame, mixer: Mixer, text: str = "text", keep_text: bool = False, passes: str = "repeat", salt: str = "doc_id") -> DataFrame:
    """Adds ``n_tokens``, ``posterior``, ``domain``, ``rate`` and ``copies``; drops ``text`` unless ``keep_text``. Narrow.

    ``copies`` is the rate rounded at random but reproducibly by the hash of
    ``salt``; with ``passes="repeat"`` it is at least 1, so that mixing raises
    sources and never loses a document.
    """
    added = ["n_tokens", "posterior", "domain", "rate"]
    kept = [c for c in frame.columns if c not in [*added, "copies"] and (keep_text or c != text)]
    schema = T.StructType([frame.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType(), False)), T.StructField("domain", T.StringType()), T.StructField("rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, k = np.array(mixer.domains, dtype=object), len(mixer.domains)
        for chunk in chunks(batches, text, rows=ROWS):
            p = posteriors(_presence(chunk), mixer)
            first = words(chunk)[3]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * k + 1, k, dtype=np.int32)), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([chunk.column(c) for c in kept] + [pa.array(np.diff(first)), lists, pa.array(names[p.argmax(1)], type=pa.string()), pa.array(rates(p, mixer.steps))], names=kept + added)

    out = frame.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("rate") + chance).cast("int")
    return out.withColumn("copies", F.greatest(copies, F.lit(1)) if passes == "repeat" else copies)


def _totals(soft: DataFrame, mixer: Mixer) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over all documents of t r p (K), t p p' (K x K) and t, as one row per task."""
    k, steps = len(mixer.domains), mixer.steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + 1)
        for batch in batches:
            t = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy().reshape(-1, k)
            total += np.concatenate([(t * rates(p, steps)) @ p, ((p * t[:, None]).T @ p).reshape(-1), [t.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

    rows = soft.select("n_tokens", "posterior").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(k + k * k + 1)
    for r in rows:
        flat[r["i"]] = r["x"]
    return flat[:k], flat[k:-1].reshape(k, k), float(flat[-1])


def tempered(natural: np.ndarray, domains: list[str], power: float = 0.7) -> np.ndarray:
    """Target tokens per domain: shares flattened by ``power``, at the least budget that lowers no domain."""
    share = natural / max(natural.sum(), 1e-300)
    goal = np.where(share > 0, share**power, 0.0)
    goal = goal / max(goal.sum(), 1e-300)
    budget = np.divide(share, goal, out=np.zeros_like(share), where=goal > 0).max(initial=0.0)
    return goal * budget * natural.sum()


def fit(soft: DataFrame, mixer: Mixer, target: Target = tempered, rounds: int = 25, tolerance: float = 1e-6) -> Mixer:
    """Rates for ``soft`` (n_tokens, posterior). ``target`` maps the natural token totals and the domains' names to the totals wanted."""
    mixer = replace(mixer, steps=[])
    reached, second, tokens = _totals(soft, mixer)
    if tokens <= 0:
        return mixer
    goal = np.where(reached > 0, target(reached, mixer.domains), 0.0)
    scale = np.linalg.pinv(second / tokens + 1e-9 * np.eye(len(goal)))
    for _ in range(rounds):
        residual = (reached - goal) / tokens
        if np.abs(residual).max() <= tolerance:
            break
        mixer = replace(mixer, steps=[*mixer.steps, scale @ residual])
        reached = _totals(soft, mixer)[0]
    return mixer


def mix(frame: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id", target: Target = tempered) -> Mixer:
    """Classifier and fitted rates for all rows of ``frame``."""
    docs = frame.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(frame.sparkSession, "mixing")
    mixer = learn(docs, labelled)
    soft = scratch.save(assign(docs, mixer).select("n_tokens", "posterior"), "soft")
    fitted = fit(soft, mixer, target)
    scratch.drop("soft")
    return fitted
