"""Aligning the two revisions: descriptor matches and the homography between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEST, LEAST_MATCHES, LEAST_INLIERS, LEAST_RATIO, REPROJECTION = 300, 4, 40, 0.15, 3.0
HOMOGRAPHY = [f"h{i}{j}" for i in range(3) for j in range(3)]


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of descriptors held as 64-bit words."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def mutual_matches(a: DataFrame, b: DataFrame, words: list[str]) -> DataFrame:
    """Pairs (kp_a, kp_b) of a drawing that are each other's nearest descriptor, the first of equals.

    All pairs of a drawing are compared: a detector gives a page a bounded
    number of key points (some thousands), and only two minima leave each task.
    """
    left = a.select("drawing_id", F.col("kp_id").alias("kp_a"), *[F.col(w).alias(f"a_{w}") for w in words])
    right = b.select("drawing_id", F.col("kp_id").alias("kp_b"), *[F.col(w).alias(f"b_{w}") for w in words])
    pairs = left.join(right, "drawing_id").select("drawing_id", "kp_a", "kp_b", hamming([F.col(f"a_{w}") for w in words], [F.col(f"b_{w}") for w in words]).alias("dist"))
    of_a = pairs.groupBy("drawing_id", "kp_a").agg(F.min(F.struct("dist", "kp_b")).alias("m")).select("drawing_id", "kp_a", "m.kp_b", "m.dist")
    of_b = pairs.groupBy("drawing_id", "kp_b").agg(F.min(F.struct("dist", "kp_a")).alias("m")).select("drawing_id", "m.kp_a", "kp_b")
    return of_a.join(of_b, ["drawing_id", "kp_a", "kp_b"])


def best_matches(matches: DataFrame, k: int = BEST) -> DataFrame:
    order = W.partitionBy("drawing_id").orderBy("dist", "kp_a", "kp_b")
    return matches.withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= k)


def inlier_stats(points: DataFrame) -> DataFrame:
    """Inliers and their share per drawing, of rows with a flag ``inlier``."""
    flag = F.col("inlier").cast("int")
    return points.groupBy("drawing_id").agg(F.sum(flag).alias("inliers"), (F.sum(flag) / F.count("*")).alias("inlier_ratio"), F.count("*").alias("n_matches"))


def quality_ok() -> Column:
    return (F.col("n_matches") >= LEAST_MATCHES) & (F.col("inliers") >= LEAST_INLIERS) & (F.col("inlier_ratio") >= LEAST_RATIO)


def require_quality(transforms: DataFrame) -> DataFrame:
    """Fails where an alignment is not trusted."""
    return transforms.withColumn("quality_ok", F.when(quality_ok(), True).otherwise(F.raise_error(F.lit("Alignment failed")).cast("boolean")))


def _solve(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Direct linear transform on normalised points."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = p.mean(0)
        scale = np.sqrt(2) / max(np.sqrt(((p - mean) ** 2).sum(1)).mean(), 1e-9)
        t = np.array([[scale, 0, -scale * mean[0]], [0, scale, -scale * mean[1]], [0, 0, 1]])
        return (p - mean) * scale, t

    (a, ta), (b, tb) = normal(src), normal(dst)
    x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    zero, one = np.zeros(len(a)), np.ones(len(a))
    rows = np.concatenate([np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], 1), np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], 1)])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def _errors(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    p = np.c_[src, np.ones(len(src))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.hypot(*(p[:, :2] / p[:, 2:] - dst).T), nan=np.inf)


def ransac(src: np.ndarray, dst: np.ndarray, threshold: float = REPROJECTION, rounds: int = 2000, seed: int = 7) -> tuple[np.ndarray | None, np.ndarray]:
    """Homography with most points within ``threshold``, refitted to them; the seed is fixed."""
    best = np.zeros(len(src), dtype=bool)
    if len(src) < LEAST_MATCHES:
        return None, best
    rng, k = np.random.default_rng(seed), 0
    limit = rounds
    while k < limit:
        k += 1
        pick = rng.choice(len(src), 4, replace=False)
        h = _solve(src[pick], dst[pick])
        if h is None:
            continue
        inside = _errors(h, src, dst) <= threshold
        if inside.sum() > best.sum():
            best = inside
            share = min(0.999, inside.mean()) ** 4
            limit = min(rounds, int(np.ceil(np.log(0.001) / np.log(max(1e-12, 1 - share)))) if share > 0 else rounds)
    if best.sum() < 4:
        return None, best
    return _solve(src[best], dst[best]), best


def homographies(points: DataFrame) -> DataFrame:
    """One transform per drawing from matched points (drawing_id, ax, ay, bx, by), at most the best few hundred each."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ax", "ay", "bx", "by"])
        h, inside = ransac(rows[["ax", "ay"]].to_numpy(float), rows[["bx", "by"]].to_numpy(float))
        flat = (np.full(9, np.nan) if h is None else h.reshape(-1)).tolist()
        return pd.DataFrame([[key[0], *flat, int(inside.sum()), float(inside.mean()) if len(rows) else 0.0, len(rows)]], columns=["drawing_id", *HOMOGRAPHY, "inliers", "inlier_ratio", "n_matches"])

    schema = "drawing_id bigint, " + ", ".join(f"{h} double" for h in HOMOGRAPHY) + ", inliers int, inlier_ratio double, n_matches int"
    return points.groupBy("drawing_id").applyInPandas(run, schema).withColumn("quality_ok", quality_ok())


def registered(chain, table, query):
    def keypoints(s, d, odd):
        rows = s.read.parquet(f"{d}/embeddings.parquet").where(F.col("vec_id") % 2 == odd)
        return rows.select(F.col("label").alias("drawing_id"), F.col("vec_id").alias("kp_id"), sign_bits().alias("d0"))

    def sign_bits():
        # 62 sign bits in one word: powers of two below 2**62 are exact
        return F.aggregate(F.slice("embedding", 1, 62), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))

    matches = lambda s, d: mutual_matches(keypoints(s, d, 0), keypoints(s, d, 1), ["d0"])
    bits = "list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:62], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END)), lambda a, b: a * 2 + b)"
    base = f"""WITH kp AS (SELECT label AS drawing_id, vec_id, {bits} AS d0 FROM embeddings),
      pairs AS (SELECT a.drawing_id, a.vec_id AS kp_a, b.vec_id AS kp_b, bit_count(xor(a.d0, b.d0))::INT AS dist FROM kp a JOIN kp b USING (drawing_id) WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, kp_a ORDER BY dist, kp_b) AS ra, row_number() OVER (PARTITION BY drawing_id, kp_b ORDER BY dist, kp_a) AS rb FROM pairs),
      mutual AS (SELECT drawing_id, kp_a, kp_b, dist FROM ranked WHERE ra = 1 AND rb = 1)"""
    moved = lambda s, d: table(s, d, "placed").join(table(s, d, "transforms"), "drawing_id").select("drawing_id", (F.col("k") % 3 != 0).alias("inlier"))
    stats = "SELECT drawing_id, sum((k % 3 <> 0)::INT)::BIGINT AS inliers, round(avg((k % 3 <> 0)::INT::DOUBLE), 6) AS inlier_ratio FROM placed GROUP BY drawing_id"

    def shifted(s, d):
        """Points of each customer nation's orders, moved by a known shift, every ninth one wrong."""
        rows = s.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 7).alias("drawing_id"), (F.col("o_orderkey") % 997).cast("double").alias("ax"), (F.col("o_orderkey") * 31 % 1009).cast("double").alias("ay"), F.col("o_orderkey").alias("key"))
        rows = rows.withColumn("match_rank", F.row_number().over(W.partitionBy("drawing_id").orderBy("key", "ax"))).where(F.col("match_rank") <= BEST)
        wrong = F.col("match_rank") % 9 == 0
        return rows.select("drawing_id", "ax", "ay", F.when(wrong, F.col("ay")).otherwise(F.col("ax") + 40).alias("bx"), F.when(wrong, F.col("ax") / 2).otherwise(F.col("ay") - 25).alias("by"))

    def found(s, d):
        h = homographies(shifted(s, d))
        return h.select("drawing_id", F.round("h02", 1).alias("shift_x"), F.round("h12", 1).alias("shift_y"), F.col("quality_ok"))

    return {
        "J11_descriptor_match": (lambda s, d: matches(s, d).select("drawing_id", "kp_a", "kp_b", F.col("dist").cast("int").alias("dist")), base + " SELECT * FROM mutual"),
        "W3_feature_topk": (lambda s, d: best_matches(matches(s, d)).select("drawing_id", "kp_a", "kp_b", "match_rank"), base + " SELECT drawing_id, kp_a, kp_b, match_rank FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY dist, kp_a, kp_b)::INT AS match_rank FROM mutual) WHERE match_rank <= 300"),
        "A8_inlier_stats": (lambda s, d: inlier_stats(moved(s, d)).select("drawing_id", "inliers", F.round("inlier_ratio", 6).alias("inlier_ratio")), query(stats)),
        "F13_alignment_quality": (lambda s, d: table(s, d, "transforms").withColumn("inlier_ratio", F.col("inliers") / F.col("n_matches")).where(quality_ok()).select("drawing_id", "inliers"), query("SELECT drawing_id, inliers FROM transforms WHERE n_matches >= 4 AND inliers >= 40 AND inliers / n_matches >= 0.15")),
        "I3_ransac_homography": (found, "SELECT DISTINCT o_custkey % 7 AS drawing_id, 40.0::DOUBLE AS shift_x, -25.0::DOUBLE AS shift_y, true AS quality_ok FROM orders"),
    }
