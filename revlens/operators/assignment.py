"""One-to-one assignment of anchors to spans, greedily by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.session import Scratch

#: What makes two spans the same place; the text is no part of it.
SPAN_KEY = ["block_id", "line_id", "span_id", "x0", "y0", "x1", "y1"]
#: Edges of a drawing that are folded in one row; a drawing with more is assigned in rounds.
FOLD_EDGES = 2000


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges numbered per drawing: best score first, then anchor order, then candidate rank."""
    order = W.partitionBy("drawing_id").orderBy(F.col("total_score").desc(), "anchor_ord", "cand_rank")
    return edges.withColumn("edge_ord", F.row_number().over(order))


def greedy(edges: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Accepted edges (drawing_id, char_no, cand_rank and what is carried): a fold over each drawing's ordered edges.

    For drawings whose edges fit one row; :func:`dominant` has no such bound.
    """
    folded = edges.groupBy("drawing_id").agg(F.sort_array(F.collect_list(_edge(carried))).alias("edges"))
    return folded.select("drawing_id", F.explode(_chosen()).alias("e")).select("drawing_id", "e.char_no", "e.cand_rank", *[f"e.{c}" for c in carried])


def greedy_anchors(edges: DataFrame, own: tuple[str, ...], carried: tuple[str, ...]) -> DataFrame:
    """Anchors, one row each, with their columns ``own`` and what is ``carried`` of the edge that :func:`greedy` accepts, if any.

    ``edges`` have a row for an anchor without candidates too, in which ``span_ord`` is null.
    """
    edge = F.when(F.col("span_ord").isNotNull(), _edge(carried))
    anchor = F.when(F.col("cand_rank") == 1, F.struct("char_no", *own))
    folded = edges.groupBy("drawing_id").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.collect_list(anchor).alias("anchors"))
    rows = folded.select("drawing_id", "anchors", F.explode(F.array(_chosen())).alias("chosen")).select("drawing_id", F.explode("anchors").alias("a"), "chosen")
    rows = rows.withColumn("e", F.get(F.filter("chosen", lambda e: e["char_no"] == F.col("a.char_no")), F.lit(0)))
    return rows.select("drawing_id", "a.*", *[f"e.{c}" for c in carried])


def _edge(carried: tuple[str, ...]) -> Column:
    first = F.when(F.isnan("total_score"), float("-inf")).otherwise(-F.col("total_score"))  # not a number ranks above all scores
    return F.struct(first.alias("first"), "anchor_ord", "cand_rank", "char_no", F.struct(*SPAN_KEY).alias("span"), *carried)


def _chosen() -> Column:
    """Of ``edges`` in their order those that clash with none before."""
    empty = F.filter(F.col("edges"), lambda e: F.lit(False))

    def step(taken, e):
        clash = F.exists(taken, lambda t: (t["char_no"] == e["char_no"]) | (t["span"] == e["span"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(e)))

    return F.aggregate("edges", empty, step)


def dominant(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """The same result without a drawing in one row: in each round edges that are best at both ends are taken.

    Under a strict total order this is the greedy assignment. Each round is a
    written table; a round of joins and window ranks per drawing and end.
    """
    scratch = Scratch(edges.sparkSession, "assignment")
    left = scratch.save(ordered_edges(edges).withColumn("span", F.xxhash64(*SPAN_KEY)).select("drawing_id", "char_no", "cand_rank", "edge_ord", *SPAN_KEY), "left0")
    taken = None
    for k in range(rounds):
        by_char = left.groupBy("drawing_id", "char_no").agg(F.min("edge_ord").alias("edge_ord"))
        by_span = left.groupBy("drawing_id", *SPAN_KEY).agg(F.min("edge_ord").alias("edge_ord"))
        best = left.join(by_char, ["drawing_id", "char_no", "edge_ord"], "left_semi").join(by_span, ["drawing_id", *SPAN_KEY, "edge_ord"], "left_semi")
        best = scratch.save(best, f"best{k}")
        if best.isEmpty():
            break
        taken = best if taken is None else taken.unionByName(best)
        rest = left.join(best.select("drawing_id", "char_no"), ["drawing_id", "char_no"], "left_anti").join(best.select("drawing_id", *SPAN_KEY), ["drawing_id", *SPAN_KEY], "left_anti")
        left = scratch.save(rest, f"left{k + 1}")
    else:
        raise RuntimeError(f"edges are left after {rounds} rounds")
    return (taken if taken is not None else left).select("drawing_id", "char_no", "cand_rank")


def assigned(edges: DataFrame, fold_edges: int = FOLD_EDGES) -> DataFrame:
    """Accepted edges: small drawings by :func:`greedy`, those with more than ``fold_edges`` edges by :func:`dominant`. ``edges`` is read twice."""
    large = edges.groupBy("drawing_id").agg(F.count("*").alias("n")).where(F.col("n") > fold_edges).select("drawing_id")
    if large.isEmpty():
        return greedy(edges)
    large = Scratch(edges.sparkSession, "assignment").save(large, "large")
    return greedy(edges.join(large, "drawing_id", "left_anti")).unionByName(dominant(edges.join(large, "drawing_id", "left_semi")))


def matches(candidates: DataFrame, written: bool = False) -> DataFrame:
    """Candidates that were assigned. They are read more than once, so they are written first unless they are a table already."""
    if not written:
        candidates = Scratch(candidates.sparkSession, "assignment").save(candidates, "candidates")
    return candidates.join(assigned(candidates), ["drawing_id", "char_no", "cand_rank"])
