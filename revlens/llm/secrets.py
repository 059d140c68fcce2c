"""Secret scan with corpus-wide ownership frequency, in column expressions only.

Base kinds are found by regular expressions, leftmost and non-overlapping, and
keep their spans whatever the corpus says. The method adds spans of kind
``rare``: long runs that mix letters and digits, do not overlap a base span,
and whose value one owner alone uses, in no more than a few repositories. Values are hashed; hashes are counted by
distinct repositories and owners with partial aggregation before each shuffle,
and every candidate is then known to be a widely copied example or an
owner-specific, live-looking credential.

Spans are code points, end exclusive. Java's split and match arrays of the
same pattern alternate, so running sums of their lengths are the positions.

Defined results: null texts are empty; texts without a match have no spans and
the digest of the empty string. Null owners count as one owner. Rows are
joined back by id and text digest, nulls alike, so repeated rows get the same
answer and are counted once per repository. Columns of other names pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.session import Scratch

#: kind, pattern, group of the value, least length of the value (fixed values).
BASE_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: Distinct repositories up to which a value of one owner is its own; one in more is a widely copied example.
MAX_REPOSITORIES = 4
RARE = ("rare", r"[A-Za-z0-9+/_-]{24,}", 0, 24)
#: Cheap tests that a text must pass before its matches are listed; each is implied by a match that counts.
HINTS = {"assign": r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=])", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "rare": r"[A-Za-z0-9+/_-]{24}"}


def _matches(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Array of struct(start, kind order, end, kind, value) for one kind."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("len"))), value, lambda p, v: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), v.alias("value")))
    empty = F.expr("array()").cast("array<struct<start:int,kind_order:int,end:int,kind:string,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["len"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(zipped, start, step)["found"]
    return F.when(text.rlike(HINTS[kind]), found).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(frame: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "doc_id", owner: str = "source", max_owners: int = 1, max_repositories: int | None = MAX_REPOSITORIES) -> DataFrame:
    """One row per input row: doc_id, base (array), rare (array), how many secrets are owner-specific or shared, and ``n_repositories``.

    A value is owner-specific if at most ``max_owners`` distinct owners hold it, in at most ``max_repositories`` distinct
    repositories, each an owner's own; None sets no bound. ``n_repositories`` is the most that hold one value of the row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = frame.select(
        F.col(doc_id).alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.xxhash64(body).alias("digest"),
        *[_matches(body, kind, k, pattern, group, least).alias(kind) for k, (kind, pattern, group, least) in enumerate(BASE_KINDS)],
        _matches(body, RARE[0], len(BASE_KINDS), *RARE[1:]).alias("wide"),
    )
    base = base.withColumn("base", F.array_sort(reduce(F.concat, [F.col(k) for k, *_ in BASE_KINDS])))
    mixed = F.filter("wide", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    # read twice below, so that no text is scanned twice
    base = Scratch(frame.sparkSession, "secrets").save(base.withColumn("wide", mixed), "base")
    key = ["doc_id", "digest"]
    spans = base.where((F.size("base") > 0) | (F.size("wide") > 0)).select("doc_id", "digest", "repository", "owner", F.explode(F.concat("base", "wide")).alias("span"))
    spans = spans.select(*key, "repository", "owner", "span", F.sha2(F.col("span.value"), 256).alias("secret"))
    owners = spans.groupBy("secret", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("secret", "owner").agg(F.sum("one").alias("repositories"))
    owners = owners.groupBy("secret").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    judged = spans.select(*key, "span", "secret").join(owners, "secret")
    live = F.col("n_owners") <= max_owners
    if max_repositories is not None:
        live = live & (F.col("n_repositories") <= max_repositories)
    verdicts = judged.groupBy(*key, "span").agg(F.max(live.cast("int")).alias("live"), F.max("n_repositories").alias("n_repositories")).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when((F.col("span.kind") == "rare") & (F.col("live") == 1), F.col("span")))).alias("rare"),
        F.sum(F.when((F.col("span.kind") != "rare") & (F.col("live") == 1), 1).otherwise(0)).alias("n_live"),
        F.sum(F.when((F.col("span.kind") != "rare") & (F.col("live") == 0), 1).otherwise(0)).alias("n_shared"),
        F.max("n_repositories").alias("n_repositories"),
    )
    verdicts = verdicts.withColumnRenamed("doc_id", "v_id").withColumnRenamed("digest", "v_digest")
    out = base.join(verdicts, base["doc_id"].eqNullSafe(verdicts["v_id"]) & (base["digest"] == verdicts["v_digest"]), "left")
    return out.select("doc_id", *[k for k, *_ in BASE_KINDS], "base", F.coalesce("rare", F.filter("base", lambda s: F.lit(False))).alias("rare"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("n_repositories", F.lit(0)).alias("n_repositories"))


def digests(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE_KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "rare"))).alias("spans"),
        F.size("rare").cast("long").alias("n_rare"), F.col("n_live").cast("long"), F.col("n_shared").cast("long"), F.col("n_repositories").cast("long"),
    )
