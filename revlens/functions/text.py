"""Requirement fingerprints as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values.
TYPE_WORDS = ["DRAWING NOTES", "EDGE RADIUS", "COUNTERBORE", "COUNTERSINK", "LENGTH", "DIAMETER", "RADIUS", "DEPTH", "ANGLE", "THREAD", "NOTES", "THRU ALL"]
UNIT_WORDS = ["MM", "IN", "DEG"]
REVISION_WORDS = ["ADDED", "NEW", "REVISED", "DELETED"]
DIAMETER = "Ø"
NUMBER = r"\d+\.?\d*"
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def norm_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), BLANKS, " "))


def count_tokens(norm: Column) -> Column:
    return F.transform(F.regexp_extract_all(norm, F.lit(r"(?U)\b(\d+)\s*X\b"), F.lit(1)), lambda n: F.concat(n, F.lit("X")))


def type_tokens(norm: Column) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in TYPE_WORDS]), lambda w: F.contains(norm, w))


def symbol_tokens(text: Column, norm: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.when(F.contains(text, F.lit(DIAMETER)), F.array(F.lit(DIAMETER))).otherwise(none), F.when(norm.rlike(r"R[\d.]"), F.array(F.lit("R"))).otherwise(none))


def numeric_tokens(norm: Column) -> Column:
    return F.transform(F.regexp_extract_all(norm, F.lit(NUMBER), F.lit(0)), lambda s: F.struct(s.try_cast("double").alias("value"), s.alias("raw")))


def numeric_set(norm: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(NUMBER), F.lit(0)).try_cast("array<double>"))


def numeric_strings(text: Column) -> Column:
    """Distinct number strings of the text as it stands."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def units(norm: Column) -> Column:
    return F.coalesce(*[F.when(norm.rlike(rf"(?U)\b{u}\b"), F.lit(u)) for u in UNIT_WORDS])


def pattern_class(text: Column, norm: Column) -> Column:
    has = lambda *words: [F.contains(norm, F.lit(w)) for w in words]

    def any_of(tests: list[Column]) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return (
        F.when(any_of(has("NOTES")), "note")
        .when(any_of([*has("THREAD"), norm.rlike(r"[MG]\d+")]), "hole")
        .when(any_of([*has("RADIUS"), F.startswith(norm, F.lit("R "))]), "fillet")
        .when(any_of([*has("DIAMETER"), F.contains(text, F.lit(DIAMETER)), *has("COUNTERBORE", "COUNTERSINK")]), "hole")
        .when(any_of(has("THRU ALL")), "hole")
        .when(any_of(has("LENGTH", "DEPTH", "ANGLE")), "dimension")
        .otherwise("other")
    )


def word_tokens(norm: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(norm, " "), ""))


def fingerprint(text: Column) -> Column:
    """The whole fingerprint as one struct."""
    norm = norm_text(text)
    return F.struct(
        norm.alias("norm_text"), count_tokens(norm).alias("count_tokens"), type_tokens(norm).alias("type_tokens"), symbol_tokens(text, norm).alias("symbol_tokens"),
        numeric_tokens(norm).alias("numeric_tokens"), units(norm).alias("units"), pattern_class(text, norm).alias("pattern_class"),
    )


def with_tokens(frame, text: str, prefix: str = ""):
    """Adds the token sets that scoring and classification read, once per row.

    The normal form sits behind a one-row generator, so the optimizer computes
    it once instead of once per use.
    """
    names = {c: f"{prefix}{c}" for c in ("norm", "counts", "symbols", "numbers", "words", "kind")}
    frame = frame.select("*", F.explode(F.array(norm_text(F.col(text)))).alias(names["norm"]))
    norm, raw = F.col(names["norm"]), F.col(text)
    return frame.withColumns({
        names["counts"]: F.array_distinct(count_tokens(norm)), names["symbols"]: symbol_tokens(raw, norm), names["numbers"]: numeric_set(norm),
        names["words"]: word_tokens(norm), names["kind"]: pattern_class(raw, norm),
    })


def float_text(x: Column) -> Column:
    """A double as Python prints it, for magnitudes below 1e16."""
    whole = F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e16), whole).otherwise(x.cast("string"))


def set_text(items: Column) -> Column:
    """A set of strings as Python prints it, sorted."""
    quoted = F.transform(F.array_sort(items), lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    return F.concat(F.lit("{"), F.array_join(quoted, ", "), F.lit("}"))


def list_text(items: Column) -> Column:
    quoted = F.transform(items, lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def register_sql(spark: SparkSession) -> None:
    """The fingerprint parts as temporary SQL functions, which the optimizer inlines."""
    bodies = {
        "fp_norm": r"trim(regexp_replace(upper(t), r'(?U)[\s\x1c-\x1f]+', ' '))",
        "fp_counts": r"transform(regexp_extract_all(t, r'(?U)\b(\d+)\s*X\b', 1), n -> concat(n, 'X'))",
        "fp_numbers": r"array_distinct(transform(regexp_extract_all(t, r'\d+\.?\d*', 0), s -> try_cast(s as double)))",
    }
    kinds = {"fp_norm": "string", "fp_counts": "array<string>", "fp_numbers": "array<double>"}
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t string) RETURNS {kinds[name]} RETURN {body}")
