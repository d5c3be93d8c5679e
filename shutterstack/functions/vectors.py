"""Vector arithmetic as column expressions over arrays; everything is computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Vectors shorter than this stay as they are when normalised.
LEAST_NORM = 1.1920929e-7


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(v: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(x)) for x in v))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Scalar product; of vectors of unequal lengths the longer one is cut to the length of the other."""
    n = F.least(F.size(a), F.size(b))
    return _total(F.zip_with(F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n), lambda x, y: x * y))


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(doubles(a), lambda x: x * x)))


def normalised(a: Column) -> Column:
    """The vector at unit length; one of almost no length is unchanged."""
    n = norm(a)
    return F.when(n < LEAST_NORM, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))


def rounded(x: Column, digits: int) -> Column:
    """A double to ``digits`` places, halves of the scaled number away from zero. Unlike ``round`` it goes by the binary number, not its decimal form, and what rounds to zero keeps its sign."""
    scaled = x * 10.0**digits
    even = F.rint(scaled)
    whole = F.when(F.abs(scaled - even) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(even)
    return F.when(F.abs(scaled) < float("inf"), whole / 10.0**digits).otherwise(x)


def cosine_similarity(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable(a: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers; null counts as not."""
    return F.coalesce((F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def register_functions(spark: SparkSession) -> None:
    """``l2sq``, ``dot_product``, ``cosine`` and ``l2_normalize`` over arrays of doubles as temporary SQL functions."""
    total = "aggregate({}, 0D, (s, x) -> s + x)"
    product, length = total.format("zip_with(a, b, (x, y) -> x * y)"), "sqrt(" + total.format("transform({}, x -> x * x)") + ")"
    for name, arguments, kind, body in (
        ("l2sq", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", total.format("zip_with(a, b, (x, y) -> (x - y) * (x - y))")),
        ("dot_product", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", product),
        ("cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"try_divide({product}, {length.format('a')} * {length.format('b')})"),
        ("l2_normalize", "a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", f"CASE WHEN {length.format('a')} < {LEAST_NORM} THEN a ELSE transform(a, y -> y / {length.format('a')}) END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
