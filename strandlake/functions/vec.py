"""Vector scalar functions as column builders over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "inner_product")


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """1 - similarity, clipped to [0, 2]; a zero vector is at distance 1."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / size)))


def inner_product(a: Column, b: Column) -> Column:
    """Negative dot product, so that smaller is nearer."""
    return -dot(a, b)


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {', '.join(METRICS)}")
    return {"l2": l2, "cosine": cosine, "inner_product": inner_product}[metric](a, b)


def normalize(v: Column, zero: str = "keep") -> Column:
    """Unit vector; a zero vector is kept (zero="keep") or an error (zero="error")."""
    size = norm(v)
    if zero == "error":
        size = F.when(size == 0, F.raise_error(F.lit("cannot normalise a zero vector")).cast("double")).otherwise(size)
    return F.transform(v, lambda x: x / F.when(size == 0, F.lit(1.0)).otherwise(size))


def dimension(v: Column, expected: int | None = None) -> Column:
    """A vector's length; another one than expected is an error."""
    n = F.size(v)
    if expected is None:
        return n
    return F.when(n == expected, n).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} dimensions, got "), n.cast("string"))).cast("int"))


def half(v: Column) -> Column:
    """Components rounded to half precision (11 significant bits, nearest even), as doubles."""

    def one(x: Column) -> Column:
        size = F.abs(x)
        # The spacing of half floats in the binade of x; 2**-24 among subnormals.
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(2.0**-30)))), F.lit(-14)) - 10)
        return F.when(size > 65519.99, F.signum(x) * F.lit(float("inf"))).otherwise(F.rint(x / step) * step)

    return F.transform(v, one)


def diff_metrics(a: Column, b: Column) -> dict[str, Column]:
    """Cosine similarity, largest and mean absolute difference, and L2 distance of two vectors."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return {"cosine_similarity": dot(a, b) / (norm(a) * norm(b)), "max_abs": F.array_max(gaps), "mean_abs": total(gaps) / F.size(gaps), "l2": l2(a, b)}
