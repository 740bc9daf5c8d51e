"""Vector similarity as column expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Sum of products from left to right, in double."""
    products = F.zip_with(_col(a).cast(DOUBLES), _col(b).cast(DOUBLES), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a).cast(DOUBLES), F.lit(0.0), lambda s, x: s + x * x))


def cosine_of(dots, norm_a, norm_b) -> Column:
    """Cosine from a dot product and two norms; a zero norm gives 0."""
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(dots / (norm_a * norm_b))


def cosine(a, b) -> Column:
    """Cosine similarity; vectors of different lengths and zero vectors give 0."""
    a, b = _col(a), _col(b)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(cosine_of(dot(a, b), norm(a), norm(b)))


def cosine_strict(a, b) -> Column:
    """Cosine similarity that raises on vectors of different lengths."""
    a, b = _col(a), _col(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("Embeddings must have the same dimensions")).cast("double")).otherwise(
        cosine(a, b)
    )
