"""Vector arithmetic on array columns."""

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(l2_norm(a) * l2_norm(b), F.lit(eps))
