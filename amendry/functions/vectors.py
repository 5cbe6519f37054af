"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def absolute(v: Column) -> Column:
    return F.transform(v, lambda x: F.abs(x))


def scaled(v: Column | str, by: Column) -> Column:
    return F.transform(_c(v), lambda x: x * by)


def truncate_normalize(v: Column | str, dim: int = 0) -> Column:
    """The first `dim` numbers (all for 0), scaled to length 1; zero vectors stay."""
    cut = F.slice(doubles(v), 1, dim) if dim else doubles(v)
    size = norm(cut)
    return F.when(size > 0, F.transform(cut, lambda x: x / size)).otherwise(cut)


def pointwise_features(source: Column | str, candidate: Column | str, len_source: Column | str, len_candidate: Column | str) -> Column:
    """source, candidate, difference, its absolute values, cosine and four lengths: 4 d + 5 numbers."""
    s, c, ls, lc = doubles(source), doubles(candidate), _c(len_source).cast("double"), _c(len_candidate).cast("double")
    diff = minus(s, c)
    return F.concat(s, c, diff, absolute(diff), F.array(dot(s, c), ls, lc, lc - ls, F.abs(lc - ls)))


def preference_features(source: Column | str, a: Column | str, b: Column | str, len_source: Column | str, len_a: Column | str, len_b: Column | str) -> Column:
    """Nine vector blocks, three cosines, their difference and five lengths: 9 d + 9 numbers."""
    s, x, y = doubles(source), doubles(a), doubles(b)
    ls, la, lb = (_c(n).cast("double") for n in (len_source, len_a, len_b))
    ab, sa, sb = minus(x, y), minus(s, x), minus(s, y)
    numbers = F.array(dot(s, x), dot(s, y), dot(x, y), dot(s, x) - dot(s, y), ls, la, lb, la - lb, F.abs(la - lb))
    return F.concat(s, x, y, ab, absolute(ab), sa, sb, absolute(sa), absolute(sb), numbers)


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def softplus_of_minus(m: Column | str) -> Column:
    """log(1 + exp(-m)), finite for any m."""
    x = -_c(m)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
