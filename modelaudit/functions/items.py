"""Scalar expressions on items: numbers in names, groups, class indices, hashes, probabilities and vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and use it in ``body``; referred to by name, it may be written out at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash01(text: Column) -> Column:
    """A number in [0, 1) from a text, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def order_key(key: Column, seed: int = SEED) -> Column:
    """Sorting by this, then by the key, is the library's shuffle: it depends on seed and key alone."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def item_number(name: Column, default: int | None = 0) -> Column:
    """The integer in the first parentheses of a name; ``default`` (null to tell) where there is none."""
    found = F.regexp_extract(name, r"\((\d+)\)", 1).try_cast("long")
    return found if default is None else F.coalesce(found, F.lit(default).cast("long"))


def group_id(klass: Column, number: Column, size: int = 50) -> Column:
    """``class_block`` with blocks of ``size`` successive numbers."""
    return F.concat_ws("_", klass, F.floor(number / F.lit(size)).cast("string"))


def class_index(klass: Column, classes: Sequence[str]) -> Column:
    """Place of a class in a fixed list; null if it isn't there."""
    at = F.array_position(F.lit(list(classes)), klass)
    return F.when(at > 0, (at - 1).cast("int"))


def argmax_class(p: Column) -> Column:
    """Index of the largest probability, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def predicted_confidence(p: Column, predicted: Column) -> Column:
    """P6."""
    return F.get(p, predicted)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Divided by the norm plus 1e-12."""
    return F.transform(a, lambda x: x / (norm(a) + F.lit(1e-12)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(1e-12)) * (norm(b) + F.lit(1e-12)))


def vector_key(a: Column) -> Column:
    """A key of a vector's exact values."""
    return F.md5(F.array_join(F.transform(a, lambda x: x.cast("string")), ","))
