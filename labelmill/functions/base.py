"""Column helpers that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def r6(c: Column, name: str | None = None) -> Column:
    out = F.round(c, 6)
    return out.alias(name) if name else out


def when_chain(cases: list[tuple[Column, object]], default=None) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(default)
    for cond, value in reversed(cases):
        out = F.when(cond, value).otherwise(out)
    return out


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def hash_order(seed: str, *keys: Column | str) -> Column:
    """md5 of the seed and the keys: an order that any engine gives alike."""
    return F.md5(F.concat(F.lit(seed), *[F.lit("|") if k is None else F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))
