"""Reproducible randomness: every draw is a function of a seed and a row key, never of task order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2 ** 52)


def hash_key(seed: int | str, *keys: Column | str) -> Column:
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def _unit(hexdigest: Column, start: int) -> Column:
    return F.conv(F.substring(hexdigest, start, 13), 16, 10).cast("double") / F.lit(_TWO_52)


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """U[0, 1): the first 13 hex digits of the key's md5 over 2^52."""
    return _unit(hash_key(seed, *keys), 1)


def below(share: float, seed: int | str, *keys: Column | str) -> Column:
    """``uniform(seed, *keys) < share``, read off the digits: both sides are whole numbers over 2^52, of 13 hex digits each."""
    if share >= 1:
        return F.lit(True)
    return hash_key(seed, *keys) < F.lit(f"{math.ceil(max(share, 0.0) * _TWO_52):013x}")


def normal(seed: int | str, *keys: Column | str) -> Column:
    """N(0, 1) by Box-Muller on two disjoint digit ranges of one md5."""
    digest = hash_key(seed, *keys)
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _unit(digest, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * _unit(digest, 14))
