"""Random identifiers from the operating system's source, and full case folding.

Spark's ``uuid()`` is a seeded generator whose seed sits in the plan, and ``lower`` is
not case folding, so these stay small Arrow functions. They are nested so that they
travel to the executors by value and need nothing installed there but numpy and pandas.
"""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def random_id(anchor: Column) -> Column:
    """A fresh UUIDv4 per row. Write the result once before using it twice."""

    def draw(values: pd.Series) -> pd.Series:
        import os

        import numpy as np

        n = len(values)
        raw = np.frombuffer(os.urandom(16 * n), dtype=np.uint8).reshape(n, 16).copy()
        raw[:, 6] = (raw[:, 6] & 0x0F) | 0x40
        raw[:, 8] = (raw[:, 8] & 0x3F) | 0x80
        digits = np.frombuffer(b"0123456789abcdef", dtype="S1")
        text = np.stack([digits[raw >> 4], digits[raw & 15]], axis=2).reshape(n, 32)
        out = np.full((n, 36), b"-", dtype="S1")
        for width, at, start in ((8, 0, 0), (4, 8, 9), (4, 12, 14), (4, 16, 19), (12, 20, 24)):
            out[:, start : start + width] = text[:, at : at + width]
        return values.__class__(out.view("S36").ravel().astype("U36"), index=values.index)

    return F.pandas_udf(draw, T.StringType()).asNondeterministic()(anchor)


def random_hex8(anchor: Column) -> Column:
    """Eight random upper-case hex digits per row; same caution as :func:`random_id`."""

    def draw(values: pd.Series) -> pd.Series:
        import os

        raw = os.urandom(4 * len(values)).hex().upper()
        shown = [raw[i : i + 8] for i in range(0, len(raw), 8)]
        return values.__class__(shown, index=values.index, dtype=object)

    return F.pandas_udf(draw, T.StringType()).asNondeterministic()(anchor)


def new_codes(labels: Iterable[str]) -> dict[str, str]:
    """Fresh codes for a bounded label list (a policy holds at most 1,000)."""
    return {label: str(uuid4()) for label in labels}


def casefold(column: str) -> Column:
    def fold(values: pd.Series) -> pd.Series:
        return values.str.casefold()

    return F.pandas_udf(fold, T.StringType())(F.col(column))
