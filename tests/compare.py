"""Rows of two engines in a form that can be compared."""

from __future__ import annotations

import datetime
import decimal

import numpy as np
import pandas as pd


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, float | np.floating):
        return None if x != x else f"{x:.9g}"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, int | np.integer):
        return str(int(x))
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, list | tuple | np.ndarray):
        return [plain(y) for y in x]
    if isinstance(x, pd.Timestamp | datetime.datetime):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)
