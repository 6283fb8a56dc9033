"""Rows of a pandas frame as comparable tuples, whatever their order."""

import math

import numpy as np


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return None
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return f"{float(v):.9g}"
    if isinstance(v, float | np.floating):
        return f"{float(v):.9g}"
    return str(v)


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted((tuple(map(plain, r)) for r in pdf[names].itertuples(index=False)), key=repr)
