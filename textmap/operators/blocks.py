"""Dense blocks of sparse rows, bounded in size whatever the number of columns."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Numbers in a dense block, at most.
BLOCK = 4_000_000


def sparse_blocks(frame: pd.DataFrame, width: int):
    """Parts of a frame whose rows fill a block of that width."""
    step = max(1, BLOCK // max(width, 1))
    for k in range(0, len(frame), step):
        yield frame.iloc[k : k + step]


def dense(at: pd.Series, value: pd.Series, width: int, low: int = 0, where: np.ndarray | None = None) -> np.ndarray:
    """Rows of sparse vectors as a matrix of the columns low to low + width; where gives each place its column (-1: none)."""
    out = np.zeros((len(at), width))
    own = [k for k, x in enumerate(at) if x is not None and len(x)]
    if own:
        row = np.repeat(own, [len(at.iloc[k]) for k in own])
        column = np.concatenate([at.iloc[k] for k in own]).astype(np.int64)
        column = column - low if where is None else where[column]
        keep = (column >= 0) & (column < width)
        np.add.at(out, (row[keep], column[keep]), np.concatenate([value.iloc[k] for k in own])[keep])
    return out
