"""Batches of rows in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Rows of a batch that Python works on at once, so that what it holds doesn't grow with the batch.
SLICE = 64


def slices(batches: Iterator[pd.DataFrame], n: int = SLICE) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), n):
            yield batch.iloc[k : k + n].reset_index(drop=True)
