"""Run a per-series pandas function over many series per Python call.

``groupBy(key).applyInPandas`` pays a fixed cost per group; with millions
of short series that cost dominates.  ``map_series`` hash-partitions by
the series key (the same shuffle a grouped map does), sorts within each
partition, and ``mapInPandas`` walks the partition's Arrow batches, cutting
them into series; a series split across two batches is carried over.  A
task holds one batch plus at most one series, and every call still sees
exactly one whole series.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _segments(keys: np.ndarray):
    if len(keys) == 0:
        return []
    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(keys)]])
    return list(zip(starts, ends))


def map_series(df: DataFrame, key: str, order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
               schema, partitions: int | None = None) -> DataFrame:
    """Apply ``fn`` to each series (rows sharing ``key``, sorted by
    ``order``) and concatenate the results."""
    dealt = df.repartition(partitions, key) if partitions else df.repartition(key)
    parts = dealt.sortWithinPartitions(key, *order)
    names = schema.names if hasattr(schema, "names") else None

    def process(block: pd.DataFrame):
        keys = block[key].to_numpy()
        outs = [fn(block.iloc[s:e].reset_index(drop=True)) for s, e in _segments(keys)]
        outs = [o for o in outs if o is not None and len(o)]
        if outs:
            out = pd.concat(outs, ignore_index=True)
            yield out[names] if names else out

    def run(batches):
        carry = None
        for pdf in batches:
            if carry is not None and len(carry):
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if pdf.empty:
                continue
            keys = pdf[key].to_numpy()
            last = np.flatnonzero(keys == keys[-1])[0]
            carry = pdf.iloc[last:]
            if last:
                yield from process(pdf.iloc[:last])
        if carry is not None and len(carry):
            yield from process(carry)
    return parts.mapInPandas(run, schema)
