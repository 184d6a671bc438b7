"""Boxes as numpy arrays, for steps that go through a frame in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CORNERS = ["x1", "y1", "x2", "y2"]


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (n, 4) and (m, 4); 0 where both have no area."""
    a, b = a[:, None], b[None]
    width = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    height = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    shared = np.maximum(width, 0) * np.maximum(height, 0)
    p, q = ((x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]) for x in (a, b))
    union = p + q - shared
    return np.divide(shared, union, out=np.zeros(np.broadcast_shapes(shared.shape, union.shape)), where=union > 0)


def by_frame(rows: DataFrame, order: list, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """step on each frame's rows, in order. Frames stream through a task in Arrow batches; it holds one frame and one batch."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            frames = batch["frame"].to_numpy()
            cuts = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1), len(batch)]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0]["frame"].iloc[0] != frames[a]:
                    out.append(step(pd.concat(held)))
                    held = []
                held.append(batch.iloc[a:b])
            if out:
                yield pd.concat(out)
        if held:
            yield step(pd.concat(held))

    return rows.where("frame is not null").repartition("frame").sortWithinPartitions("frame", *order).mapInPandas(fold, schema)
