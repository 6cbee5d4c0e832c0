"""Learned stages as exchangeable parts: anything with these methods can stand in.

No weights come with this engine. The defaults are plain rules, so that pipelines run end to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Binariser(Protocol):
    def ink(self, image: np.ndarray) -> np.ndarray:
        """A boolean mask of the ink of a picture (height, width, channels)."""


class LineDetector(Protocol):
    def polygons(self, image: np.ndarray) -> list[tuple[float, list[tuple[float, float]]]]:
        """(confidence, corner points) of each line."""


class Threshold:
    """Ink is what is darker than the between-class threshold of the grey values."""

    def ink(self, image: np.ndarray) -> np.ndarray:
        grey = image.reshape(*image.shape[:2], -1).mean(axis=2)
        n = np.bincount(grey.astype(np.uint8).ravel(), minlength=256).astype(float)
        level = np.arange(256)
        below, mass = np.cumsum(n), np.cumsum(n * level)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = below * (below[-1] - below) * (mass / below - (mass[-1] - mass) / (below[-1] - below)) ** 2
        return grey <= int(np.nanargmax(score)) if np.nanmax(score, initial=0) > 0 else np.zeros(grey.shape, bool)


def binarised(images: DataFrame, model: Binariser | None = None) -> DataFrame:
    """images(path, height, width, channels, data): (path, y, x), one row per ink pixel. A model
    is sent to each task once; a task holds one batch of pictures."""
    model = model or Threshold()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples(index=False):
                y, x = np.nonzero(model.ink(np.frombuffer(p.data, np.uint8).reshape(p.height, p.width, p.channels)))
                yield pd.DataFrame({"path": p.path, "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return images.mapInPandas(run, "path string, y int, x int")


def detected(images: DataFrame, model: LineDetector) -> DataFrame:
    """(path, ordinal, score, points) of the lines that a detector finds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch.itertuples(index=False):
                image = np.frombuffer(p.data, np.uint8).reshape(p.height, p.width, p.channels)
                rows += [(p.path, i, float(s), [{"x": float(a), "y": float(b)} for a, b in c]) for i, (s, c) in enumerate(model.polygons(image))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "score", "points"])

    return images.mapInPandas(run, "path string, ordinal int, score double, points array<struct<x:double,y:double>>")
