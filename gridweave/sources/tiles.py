"""Tiles: blocks of whole rows of a tensor as arrays, streamed to the driver one at a time or written as a table.

Tasks make the tiles, so the driver holds one of them, and a sparse tensor's missing cells never travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.frame import FilledFrame, SparseFrame


def tiled(a, cells: int = 4_000_000) -> tuple[DataFrame, int]:
    """(tiles, rows of a tile): (tile, cells) with the doubles of a block of whole rows in row-major order; every tile is there.

    A row is what has one place along the first axis. A tile has at most so many cells, or one row.
    """
    if not a.ndim:
        raise ValueError("a single cell has no rows")
    wide = math.prod(a.shape[1:])
    rows = max(1, min(a.shape[0], cells // max(1, wide)))
    stored = a.coalesce().df if isinstance(a, SparseFrame) else a.stored if isinstance(a, FilledFrame) else a.df
    rest, shape, value = a.coords[1:], a.shape, float(a.value) if isinstance(a, FilledFrame) else 0.0
    at = F.lit(0).cast("long")
    for c, n in zip(rest, shape[1:], strict=True):
        at = at * F.lit(n) + F.col(c)
    place = (F.col(a.coords[0]) % rows) * F.lit(wide) + at
    placed = stored.select(F.floor(F.col(a.coords[0]) / rows).alias("tile"), place.alias("place"), F.col("val").cast("double").alias("val"))
    empty = stored.sparkSession.range(-(-shape[0] // rows)).select(F.col("id").alias("tile"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("val"))

    def made(own: pd.DataFrame) -> pd.DataFrame:
        tile = int(own["tile"].iat[0])
        own = own[own["place"].notna()]
        out = np.full(min(rows, shape[0] - tile * rows) * wide, value)
        out[own["place"].to_numpy(np.int64)] = own["val"].to_numpy(np.float64)
        return pd.DataFrame({"tile": [tile], "cells": [out.astype("<f8").tobytes()]})

    return placed.unionByName(empty).groupBy("tile").applyInPandas(made, "tile long, cells binary"), rows


def streamed(a, cells: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, array) of each tile in order, made by tasks and brought over one by one."""
    tiles, rows = tiled(a, cells)
    count = -(-a.shape[0] // rows)
    ordered = tiles.repartitionByRange(max(1, count), "tile").sortWithinPartitions("tile")
    for row in ordered.toLocalIterator():
        first = row["tile"] * rows
        yield first, np.frombuffer(row["cells"], "<f8").reshape(min(rows, a.shape[0] - first), *a.shape[1:])


def write(a, path: str, cells: int = 4_000_000) -> int:
    """Writes the tiles as a Parquet table (tile, cells), and gives the rows of a tile."""
    tiles, rows = tiled(a, cells)
    tiles.write.mode("overwrite").parquet(path)
    return rows


def read(spark: SparkSession, path: str, shape: tuple[int, ...], rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """What streamed() gives, from a table of tiles."""
    for row in spark.read.parquet(path).orderBy("tile").toLocalIterator():
        first = row["tile"] * rows
        yield first, np.frombuffer(row["cells"], "<f8").reshape(min(rows, shape[0] - first), *shape[1:])
