"""QR factorisation of tall matrices of few columns: blocks of rows first, then the triangles of blocks, level by level.

Each block of rows is factored in a task of its own. The k-by-k triangles of BRANCH blocks are stacked and factored again, until one
is left; on the way back each block's basis is turned by its part of the bases above. All steps are Householder
factorisations, so the basis is orthonormal to rounding even where columns depend on one another: they are completed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.plans.ranges import checkpointed

#: Rows of a block, and triangles that are stacked.
BLOCK_ROWS, BRANCH = 16_384, 64


def factored(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Q, R) with no negative number on R's diagonal."""
    q, r = np.linalg.qr(block)
    turn = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * turn, r * turn[:, None]


def _numbers(rows: pd.DataFrame, k: int) -> np.ndarray:
    return rows[[f"x{j}" for j in range(k)]].to_numpy(np.float64)


def _form(k: int) -> str:
    return ", ".join(f"x{j} double" for j in range(k))


def _frame(keys: dict, numbers: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(keys | {f"x{j}": numbers[:, j] for j in range(numbers.shape[1])})


def _split(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(basis, triangles): (block, row, x0 and so on) of each block of rows (block, row, x0 ...) factored by itself.

    Triangles have one row for each of theirs, numbered by row; both are read from one stored table.
    """

    def local(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("row")
        q, r = factored(_numbers(own, k))
        if q.shape[1] < k:  # fewer rows than columns
            q = np.pad(q, ((0, 0), (0, k - q.shape[1])))
        block = own["block"].iat[0]
        basis = _frame({"block": block, "row": own["row"].to_numpy(), "triangle": False}, q)
        return pd.concat([basis, _frame({"block": block, "row": np.arange(len(r)), "triangle": True}, r)])

    both = checkpointed(rows.groupBy("block").applyInPandas(local, f"block long, row long, triangle boolean, {_form(k)}"))
    return both.where("not triangle").drop("triangle"), both.where("triangle").drop("triangle")


def _turned(rows: DataFrame, turns: DataFrame, k: int) -> DataFrame:
    """The rows of each block times that block's matrix, (block, row, x0 and so on)."""

    def turn(own: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        matrix = np.zeros((k, k))
        matrix[by["row"].to_numpy()] = _numbers(by, k)
        return _frame({"block": own["block"].to_numpy(), "row": own["row"].to_numpy()}, _numbers(own, k) @ matrix)

    return rows.groupBy("block").cogroup(turns.groupBy("block")).applyInPandas(turn, f"block long, row long, {_form(k)}")


def _basis(rows: DataFrame, blocks: int, k: int) -> DataFrame:
    """The basis of rows in so many blocks, numbered from 0."""
    basis, triangles = _split(rows, k)
    if blocks == 1:
        return basis
    # the triangle of a block becomes rows of a block of the level above, where each has its place among k BRANCH rows
    above = triangles.select(
        F.floor(F.col("block") / BRANCH).alias("block"), (F.pmod("block", F.lit(BRANCH)) * k + F.col("row")).alias("row"), *[f"x{j}" for j in range(k)]
    )
    top = _basis(above, -(-blocks // BRANCH), k)
    turns = top.select(
        (F.col("block") * BRANCH + F.floor(F.col("row") / k)).alias("block"), F.pmod("row", F.lit(k)).alias("row"), *[f"x{j}" for j in range(k)]
    )
    return _turned(basis, turns, k)


def orthonormal(records: DataFrame, n: int, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, x0, x1 and so on): an orthonormal basis of k columns of n records, row from 0 on, as a stored table.

    Where the columns are independent it is the Q of a QR factorisation whose R has a positive diagonal; n must be at least k.
    """
    if n < k:
        raise ValueError(f"{n} rows have no {k} orthonormal columns")
    block_rows = max(block_rows, k)
    rows = records.select(F.floor(F.col("row") / block_rows).alias("block"), "row", *[f"x{j}" for j in range(k)])
    out = _basis(rows, -(-n // block_rows), k)
    return checkpointed(out.select("row", *[f"x{j}" for j in range(k)])) if n > block_rows else out.select("row", *[f"x{j}" for j in range(k)])
