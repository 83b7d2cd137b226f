"""Iterations on sparse matrices: conjugate gradients, block PageRank and block power iteration.

The matrix is laid out once, by the axis that rounds join or sum on, and kept; a round reads it without an exchange of its cells where
the vectors are small enough to be sent to all tasks. The driver gets scalars to decide on. A round's state is written as a
table in the shared folder, so lost executors cost one round, and its sums are observed in the same job.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridweave.frame import BROADCAST_CELLS, DenseFrame, SparseFrame
from gridweave.plans import qr
from gridweave.plans.ranges import Rounds, checkpointed

#: Stored cells, or numbers of a state, in a partition.
PART_CELLS = 1_000_000


@contextmanager
def _held(a: SparseFrame, k: int):
    """(matrix, partitions): its cells dealt by row if k vectors are sent to all tasks, else by column, and kept; lost parts are made again."""
    cells = max(a.nnz, a.shape[0] * k)
    parts = 1 + cells // PART_CELLS
    own = a.like(a.df.repartition(parts, "row" if a.shape[1] * k <= BROADCAST_CELLS else "col").persist(StorageLevel.MEMORY_AND_DISK))
    try:
        yield own, parts
    finally:
        own.df.unpersist()


def _observed(rounds: Rounds, df: DataFrame, *sums) -> tuple[DataFrame, list[float]]:
    """df as the table of a round, and its sums, in one job: nothing is shuffled behind the sums, so each task's count once."""
    seen = Observation()
    out = rounds.put(df.observe(seen, *[F.sum(v).alias(f"s{k}") for k, v in enumerate(sums)]))
    return out, [seen.get[f"s{k}"] or 0.0 for k in range(len(sums))]


def cg_solve(a: SparseFrame, b: DenseFrame, tol: float = 1e-8, maxiter: int = 1000, scaled: bool = False) -> tuple[DenseFrame, int, float]:
    """(x, rounds, residual) of A x = b for a symmetric positive definite A; stops when |r|/|b| is at most tol.

    All sums of a round are taken at once, over r and A r: directions and their products follow from those by recurrences. With scaled,
    residuals are divided by the diagonal, which takes fewer rounds where its numbers differ.
    """
    with _held(a, 1) as (own, parts):
        return _cg(own, parts, b, tol, maxiter, scaled)


def _cg(a: SparseFrame, parts: int, b: DenseFrame, tol: float, maxiter: int, scaled: bool) -> tuple[DenseFrame, int, float]:
    zero, n = F.lit(0.0), b.shape[0]
    state = b.df.select(F.col("i0").alias("row"), zero.alias("x"), F.col("val").alias("r"), F.lit(1.0).alias("m"), zero.alias("p"), zero.alias("s"))
    if scaled:
        diagonal = a.df.where("row = col").groupBy("row").agg(F.sum("val").alias("d"))
        state = state.join(diagonal, "row", "left").withColumn("m", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(1.0)).drop("d")
    state, k, size, before, alpha = state.repartition(parts, "row"), 0, None, 0.0, 1.0
    tables = Rounds(a.spark)
    u, w = F.col("r") * F.col("m"), F.coalesce("y0", zero)  # the scaled residual, and its product with A
    while True:
        product = _product(a, state.select("row", u.alias("x0")), n, 1)
        both, (rr, ru, wu) = _observed(tables, state.join(product, "row", "left"), F.col("r") * F.col("r"), F.col("r") * u, w * u)
        size = size or math.sqrt(rr) or 1.0
        if k >= maxiter or math.sqrt(rr) / size <= tol:
            break
        beta = ru / before if k else 0.0
        bottom = wu - beta * ru / alpha if k else wu
        if bottom == 0.0:
            break
        k, alpha, before = k + 1, ru / bottom, ru
        moved = both.select("row", "x", "r", "m", (u + beta * F.col("p")).alias("p"), (w + beta * F.col("s")).alias("s"))
        state = moved.select("row", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("s")).alias("r"), "m", "p", "s")
    return DenseFrame(both.select(F.col("row").alias("i0"), F.col("x").alias("val")), b.shape), k, math.sqrt(rr) / size


def block_pagerank(p: SparseFrame, x0: DenseFrame, alpha: float = 0.85, tol: float = 1e-8, maxiter: int = 100) -> tuple[DenseFrame, int, float]:
    """(X, rounds, change): X becomes alpha P X + (1 - alpha) X0 with columns that add up to one, until it rests.

    A row of X is one record with a column for each of its vectors, so x0 should have tens of columns at most.
    """
    with _held(p, x0.shape[1]) as (own, parts):
        return _pagerank(own, parts, x0, alpha, tol, maxiter)


def _pagerank(p: SparseFrame, parts: int, x0: DenseFrame, alpha: float, tol: float, maxiter: int) -> tuple[DenseFrame, int, float]:
    k, n = x0.shape[1], x0.shape[0]
    columns = range(k)
    state = _records(x0, "s").repartition(parts, "row").select("*", *[F.col(f"s{j}").alias(f"x{j}") for j in columns])
    rounds, change, tables = 0, math.inf, Rounds(p.spark)
    while rounds < maxiter and change > tol:
        rounds += 1
        product = _product(p, state, n, k)
        mixed = [(alpha * F.coalesce(f"y{j}", F.lit(0.0)) + (1 - alpha) * F.col(f"s{j}")).alias(f"m{j}") for j in columns]
        now = state.join(product, "row", "left").select("row", *[c + str(j) for j in columns for c in "sx"], *mixed)
        now, totals = _observed(tables, now, *[F.col(f"m{j}") for j in columns])
        totals = [t or 1.0 for t in totals]
        new = [F.col(f"m{j}") / F.lit(totals[j]) for j in columns]
        step = now.agg(*[F.sum((v - F.col(f"x{j}")) ** 2) for j, v in enumerate(new)], *[F.sum(v**2) for v in new]).first()
        step = [x or 0.0 for x in step]
        change = math.sqrt(sum(step[:k])) / (math.sqrt(sum(step[k:])) or 1.0)
        state = now.select("row", *[f"s{j}" for j in columns], *[v.alias(f"x{j}") for j, v in enumerate(new)])
    return _cells(state, x0.shape), rounds, change


def _records(x: DenseFrame, name: str = "x") -> DataFrame:
    """A record for each row of a dense matrix, with a column for each of its columns: row, x0, x1 and so on."""
    return x.df.groupBy("row").agg(*[F.sum(F.when(F.col("col") == j, F.col("val"))).alias(f"{name}{j}") for j in range(x.shape[1])])


def _cells(records: DataFrame, shape: tuple[int, ...]) -> DenseFrame:
    cells = records.select("row", F.posexplode(F.array(*[f"x{j}" for j in range(shape[1])])).alias("col", "val"))
    return DenseFrame(cells.select("row", F.col("col").cast("long").alias("col"), "val"), shape)


def _product(a: SparseFrame, records: DataFrame, n: int, k: int) -> DataFrame:
    """(row, y0, y1 and so on): a times n records of k columns; rows of a without cells are left out."""
    right = records.select(F.col("row").alias("col"), *[f"x{j}" for j in range(k)])
    right = F.broadcast(right) if n * k <= BROADCAST_CELLS else right
    return a.df.join(right, "col").groupBy("row").agg(*[F.sum(F.col("val") * F.col(f"x{j}")).alias(f"y{j}") for j in range(k)])


def block_power(a: SparseFrame, q: DenseFrame, iters: int = 10) -> tuple[DenseFrame, np.ndarray]:
    """(Q, Ritz values) after rounds of Q <- orthonormal basis of A Q.

    The basis comes from a QR factorisation of blocks of rows, so it is orthonormal however the columns of A Q depend on one
    another or differ in size. A row of Q is one record with a column for each vector, so k should be tens at most.
    """
    with _held(a, q.shape[1]) as (own, parts):
        return _power(own, parts, q, iters)


def _power(a: SparseFrame, parts: int, q: DenseFrame, iters: int) -> tuple[DenseFrame, np.ndarray]:
    n, k = q.shape
    state = checkpointed(_records(q).repartition(parts, "row"))
    for _ in range(iters):
        product = state.select("row").join(_product(a, state, n, k), "row", "left").fillna(0.0)
        state = qr.orthonormal(product.withColumnsRenamed({f"y{j}": f"x{j}" for j in range(k)}), n, k)
    ritz = _gram(state.join(_product(a, state, n, k), "row"), "x", "y", k)
    return _cells(state, q.shape), np.linalg.eigvalsh((ritz + ritz.T) / 2)[::-1]


def _gram(records: DataFrame, left: str, right: str, k: int) -> np.ndarray:
    """The products of the columns left0, left1 and so on with right0, right1 and so on, summed over all records."""
    each = F.posexplode(F.array(*[f"{left}{i}" for i in range(k)])).alias("i", "u")
    sums = records.select(each, *[F.col(f"{right}{j}").alias(f"w{j}") for j in range(k)]).groupBy("i").agg(*[F.sum(F.col("u") * F.col(f"w{j}")) for j in range(k)])
    out = np.zeros((k, k))
    for row in sums.collect():  # k rows
        out[row[0]] = row[1:]
    return out


def row_stochastic(a: SparseFrame) -> SparseFrame:
    """Rows that add up to one; rows without cells get a one on the diagonal."""
    own = a.coalesce().df
    sums = own.groupBy("row").agg(F.sum("val").alias("total"))
    scaled = own.join(sums, "row").where("total != 0").select("row", "col", (F.col("val") / F.col("total")).alias("val"))
    empty = a.spark.range(a.shape[0]).select(F.col("id").alias("row")).join(scaled.select("row").distinct(), "row", "left_anti")
    return a.like(scaled.unionByName(empty.select("row", F.col("row").alias("col"), F.lit(1.0).alias("val"))), coalesced=True)


def spd(a: SparseFrame, margin: float = 1e-3) -> SparseFrame:
    """A + A transposed, with a diagonal of each row's absolute sum and a margin: symmetric positive definite."""
    both = a.df.unionByName(a.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))
    off = both.where("row != col").groupBy("row", "col").agg(F.sum("val").alias("val"))
    sums = off.groupBy("row").agg(F.sum(F.abs("val")).alias("total"))
    line = a.spark.range(a.shape[0]).select(F.col("id").alias("row")).join(sums, "row", "left")
    diagonal = line.select("row", F.col("row").alias("col"), (F.coalesce("total", F.lit(0.0)) + margin).alias("val"))
    return a.like(off.unionByName(diagonal), fmt="csr", coalesced=True)
