"""Products with dense operands: a join on the contracted axis and a sum for each cell of the result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.frame import BROADCAST_CELLS, DenseFrame, SparseFrame, coord_names, fill

#: Columns of a dense right operand that one record holds, each with a sum of its own.
BLOCK_COLUMNS = 64
#: Stored cells of a contracted place from which it may be hot, and the tasks that it is dealt to.
HOT_CELLS, SALTS = 100_000, 64
#: Bytes of both operands that a task of a product by blocks joins. Each task may have a sum for every cell of the result, so the fewer the less is shuffled.
TASK_BYTES, CELL_BYTES = 256 << 20, 40


def _dense(b, what: str) -> DenseFrame:
    if not isinstance(b, DenseFrame):
        raise NotImplementedError(f"{what} needs a dense right operand")
    return b


def _contract(a: SparseFrame, k: int, b: DenseFrame, b_axis: int):
    """(sums, columns of a, columns of b): a's axis k against an axis of b. Small b is sent to all tasks."""
    kept = [c for i, c in enumerate(a.coords) if i != k]
    rest = [f"b{i}" for i in range(b.ndim) if i != b_axis]
    right = b.df.select(*[F.col(c).alias("_k" if i == b_axis else f"b{i}") for i, c in enumerate(b.coords)], F.col("val").alias("_w"))
    both = met(a.df.withColumnRenamed(a.coords[k], "_k"), right, "_k", b.size <= BROADCAST_CELLS)
    return both.groupBy(*kept, *rest).agg(F.sum(F.col("val") * F.col("_w")).alias("val")), kept, rest


def matmul(a, b) -> DenseFrame:
    """A sparse or dense matrix, or a dense vector, times a dense vector, matrix or batch of matrices (batch axes first): dense, every cell."""
    if isinstance(a, DenseFrame) and a.ndim in (1, 2):
        cells = a.df if a.ndim == 2 else a.df.select(F.lit(0).cast("long").alias("row"), F.col("i0").alias("col"), "val")
        out = matmul(SparseFrame(cells, a.shape if a.ndim == 2 else (1, *a.shape), "csr", coalesced=True), b)
        if a.ndim == 2:
            return out
        from gridweave.operators.manipulation import squeeze

        return squeeze(out, out.ndim - 2 if out.ndim > 1 else 0)
    if not isinstance(a, SparseFrame):
        raise NotImplementedError("the left operand must be a sparse tensor, or a dense matrix or vector")
    if isinstance(b, SparseFrame):
        raise NotImplementedError("sparse times sparse is not supported")
    if a.fmt == "coond":
        raise NotImplementedError("matmul needs a matrix")
    b = _dense(b, "matmul")
    inner = 0 if b.ndim == 1 else b.ndim - 2
    if b.ndim == 0 or b.shape[inner] != a.shape[1]:
        raise ValueError(f"inner dimensions differ: {a.shape} and {b.shape}")
    if b.ndim > 1 and 0 < b.shape[inner] < b.size:
        return _matmul_blocks(a, b)
    sums, kept, rest = _contract(a, 1, b, inner)
    order = kept if b.ndim == 1 else [*rest[:-1], *kept, rest[-1]]
    shape = (*b.shape[: max(0, b.ndim - 2)], a.shape[0], *b.shape[b.ndim - 1 :][: b.ndim > 1])
    return fill(sums, order, shape, a.spark)


def met(cells: DataFrame, right: DataFrame, key: str, sent: bool, hot_cells: int | None = None, right_bytes: int | None = None) -> DataFrame:
    """cells joined with the rows of right on key; right is sent to all tasks, or both sides are shuffled.

    When shuffled, a key with many cells is dealt to SALTS tasks by its cells' other coordinates, and its rows of
    right go to each of them: a row of tiles, whose partial sums the caller's aggregation brings together. Hot keys are those
    with over hot_cells cells and over one in 10,000 of all, so there are few. With right_bytes, the size of right, tasks are as few as
    TASK_BYTES and the cores allow.
    """
    if sent:
        return cells.join(F.broadcast(right), key)
    hot_cells = HOT_CELLS if hot_cells is None else hot_cells
    counts = cells.groupBy(key).agg(F.count("*").alias("_n"))
    total = cells.count()
    hot = F.broadcast(counts.where(F.col("_n") > max(hot_cells, total // 10_000)).select(key, F.lit(True).alias("_hot")))
    others = [c for c in cells.columns if c not in (key, "val")]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*others), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = cells.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    if right_bytes is not None:
        spark = cells.sparkSession
        least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        tasks = max(1, least, -(-(CELL_BYTES * total + right_bytes) // TASK_BYTES))
        here = F.spark_partition_id() >= 0  # always; the planner raises the number of tasks of an exchange that stands right below a join
        dealt, spread = (side.repartition(tasks, key, "_salt").where(here) for side in (dealt, spread))
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def _matmul_blocks(a: SparseFrame, b: DenseFrame) -> DenseFrame:
    """A matrix times a dense matrix or a batch of them: a block of BLOCK_COLUMNS columns of a row of b is one record, and each of them one sum.

    The join then makes a record for each stored cell and block, not for each cell and column of b. The columns of all
    matrices of a batch are numbered in one row, and blocks go across matrices.
    """
    from gridweave.operators.manipulation import linear_key

    lead, k = b.shape[:-2], b.shape[-1]
    columns = math.prod(lead) * k
    blocks, wide = -(-columns // BLOCK_COLUMNS), min(columns, BLOCK_COLUMNS)
    place = linear_key([F.col(c) for c in (*b.coords[:-2], b.coords[-1])], (*lead, k))
    rows = b.df.select(F.col(b.coords[-2]).alias("_k"), place.alias("_place"), F.col("val").alias("_w"))
    rows = rows.select("_k", F.expr(f"_place div {BLOCK_COLUMNS}").alias("_block"), (F.col("_place") % BLOCK_COLUMNS).alias("_at"), "_w")
    records = rows.groupBy("_k", "_block").agg(*[F.sum(F.when(F.col("_at") == j, F.col("_w"))).alias(f"b{j}") for j in range(wide)])
    both = met(a.df.select("row", F.col("col").alias("_k"), "val"), records, "_k", b.size <= BROADCAST_CELLS, right_bytes=8 * b.size)
    sums = both.groupBy("row", "_block").agg(*[F.sum(F.col("val") * F.col(f"b{j}")).alias(f"b{j}") for j in range(wide)])
    every = a.spark.range(a.shape[0] * blocks).select(F.expr(f"id div {blocks}").alias("row"), (F.col("id") % blocks).alias("_block"))
    cells = every.join(sums, ["row", "_block"], "left").select("row", "_block", F.posexplode(F.array(*[F.coalesce(f"b{j}", F.lit(0.0)) for j in range(wide)])).alias("_at", "val"))
    cells = cells.select("row", (F.col("_block") * BLOCK_COLUMNS + F.col("_at")).alias("_place"), "val")
    cells = cells.where(F.col("_place") < columns) if columns % wide else cells
    shape = (*lead, a.shape[0], k)
    strides = [k * math.prod(lead[x + 1 :]) for x in range(len(lead))]
    at = [F.expr(f"(_place div {s}) % {d}L") for s, d in zip(strides, lead, strict=True)]
    return DenseFrame(cells.select(*[c.alias(name) for c, name in zip([*at, F.col("row"), F.expr(f"_place % {k}L")], coord_names(len(shape)), strict=True)], "val"), shape)


def _dense_product(a: DenseFrame, b: DenseFrame, axes_a: list[int], axes_b: list[int]) -> DenseFrame:
    """Sums of products of dense tensors over pairs of axes; the axes left of a come first, then those of b."""
    if [a.shape[k] for k in axes_a] != [b.shape[k] for k in axes_b]:
        raise ValueError(f"inner dimensions differ: {a.shape} and {b.shape}")
    rest = [[k for k in range(x.ndim) if k not in axes] for x, axes in ((a, axes_a), (b, axes_b))]
    sides = []
    for mark, x, axes, own in (("a", a, axes_a, rest[0]), ("b", b, axes_b, rest[1])):
        columns = [F.col(x.coords[k]).alias(f"_k{n}") for n, k in enumerate(axes)] + [F.col(x.coords[k]).alias(f"{mark}{n}") for n, k in enumerate(own)]
        df = x.df.select(*columns, F.col("val").alias("_" + mark))
        sides.append(F.broadcast(df) if mark == "b" and x.size <= BROADCAST_CELLS else df)
    keys = [f"_k{n}" for n in range(len(axes_a))]
    both = sides[0].join(sides[1], keys) if keys else sides[0].crossJoin(sides[1])  # an outer product has as many cells
    shape = tuple(x.shape[k] for x, own in zip((a, b), rest, strict=True) for k in own)
    left = [f"{mark}{n}" for mark, own in zip("ab", rest, strict=True) for n in range(len(own))]
    sums = both.groupBy(*left).agg(F.sum(F.col("_a") * F.col("_b")).alias("val"))
    if 0 in [a.shape[k] for k in axes_a] or not left:
        return fill(sums, left, shape, a.df.sparkSession)
    return DenseFrame(sums.select(*[F.col(c).alias(n) for c, n in zip(left, coord_names(len(shape)), strict=True)], "val"), shape)


def vecdot(a: SparseFrame, b: DenseFrame, axis: int | None = None):
    """The dot product with a vector along an axis: dense for a matrix, coond for a coond tensor.

    Of two dense tensors it is taken along the axis, the last one unless given, of both, in the shape that they broadcast to.
    """
    if isinstance(a, DenseFrame) and isinstance(b, DenseFrame):
        return _dense_dot(a, b, -1 if axis is None else int(axis))
    if isinstance(b, SparseFrame) or not isinstance(b, DenseFrame) or b.ndim != 1:
        raise NotImplementedError("vecdot needs a dense vector")
    k = a.ndim - 1 if axis is None else int(axis)
    k = a.ndim - 1 if k == -1 else k
    if not 0 <= k < a.ndim:
        raise NotImplementedError(f"no axis {axis}")
    if b.shape[0] != a.shape[k]:
        raise ValueError("the vector is not as long as the axis")
    return _along(a, k, b)


def _dense_dot(a: DenseFrame, b: DenseFrame, axis: int) -> DenseFrame:
    from gridweave.operators.elementwise import combined

    if not -min(a.ndim, b.ndim) <= axis < min(a.ndim, b.ndim) or a.shape[axis] != b.shape[axis]:
        raise ValueError(f"no common axis {axis} in {a.shape} and {b.shape}")
    product = combined(lambda u, v: u * v, a, b)
    shape = product.shape
    k = axis % len(shape) if axis < 0 else axis + len(shape) - max(a.ndim, b.ndim)
    names = coord_names(len(shape))
    rest = [c for i, c in enumerate(names) if i != k]
    sums = product.df.groupBy(*rest).agg(F.sum("val").alias("val"))
    out = tuple(n for i, n in enumerate(shape) if i != k)
    if not shape[k] or not rest:
        return fill(sums, rest, out, a.df.sparkSession)
    return DenseFrame(sums.select(*[F.col(c).alias(n) for c, n in zip(rest, coord_names(len(out)), strict=True)], "val"), out)


def _along(a: SparseFrame, k: int, b: DenseFrame):
    sums, kept, rest = _contract(a if a.fmt != "coond" else a.like(a.df.where("val != 0")), k, b, 0)
    shape = (*(n for i, n in enumerate(a.shape) if i != k), *b.shape[1:])
    if a.fmt != "coond" or not shape:
        return fill(sums, [*kept, *rest], shape, a.spark)
    if rest:  # of matrices, sums that cancel are dropped
        sums = sums.where("val != 0")
    names = coord_names(len(shape), "coond")
    return SparseFrame(sums.select(*[F.col(c).alias(n) for c, n in zip([*kept, *rest], names, strict=True)], "val"), shape, "coond", coalesced=True)


def tensordot(a, b: DenseFrame, axes=None):
    """Contraction with the first axis of a dense tensor: the last axis of a matrix, any axis of a coond tensor.

    Of two dense tensors any pairs of axes are contracted, the last two of a with the first two of b unless given.
    """
    if isinstance(a, DenseFrame) and isinstance(b, DenseFrame):
        axes = 2 if axes is None else axes
        if isinstance(axes, int):
            if axes < 0 or axes > min(a.ndim, b.ndim):
                raise ValueError(f"no {axes} axes to contract")
            return _dense_product(a, b, list(range(a.ndim - axes, a.ndim)), list(range(axes)))
        first, second = ([int(k) for k in (x if isinstance(x, (tuple, list)) else [x])] for x in axes)
        return _dense_product(a, b, [k % a.ndim for k in first], [k % b.ndim for k in second])
    axes = 1 if axes is None else axes
    if isinstance(b, SparseFrame):
        raise NotImplementedError("sparse times sparse is not supported")
    b = _dense(b, "tensordot")
    if isinstance(axes, int):
        if axes != 1:
            raise NotImplementedError("tensordot contracts one axis")
        k, other = a.ndim - 1, 0
    else:
        k, other = (int(x[0]) if isinstance(x, (tuple, list)) else int(x) for x in axes)
    if other != 0 or (a.fmt != "coond" and k != 1) or not 0 <= k < a.ndim:
        raise NotImplementedError("tensordot contracts the last axis of a matrix, or any of a coond tensor, with the first of a dense one")
    if b.ndim == 0 or b.shape[0] != a.shape[k]:
        raise ValueError(f"inner dimensions differ: {a.shape} and {b.shape}")
    return _along(a, k, b)


def matrix_transpose(a):
    """Rows for columns: of a sparse matrix in the same format, of a dense tensor in its last two axes."""
    if isinstance(a, DenseFrame):
        from gridweave.operators.manipulation import permute_axes

        if a.ndim < 2:
            raise ValueError("a transpose needs two axes")
        return permute_axes(a, [*range(a.ndim - 2), a.ndim - 1, a.ndim - 2])
    if a.fmt == "coond":
        raise NotImplementedError("a transpose needs a matrix")
    return a.like(a.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), shape=a.shape[::-1])


def frobenius(a) -> float:
    """The root of the sum of the squares of all stored values."""
    total = a.df.agg(F.sum(F.col("val") * F.col("val"))).first()[0]
    return math.sqrt(total or 0.0)
