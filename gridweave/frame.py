"""Sparse and dense tensors as DataFrames of coordinates and values, with their shape beside them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = ("csr", "csc", "coo", "coond")
#: Cells of a dense operand that may be broadcast: 16 to 40 MB with its coordinates.
BROADCAST_CELLS = 1_000_000
#: Cells of an outer product that a task makes, the most tasks for one, and how many cells a row must make to be dealt out for it.
TASK_CELLS, MOST_TASKS, SPREAD = 8_000_000, 20_000, 16


def coord_names(ndim: int, fmt: str | None = None) -> list[str]:
    return ["row", "col"] if ndim == 2 and fmt != "coond" else [f"i{k}" for k in range(ndim)]


def normal_axes(axis, ndim: int) -> tuple[int, ...]:
    """Sorted axes without repeats, counted from the front; all of them for None."""
    if axis is None:
        return tuple(range(ndim))
    axes = axis if isinstance(axis, (tuple, list)) else (axis,)
    if not axes:
        raise NotImplementedError("an empty tuple of axes is not supported")
    if any(not -ndim <= int(a) < ndim for a in axes):
        raise ValueError(f"axis {axis} is out of range for {ndim} dimensions")
    return tuple(sorted({int(a) % ndim for a in axes}))


class DenseFrame:
    """A tensor with a row for every cell: coordinates and `val`."""

    def __init__(self, df: DataFrame, shape: tuple[int, ...]):
        self.df, self.shape, self.ndim = df, tuple(int(n) for n in shape), len(shape)
        self.coords = coord_names(self.ndim)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def hinted(self) -> DataFrame:
        """Its rows, marked for broadcast where the shape proves them few."""
        return F.broadcast(self.df) if self.size <= BROADCAST_CELLS else self.df

    def toarray(self) -> np.ndarray:
        """All cells on the driver."""
        got = self.df.select(*self.coords, "val").toPandas()
        kind = bool if dict(self.df.dtypes)["val"] == "boolean" else np.int64 if dict(self.df.dtypes)["val"] == "bigint" else np.float64
        out = np.zeros(self.shape, kind)
        out[tuple(got[c].to_numpy(np.int64) for c in self.coords)] = got["val"].to_numpy(kind) if self.ndim else got["val"].to_numpy(kind)[0]
        return out

    def item(self):
        """The value of a single cell."""
        if self.size != 1:
            raise ValueError("only a tensor of one cell has an item")
        return self.df.select("val").first()[0]

    def __repr__(self) -> str:
        return f"{type(self).__name__}(shape={self.shape})"

    def tiles(self, cells: int = 4_000_000):
        """(first row, array) of blocks of whole rows, in order, of at most so many cells (or one row): one is on the driver at a time."""
        from gridweave.sources import tiles

        return tiles.streamed(self, cells)


class StretchedFrame(DenseFrame):
    """A dense tensor repeated along axes of length one, which it carries without making the cells.

    base holds the cells, with as many axes as shape, of length one where they repeat. Functions of several tensors join on the
    axes that are real on both sides; whatever else needs all cells finds them in df, made where they are read.
    """

    def __init__(self, base: DenseFrame, shape: tuple[int, ...]):
        self.base, self.shape, self.ndim = base, tuple(int(n) for n in shape), len(shape)
        self.coords = coord_names(self.ndim)

    @property
    def df(self) -> DataFrame:
        if not self.size:
            return self.base.df.select(*self.coords, "val").limit(0)
        repeated = {c: n for c, n, own in zip(self.coords, self.shape, self.base.shape, strict=True) if n != own}
        if not repeated:
            return self.base.df.select(*self.coords, "val")
        times = math.prod(repeated.values())
        places = grid(self.base.df.sparkSession, tuple(repeated.values()), list(repeated), tasks_for(self.size))
        return beside(self.base.df.drop(*repeated), self.base.size, places, times, lies=True).select(*self.coords, "val")


class FilledFrame(DenseFrame):
    """A tensor of stored cells, each once, and a value that all others have.

    Functions of single values, and of two such tensors, work on stored cells and the value alone. Whatever
    needs every cell finds them in df, made where they are read.
    """

    def __init__(self, stored: DataFrame, shape: tuple[int, ...], value):
        self.stored, self.shape, self.ndim, self.value = stored, tuple(int(n) for n in shape), len(shape), value
        self.coords = coord_names(self.ndim)

    @property
    def df(self) -> DataFrame:
        return fill(self.stored, self.coords, self.shape, self.stored.sparkSession, F.lit(self.value)).df

    @property
    def nnz(self) -> int:
        return self.stored.count()

    def toarray(self) -> np.ndarray:
        """All cells on the driver, made from the stored ones."""
        got = self.stored.select(*self.coords, "val").toPandas()
        out = np.full(self.shape, self.value)
        out[tuple(got[c].to_numpy(np.int64) for c in self.coords)] = got["val"].to_numpy(out.dtype)
        return out


class SparseFrame:
    """A tensor with a row for each stored cell; missing cells are 0.0.

    Columns are row and col for matrices, else i0, i1 and so on, then val (double). fmt is csr, csc, coo or
    coond: it says which operators accept the tensor and how repeated cells are read. coalesced is True where
    no cell is known to be stored twice, which spares a shuffle.
    """

    def __init__(self, df: DataFrame, shape: tuple[int, ...], fmt: str = "coo", coalesced: bool = False):
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt}")
        self.shape, self.ndim, self.fmt, self.coalesced = tuple(int(n) for n in shape), len(shape), fmt, coalesced
        if fmt != "coond" and self.ndim != 2:
            raise ValueError(f"{fmt} needs two dimensions")
        if not self.ndim or min(self.shape) < 0:
            raise ValueError(f"not a shape: {shape}")
        self.coords = coord_names(self.ndim, fmt)
        self.df = df
        self.dtype = np.dtype(np.float64)

    # ---- construction

    @classmethod
    def from_triples(cls, df: DataFrame, shape, coords: list[str] | None = None, val: str = "val", fmt: str = "coo", coalesced: bool = False, check: bool = False) -> SparseFrame:
        """From a table of coordinates and values. check: raises ValueError if a coordinate is out of bounds, in one job."""
        names = coord_names(len(shape), fmt)
        own = df.select(*[F.col(c).cast("long").alias(n) for c, n in zip(coords or names, names, strict=True)], F.col(val).cast("double").alias("val"))
        out = cls(own, shape, fmt, coalesced)
        return out.validate() if check else out

    def validate(self) -> SparseFrame:
        """Raises ValueError on null or out-of-bounds coordinates, null values, or repeats in csr and csc."""
        wrong = F.lit(False)
        for c, n in zip(self.coords, self.shape, strict=True):
            wrong = wrong | F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= n)
        if self.df.where(wrong | F.col("val").isNull()).limit(1).count():
            raise ValueError("coordinates or values are missing or out of bounds")
        if self.fmt in ("csr", "csc") and not self.coalesced and self.df.groupBy(*self.coords).count().where("count > 1").limit(1).count():
            raise ValueError("a cell is stored more than once")
        return self

    def like(self, df: DataFrame, shape=None, fmt: str | None = None, coalesced: bool | None = None) -> SparseFrame:
        return SparseFrame(df, shape or self.shape, fmt or self.fmt, self.coalesced if coalesced is None else coalesced)

    # ---- facts

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def nnz(self) -> int:
        """Stored cells, repeats and stored zeros included."""
        return self.df.count()

    def __array_namespace__(self, api_version=None):
        from gridweave import xp

        return xp

    def __repr__(self) -> str:
        return f"SparseFrame(fmt={self.fmt}, shape={self.shape})"

    # ---- forms

    def coalesce(self, order: str | None = None) -> SparseFrame:
        """Repeated cells added up; zero sums stay stored.

        order: a column beside the values, in whose order each cell's are added, one after another. Without it the last digits of a
        sum of three values and more depend on how the rows are dealt out, and so does the order of sums that are nearly equal.
        """
        if self.coalesced:
            return self
        if order is not None:
            line = Window.partitionBy(*self.coords).orderBy(order, "val")
            so_far = self.df.select(*self.coords, F.sum("val").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("val"), F.lead(F.lit(False), 1, True).over(line).alias("_last"))
            return self.like(so_far.where("_last").drop("_last"), coalesced=True)
        return self.like(self.df.groupBy(*self.coords).agg(F.sum("val").alias("val")), coalesced=True)

    def map_values(self, fn) -> SparseFrame:
        return self.like(self.df.select(*self.coords, fn(F.col("val")).cast("double").alias("val")))

    def filled(self, value: float = 0.0) -> FilledFrame:
        """The stored cells, repeats added up, with a value for all others."""
        names = coord_names(self.ndim)
        return FilledFrame(self.coalesce().df.select(*[F.col(c).alias(n) for c, n in zip(self.coords, names, strict=True)], "val"), self.shape, value)

    def tiles(self, cells: int = 4_000_000):
        """(first row, array) of blocks of whole rows, as of a dense tensor; only stored cells travel to the tasks that make them."""
        from gridweave.sources import tiles

        return tiles.streamed(self, cells)

    def todense(self) -> DenseFrame:
        """A row for every cell, repeats added up."""
        return fill(self.coalesce().df, self.coords, self.shape, self.spark)

    def toarray(self) -> np.ndarray:
        """All cells on the driver, made from the stored ones."""
        got = self.df.toPandas()
        out = np.zeros(self.shape)
        np.add.at(out, tuple(got[c].to_numpy(np.int64) for c in self.coords), got["val"].to_numpy())
        return out

    def persist(self) -> SparseFrame:
        return self.like(self.df.persist())

    # ---- operators

    def _pair(self, other, name: str):
        from gridweave.operators import elementwise

        if not isinstance(other, SparseFrame) or other.fmt != self.fmt or self.fmt not in ("csr", "csc"):
            return NotImplemented
        return elementwise.pairwise(name, self, other)

    def __add__(self, other):
        return self._pair(other, "add")

    def __sub__(self, other):
        return self._pair(other, "subtract")

    def _scalar(self, name: str, alpha):
        from gridweave.operators import elementwise

        return elementwise.scalar(name, self, alpha) if isinstance(alpha, (int, float)) and not isinstance(alpha, bool) else NotImplemented

    def __mul__(self, alpha):
        return self._scalar("multiply", alpha)

    __rmul__ = __mul__

    def __truediv__(self, alpha):
        return self._scalar("divide", alpha)

    def __floordiv__(self, alpha):
        return self._scalar("floor_divide", alpha)

    def __mod__(self, alpha):
        return self._scalar("remainder", alpha)

    def __pow__(self, alpha):
        return self._scalar("pow", alpha)

    def __neg__(self):
        return self.map_values(lambda v: -v)

    def __abs__(self):
        return self.map_values(F.abs)

    def __matmul__(self, other):
        from gridweave.operators import linalg

        return linalg.matmul(self, other)

    def __getitem__(self, key):
        from gridweave.operators import manipulation

        return manipulation.getitem(self, key)

    @property
    def T(self) -> SparseFrame:  # noqa: N802
        from gridweave.operators import linalg

        return linalg.matrix_transpose(self)


def _method(module: str, name: str, *first):
    def call(self, *args, **kwargs):
        import importlib

        return getattr(importlib.import_module(f"gridweave.operators.{module}"), name)(*first, self, *args, **kwargs)

    call.__name__, call.__doc__ = name, f"See gridweave.operators.{module}.{name}."
    return call


for _name in ("multiply", "divide", "remainder", "power", "floor_divide"):
    setattr(SparseFrame, _name, _method("elementwise", "pairwise", {"power": "pow"}.get(_name, _name)))
for _module, _names in {
    "elementwise": ["sign", "hadamard_broadcast"],
    "reductions": ["sum", "mean", "reduce_sum_axes", "reduce_mean_axes"],
    "manipulation": ["prune", "eliminate_zeros", "astype", "permute_axes", "reshape", "to_csr", "to_csc", "to_coo", "mode_unfold_to_csr", "mode_unfold_to_csc", "axes_unfold_to_csr", "axes_unfold_to_csc", "row_pointers"],
}.items():
    for _name in _names:
        setattr(SparseFrame, _name, _method(_module, _name))


def tasks_for(cells: int) -> int:
    """Into how many tasks the making of so many cells is dealt."""
    return max(1, min(-(-cells // TASK_CELLS), MOST_TASKS))


def dealt(df: DataFrame, rows: int, times: int) -> DataFrame:
    """df (so many rows), in as many tasks as it takes where each row makes `times` cells; as it lies where that is little."""
    tasks = min(rows, tasks_for(rows * times))
    return df.repartition(tasks) if tasks > 1 and times >= SPREAD else df


def beside(a: DataFrame, n: int, b: DataFrame, m: int, lies: bool = False) -> DataFrame:
    """Each of the n rows of a beside each of the m rows of b.

    One side is dealt to as many tasks as the product takes, and the other sent to all of them, so no cell of the product moves. The
    first is b where a has too few rows. lies: b lies in its tasks already.
    """
    if m > max(n, BROADCAST_CELLS) or n < min(m, tasks_for(n * m)):
        return (b if lies else dealt(b, m, n)).crossJoin(F.broadcast(a) if n <= BROADCAST_CELLS else a)
    return dealt(a, n, m).crossJoin(F.broadcast(b) if m <= BROADCAST_CELLS else b)


def grid(spark: SparkSession, shape: tuple[int, ...], coords: list[str], tasks: int | None = None) -> DataFrame:
    """A row for every cell of a shape, in so many tasks at least."""
    cells, strides = spark.range(math.prod(shape)), [math.prod(shape[k + 1 :]) for k in range(len(shape))]
    if tasks is not None and tasks > spark.sparkContext.defaultParallelism:
        cells = spark.range(0, math.prod(shape), 1, tasks)
    parts = [(F.expr(f"id div {max(1, s)}") % F.lit(max(1, n))).alias(c) for c, s, n in zip(coords, strides, shape, strict=True)]
    return cells.select(*parts)


def fill(df: DataFrame, coords: list[str], shape: tuple[int, ...], spark: SparkSession, default: Column | None = None) -> DenseFrame:
    """df (one row for a cell at most) with every missing cell set to the default, 0.0 unless given."""
    default = F.lit(0.0) if default is None else default
    if not shape:
        return DenseFrame(df.select(F.coalesce("val", default).alias("val")), ())
    names = coord_names(len(shape))
    own = df.select(*[F.col(c).alias(n) for c, n in zip(coords, names, strict=True)], "val")
    return DenseFrame(grid(spark, shape, names).join(own, names, "left").select(*names, F.coalesce("val", default).alias("val")), shape)


def dense(spark: SparkSession, values) -> DenseFrame:
    """A dense tensor from a NumPy array or nested lists, given on the driver."""
    x = np.asarray(values, dtype=np.float64)
    names = coord_names(x.ndim)
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(x)]
    return DenseFrame(spark.createDataFrame(rows, ", ".join([*(f"{n} long" for n in names), "val double"])), x.shape)


def dense_table(df: DataFrame, shape, coords: list[str], val: str) -> DenseFrame:
    """A dense tensor from a table that has a row for every cell."""
    names = coord_names(len(shape))
    return DenseFrame(df.select(*[F.col(c).cast("long").alias(n) for c, n in zip(coords, names, strict=True)], F.col(val).cast("double").alias("val")), shape)
