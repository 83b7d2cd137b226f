"""An array namespace over sparse and dense frames, after the Array API standard.

Sparse tensors take the operators that keep them sparse; where a result would have to be filled, they are
refused. Dense frames take all of them. Names that only make sense in memory (from_dlpack, dtypes) are thin.
"""

from __future__ import annotations

import builtins
import math

import numpy as np
from pyspark.sql import SparkSession

from gridweave.frame import DenseFrame, FilledFrame, SparseFrame, dense
from gridweave.functions import expr
from gridweave.operators import elementwise, linalg, manipulation, reductions, searching
from gridweave.sources import creation

__array_api_version__ = "2024.12"
e, pi, inf, nan, newaxis = math.e, math.pi, math.inf, math.nan, None
float64, int64, bool = np.float64, np.int64, np.bool_  # noqa: A001


def _spark(spark=None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    return spark


def _sparse(*xs) -> builtins.bool:
    return builtins.any(isinstance(x, SparseFrame) for x in xs)


def any_number(x) -> builtins.bool:
    return isinstance(x, (int, float)) and not isinstance(x, builtins.bool)


# ---- creation

def asarray(obj, *, dtype=None, device=None, copy=None):
    return obj if isinstance(obj, (SparseFrame, DenseFrame)) else dense(_spark(), obj)


from_dlpack = asarray


def zeros(shape, *, dtype=None, device=None):
    return creation.zeros(_spark(), shape, dtype, device)


def empty(shape, *, dtype=None, device=None):
    return creation.zeros(_spark(), shape, dtype, device)


def zeros_like(x, *, dtype=None, device=None):
    return creation.zeros(_spark(), x.shape, dtype, device)


empty_like = zeros_like


def ones(shape, *, dtype=None, device=None):
    return creation.ones(_spark(), shape)


def full(shape, fill_value, *, dtype=None, device=None):
    return creation.full(_spark(), shape, fill_value)


def ones_like(x, *, dtype=None, device=None):
    return creation.ones(_spark(), x.shape)


def full_like(x, fill_value, *, dtype=None, device=None):
    return creation.full(_spark(), x.shape, fill_value)


def arange(start, stop=None, step=1, *, dtype=None, device=None):
    return creation.arange(_spark(), start, stop, step)


def linspace(start, stop, num, *, dtype=None, device=None):
    return creation.linspace(_spark(), start, stop, num)


def eye(n_rows, n_cols=None, k=0, *, dtype=None, device=None):
    return creation.eye(_spark(), n_rows, n_cols, k, dtype, device)


meshgrid = creation.meshgrid


# ---- types

def astype(x, dtype, /, *, copy=True):
    return manipulation.astype(x, dtype)


can_cast, finfo, iinfo = np.can_cast, np.finfo, np.iinfo


def isdtype(dtype, kind):
    return np.isdtype(np.dtype(dtype), kind)


def result_type(*arrays_and_dtypes):
    return np.result_type(*[np.float64 if isinstance(x, (SparseFrame, DenseFrame)) else x for x in arrays_and_dtypes])


#: The pairs of types that promote to another one; equal types stay, and the rest do not mix.
PROMOTE = {("float32", "int64"): "float64", ("float32", "int32"): "float32", ("int32", "int64"): "int64"}


def promote_dtypes(a: str, b: str) -> str:
    if a == b:
        return a
    if "float64" in (a, b) and {a, b} <= {"float64", "float32", "int32", "int64"}:
        return "float64"
    if found := PROMOTE.get(tuple(sorted((a, b)))):
        return found
    raise TypeError(f"{a} and {b} do not mix")


# ---- elementwise

def _binary(name: str, sparse_scalar: builtins.bool = False, sparse_pair: builtins.bool = False):
    def call(x, y):
        if not _sparse(x, y):
            return elementwise.binary(name, x, y)
        if _sparse(x) and _sparse(y) and sparse_pair:
            if x.fmt != y.fmt:
                raise NotImplementedError("tensors of different formats")
            return elementwise.pairwise(name, x, y) if name not in ("maximum", "minimum") else elementwise.union_support(name, x, y)
        if sparse_scalar and any_number(y):
            return elementwise.scalar(name, x, y)
        if name == "multiply" and any_number(x):
            return elementwise.scalar(name, y, x)
        raise NotImplementedError(f"{name} of these operands would fill a sparse tensor")

    call.__name__ = name
    return call


def _comparison(name: str):
    def call(x, y):
        return elementwise.compare(name, x, y)

    call.__name__ = name
    return call


def _unary(name: str):
    def call(x):
        return elementwise.unary(name, x)

    call.__name__ = name
    return call


for _name in expr.UNARY:
    globals()[_name] = _unary(_name)
for _name in expr.BINARY:
    globals()[_name] = _binary(_name, _name in ("multiply", "divide", "floor_divide", "remainder", "pow"), _name in ("add", "subtract", "multiply", "divide", "floor_divide", "remainder", "pow", "maximum", "minimum"))
for _name in expr.COMPARE:
    globals()[_name] = _comparison(_name)
nextafter = elementwise.nextafter


# ---- linear algebra

matmul, tensordot, vecdot, matrix_transpose = linalg.matmul, linalg.tensordot, linalg.vecdot, linalg.matrix_transpose


# ---- shapes

reshape, permute_dims, moveaxis = manipulation.reshape, manipulation.permute_axes, manipulation.moveaxis
squeeze, expand_dims, flip, roll = manipulation.squeeze, manipulation.expand_dims, manipulation.flip, manipulation.roll
stack, concat, unstack = manipulation.stack, manipulation.concat, manipulation.unstack
broadcast_to, broadcast_arrays = manipulation.broadcast_to, manipulation.broadcast_arrays
repeat, tile, tril, triu = manipulation.repeat, manipulation.tile, manipulation.tril, manipulation.triu
take_along_axis = manipulation.take_along_axis


def take(x, indices, /, *, axis=None):
    return manipulation.take(x, list(indices), 0 if axis is None and x.ndim == 1 else axis)


# ---- reductions

def _reduction(name: str):
    def call(x, axis=None, keepdims=False):
        if isinstance(x, FilledFrame):
            return reductions.reduce_filled(name, x, axis, keepdims)
        return reductions.reduce(name, _stored(x), axis, keepdims, nan=isinstance(x, DenseFrame))

    call.__name__ = name
    return call


def _stored(x) -> SparseFrame:
    """A dense frame's cells, read as a sparse tensor that stores all of them."""
    return x if isinstance(x, SparseFrame) else SparseFrame(x.df, x.shape, "csr" if x.ndim == 2 else "coond", coalesced=True)


_REDUCED = ("sum", "prod", "min", "max", "mean", "all", "any")
for _name in _REDUCED:
    globals()[_name] = _reduction(_name)


def var(x, axis=None, correction=0.0, keepdims=False):
    return reductions.reduce("var", _stored(x), axis, keepdims, correction)


def std(x, axis=None, correction=0.0, keepdims=False):
    return reductions.reduce("std", _stored(x), axis, keepdims, correction)


def cumulative_sum(x, axis=None):
    return reductions.cumulative_sum(x, axis)


def cumulative_prod(x, axis=None):
    return reductions.cumulative_prod(x, axis)


def diff(x, *, n=1, axis=-1):
    """Of a sparse tensor it is sparse, of a dense one dense."""
    out = reductions.diff(_stored(x), n, axis)
    return out if isinstance(x, SparseFrame) else out.todense()


# ---- searching, sorting, sets

count_nonzero, nonzero, where, searchsorted = searching.count_nonzero, searching.nonzero, searching.where, searching.searchsorted



def sort(x, axis=-1, descending=False, stable=True):
    return searching.sort(x, axis, descending)


def argsort(x, axis=-1, descending=False, stable=True):
    return searching.argsort(x, axis, descending)


unique_values, unique_counts, unique_inverse, unique_all = searching.unique_values, searching.unique_counts, searching.unique_inverse, searching.unique_all


def argmax(x, axis=None, keepdims=False):
    return _arg("argmax", x, axis, keepdims)


def argmin(x, axis=None, keepdims=False):
    return _arg("argmin", x, axis, keepdims)


def _arg(name: str, x, axis, keepdims):
    own = x.todense() if isinstance(x, SparseFrame) else x
    if axis is not None:
        return searching.arg_extreme(name, own, axis, keepdims)
    out = searching.arg_extreme(name, manipulation.reshape(own, (math.prod(own.shape),)), 0)
    return manipulation.reshape(out, (1,) * x.ndim) if keepdims else out


# ---- about

def set_num_threads(n: int, spark=None) -> None:
    """How many tasks a shuffle is dealt to."""
    if n > 0:
        _spark(spark).conf.set("spark.sql.shuffle.partitions", str(int(n)))


def get_num_threads(spark=None) -> int:
    return builtins.max(1, int(_spark(spark).conf.get("spark.sql.shuffle.partitions")))


def __array_namespace_info__() -> dict:
    return {
        "devices": ["cpu"],
        "default_device": "cpu",
        "dtypes": ["bool", "int64", "float64"],
        "default_dtypes": {"floating": "float64", "integral": "int64", "boolean": "bool"},
        "capabilities": {"sparse": True} | {part: _exported(part) for part in ("linalg", "searching", "manipulation", "creation")} | {"reductions": [*_REDUCED, "var", "std", *_exported("reductions")]} | {"elementwise": [*expr.UNARY, *expr.BINARY, "nextafter"]},
    }


def _exported(part: str) -> list[str]:
    """The names of this namespace that are functions of a part of the library."""
    module = {"linalg": linalg, "reductions": reductions, "searching": searching, "manipulation": manipulation, "creation": creation}[part]
    return sorted(k for k, v in globals().items() if callable(v) and not isinstance(v, type) and not k.startswith("_") and k not in _REDUCED and (hasattr(module, k) or getattr(v, "__module__", "") == module.__name__))


def __getattr__(name: str):
    if name.startswith("_"):
        raise AttributeError(name)
    raise NotImplementedError(f"{name} is not in this namespace")
