"""Queries for what goes beyond one operator in one format: stretched and filled tensors, dense input, blocks, files, tiles.

The tensors are those of the other query modules. `full` is customer nations by supplier nations without cells of few
quantities, scaled to values near one: some of its lines have every cell, others miss some.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridweave import xp
from gridweave.format_queries import _INF, _NAN, _V, ADDED, DAYS, GRID, USERS, daily, folded, ninths, scaled, DOUBLED
from gridweave.frame import DenseFrame, SparseFrame, dense_table
from gridweave.operators import elementwise, linalg, manipulation, reductions
from gridweave.plans import algorithms
from gridweave.plans.ranges import shared_folder
from gridweave.queries import COLS, N_SQL, Q_SQL, ROWS, VALUES, _count, _table, _val, balances, nations, query, quantities
from gridweave.sources import creation, matrix_market, tiles

# ---- lines with all their cells, and without

#: Cells under the mean less SHARE of it are missing.
SHARE = 0.1
FULL = f"SELECT r, c, v / m AS v FROM (SELECT *, avg(v) OVER () AS m FROM ({N_SQL})) WHERE v >= {1 - SHARE} * m"


def full(s, d, fmt: str = "csr") -> SparseFrame:
    own = nations(s, d)
    mean = F.broadcast(own.df.agg(F.avg("val").alias("m")))  # one row
    cells = own.df.crossJoin(mean).where(F.col("val") >= (1 - SHARE) * F.col("m")).select("row", "col", (F.col("val") / F.col("m")).alias("val"))
    if fmt == "coond":
        return SparseFrame(cells.withColumnsRenamed({"row": "i0", "col": "i1"}), own.shape, "coond", coalesced=True)
    return SparseFrame(cells, own.shape, fmt, coalesced=True)


for _fmt in ("csr", "csc", "coo", "coond"):
    for _name in ("prod", "all", "min", "any"):
        _value, _default = VALUES[_name]
        _plain = _name in ("all", "any")
        _own = "sum(v) AS s, count(*) AS n, min(v) AS lo, max(v) AS hi, product(v) AS p, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS t"
        _out = lambda sql, plain=_plain: f"{sql} AS val" if plain else _val(sql)
        for _axis, _kept in ((0, "c"), (1, "r")):
            _lines = f"SELECT k AS i0, {_out(_value)} FROM y, z" if _fmt == "coond" else f"SELECT i AS i0, {_out(f'CASE WHEN k IS NULL THEN {_default} ELSE {_value} END')} FROM range(25) t(i) CROSS JOIN z LEFT JOIN y ON k = i"
            query(f"{_name}_axis{_axis}_full_{_fmt}", f"WITH x AS ({FULL}), z AS (SELECT CAST(25 AS DOUBLE) AS m), y AS (SELECT {_kept} AS k, {_own} FROM x GROUP BY {_kept}) {_lines}")(
                lambda s, d, name=_name, axis=_axis, fmt=_fmt: reductions.reduce(name, full(s, d, fmt), axis)
            )
    query(f"prod_all_full_{_fmt}", f"WITH x AS (SELECT 1 + (v / avg(v) OVER () - 1) / 50 AS v FROM ({N_SQL})) SELECT {_val('CASE WHEN count(*) = 625 THEN product(v) ELSE 0 END')} FROM x")(
        lambda s, d, fmt=_fmt: reductions.reduce("prod", _near_one(s, d, fmt))
    )
    query(f"all_all_full_{_fmt}", f"SELECT count(*) = 625 AS val FROM ({N_SQL}) WHERE v <> 0")(lambda s, d, fmt=_fmt: reductions.reduce("all", _near_one(s, d, fmt)))


def _near_one(s, d, fmt: str) -> SparseFrame:
    """Every cell, a fiftieth of its distance from one away from one, in relation to the mean."""
    own = nations(s, d)
    mean = F.broadcast(own.df.agg(F.avg("val").alias("m")))  # one row
    cells = own.df.crossJoin(mean).select("row", "col", (1 + (F.col("val") / F.col("m") - 1) / 50).alias("val"))
    return SparseFrame(cells.withColumnsRenamed({"row": "i0", "col": "i1"}) if fmt == "coond" else cells, own.shape, fmt, coalesced=True)


query("isnan_mixed", "SELECT s_suppkey AS i0, s_suppkey % 9 = 4 AS val FROM supplier")(lambda s, d: xp.isnan(xp.divide(ninths(s, d), ninths(s, d))))
query("isfinite_mixed", "SELECT s_suppkey AS i0, s_suppkey % 9 <> 4 AS val FROM supplier")(lambda s, d: xp.isfinite(xp.divide(1.0, ninths(s, d))))
query("logical_and_mixed", "SELECT s_suppkey AS i0, s_suppkey % 9 <> 4 AND s_suppkey % 5 <> 0 AS val FROM supplier")(
    lambda s, d: xp.logical_and(ninths(s, d), dense_table(_table(s, d, "supplier").withColumn("w", F.col("s_suppkey") % 5), (_count(s, d, "supplier"),), ["s_suppkey"], "w"))
)
for _name in ("max", "min"):
    query(f"{_name}_dense_with_nan", f"SELECT {_NAN} AS val FROM supplier HAVING count(*) FILTER (s_acctbal < 0) > 0 UNION ALL SELECT {_val(f'{_name}(ln(s_acctbal))')} FROM supplier HAVING count(*) FILTER (s_acctbal < 0) = 0")(
        lambda s, d, name=_name: getattr(xp, name)(xp.log(balances(s, d)))
    )

# ---- creation in the size of a table

query("zeros_sized", f"SELECT i AS i0, CAST(0 AS DOUBLE) AS val FROM range({ROWS}) t(i)")(lambda s, d: manipulation.squeeze(creation.zeros(s, (_count(s, d, "supplier"), 1)).todense(), 1))
query("eye_sized", f"SELECT i AS row, i AS col, CAST(1 AS DOUBLE) AS val FROM range({ROWS}) t(i)")(lambda s, d: creation.eye(s, _count(s, d, "supplier")))
query("ones_sized", f"SELECT a.i AS row, b.i AS col, CAST(1 AS DOUBLE) AS val FROM range({ROWS}) a(i) CROSS JOIN range(25) b(i)")(lambda s, d: creation.ones(s, (_count(s, d, "supplier"), _count(s, d, "nation"))))
query("full_sized", f"SELECT i AS i0, {_val('(SELECT max(p_retailprice) FROM part)')} FROM range({ROWS}) t(i)")(
    lambda s, d: creation.full(s, (_count(s, d, "supplier"),), _table(s, d, "part").agg(F.max("p_retailprice")).first()[0])
)
query("arange_sized", f"SELECT i AS i0, CAST(1 + 2 * i AS DOUBLE) AS val FROM range({COLS}) t(i)")(lambda s, d: creation.arange(s, 1, 2 * _count(s, d, "part") + 1, 2))


@query("linspace_sized", f"SELECT i AS i0, {_val('lo + i * (hi - lo) / (n - 1)')} FROM range({COLS}) t(i), (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*) AS n FROM part)")
def _linspace(s, d):
    lo, hi = _table(s, d, "part").agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    return creation.linspace(s, lo, hi, _count(s, d, "part"))


# ---- stretched

query("add_row_and_column", f"WITH {GRID}, a AS ({_V}) SELECT x.i AS row, y.i AS col, {_val('x.v + y.w')} FROM a x CROSS JOIN a y")(lambda s, d: xp.add(xp.expand_dims(scaled(s, d), 1), ninths(s, d)))
query("less_broadcast", f"WITH {GRID} SELECT r AS row, c AS col, v < c - 70 AS val FROM g")(lambda s, d: xp.less(daily(s, d).todense(), xp.arange(-70, DAYS - 70)))
query("where_numbers", f"WITH {GRID} SELECT r AS row, c AS col, {_val('CASE WHEN v > 0 THEN v ELSE -1 END')} FROM g")(lambda s, d: (lambda x: xp.where(xp.greater(x, 0.0), x, -1.0))(daily(s, d).todense()))
query("where_broadcast", f"WITH {GRID} SELECT r AS row, c AS col, {_val('CASE WHEN v <> 0 THEN c ELSE r END')} FROM g")(
    lambda s, d: (lambda x: xp.where(x, xp.arange(DAYS), xp.expand_dims(xp.arange(x.shape[0]), 1)))(daily(s, d))
)
query("atan2_broadcast", f"WITH {GRID} SELECT r AS row, c AS col, {_val('atan2(v, c + 1)')} FROM g")(lambda s, d: xp.atan2(daily(s, d).todense(), xp.arange(1, DAYS + 1)))

# ---- filled

query("exp_filled", f"WITH {GRID} SELECT r AS row, c AS col, {_val('exp(v / 100)')} FROM g")(lambda s, d: xp.exp(elementwise.scalar("divide", daily(s, d), 100.0)))
query("cos_filled", f"WITH {GRID} SELECT r AS row, c AS col, {_val('cos(v)')} FROM g")(lambda s, d: xp.cos(daily(s, d, "csc")))
query("isfinite_filled", f"WITH {GRID} SELECT r AS row, c AS col, true AS val FROM g")(lambda s, d: xp.isfinite(daily(s, d)))
query("equal_filled_cells", f"SELECT r AS row, c AS col, v = 0 AS val FROM ({ADDED})")(lambda s, d: xp.equal(daily(s, d), 0.0).stored)
query("less_of_two_filled", f"WITH {GRID}, b AS ({DOUBLED}) SELECT g.r AS row, g.c AS col, g.v < coalesce(b.v, 0) AS val FROM g LEFT JOIN b ON b.r = g.r AND b.c = g.c")(lambda s, d: xp.less(daily(s, d), folded(s, d, "csr")))
query("filled_times_dense", f"WITH {GRID} SELECT r AS row, c AS col, {_val('exp(v / 100) * v')} FROM g")(lambda s, d: (lambda x: xp.multiply(xp.exp(elementwise.scalar("divide", x, 100.0)), x.todense()))(daily(s, d)))

for _name, _sql in (("sum", "sum(exp(v / 100))"), ("max", "max(exp(v / 100))"), ("min", "min(exp(v / 100))"), ("mean", "avg(exp(v / 100))")):
    query(f"{_name}_of_filled", f"WITH {GRID} SELECT r AS i0, {_val(_sql)} FROM g GROUP BY r")(lambda s, d, name=_name: getattr(xp, name)(xp.exp(elementwise.scalar("divide", daily(s, d), 100.0)), axis=1))
query("all_of_filled", f"WITH {GRID} SELECT c AS i0, bool_and(v < 40) AS val FROM g GROUP BY c")(lambda s, d: xp.all(xp.less(daily(s, d, "csc"), 40.0), axis=0))
query("any_of_filled", f"WITH {GRID} SELECT c AS i0, bool_or(v > 40) AS val FROM g GROUP BY c")(lambda s, d: xp.any(xp.greater(daily(s, d, "csc"), 40.0), axis=0))

# ---- dense input

query("vecdot_dense", f"WITH {GRID} SELECT r AS i0, {_val('sum(v * (c + 1)) / 1e4')} FROM g GROUP BY r")(lambda s, d: xp.divide(xp.vecdot(daily(s, d).todense(), xp.arange(1, DAYS + 1)), 1e4))
query("tensordot_dense", f"WITH {GRID} SELECT {_val('sum(v * v) / 1e6')} FROM g")(lambda s, d: (lambda x: xp.divide(xp.tensordot(x, x), 1e6))(daily(s, d).todense()))
query("tensordot_dense_axes", f"WITH n AS ({N_SQL}) SELECT a.c AS row, b.c AS col, {_val('sum(a.v * b.v) / 1e6')} FROM n a JOIN n b USING (r) GROUP BY ALL")(lambda s, d: (lambda x: xp.divide(xp.tensordot(x, x, axes=([0], [0])), 1e6))(nations(s, d).todense()))
query("matrix_transpose_dense", f"WITH {GRID} SELECT c AS row, r AS col, {_val('v')} FROM g")(lambda s, d: xp.matrix_transpose(daily(s, d).todense()))
query("astype_dense", f"WITH {GRID} SELECT r AS row, c AS col, CAST(trunc(v) AS BIGINT) AS val FROM g")(lambda s, d: xp.astype(daily(s, d).todense(), np.int64))
query("tril_stack", f"WITH {GRID} SELECT CAST(k AS BIGINT) AS i0, r AS i1, c AS i2, {_val('CASE WHEN c - r <= -1 THEN (k + 1) * v ELSE 0 END')} FROM g CROSS JOIN range(2) t(k)")(
    lambda s, d: (lambda x: xp.tril(xp.stack([x, xp.multiply(x, 2.0)]), k=-1))(daily(s, d).todense())
)
query("tile_more_axes", f"WITH {GRID} SELECT CAST(k AS BIGINT) AS i0, r AS i1, c AS i2, {_val('v')} FROM g CROSS JOIN range(2) t(k)")(lambda s, d: xp.tile(daily(s, d).todense(), (2, 1, 1)))
query("concat_flat", f"WITH {GRID} SELECT r * {DAYS} + c AS i0, {_val('v')} FROM g UNION ALL SELECT {USERS} * {DAYS} + c * {USERS} + r, {_val('v')} FROM g")(lambda s, d: (lambda x: xp.concat([x, xp.matrix_transpose(x)], axis=None))(daily(s, d).todense()))
query("reshape_open", f"WITH {GRID} SELECT r AS i0, CAST(c // 31 AS BIGINT) AS i1, c % 31 AS i2, {_val('v')} FROM g")(lambda s, d: xp.reshape(daily(s, d).todense(), (-1, 5, 31)))
query("nextafter_pair", f"SELECT i AS i0, v < w AS val FROM ({_V}) WHERE v <> w")(lambda s, d: _stepped(s, d))
query("cumulative_sum_cube", f"WITH {GRID} SELECT r AS i0, CAST(c // 31 AS BIGINT) AS i1, c % 31 AS i2, {_val('sum(v) OVER (PARTITION BY r, c % 31 ORDER BY c)')} FROM g")(lambda s, d: xp.cumulative_sum(xp.reshape(daily(s, d).todense(), (-1, 5, 31)), axis=1))
query("cumulative_sum_coond", f"WITH {GRID} SELECT r AS row, c AS col, {_val('sum(v) OVER (PARTITION BY r ORDER BY c)')} FROM g")(lambda s, d: xp.cumulative_sum(daily(s, d, "coond"), axis=1))
query("diff_cube", f"WITH {GRID}, w AS (SELECT r, c, lead(v) OVER (PARTITION BY r, c // 31 ORDER BY c) - v AS v FROM g) SELECT r AS i0, CAST(c // 31 AS BIGINT) AS i1, c % 31 AS i2, {_val('v')} FROM w WHERE v IS NOT NULL")(
    lambda s, d: xp.diff(xp.reshape(daily(s, d).todense(), (-1, 5, 31)), axis=2)
)


def _stepped(s, d) -> DenseFrame:
    """Whether the next double from v towards w is above v, where they differ."""
    v, w = scaled(s, d), ninths(s, d)
    return DenseFrame(xp.greater(xp.nextafter(v, w), v).df.join(xp.not_equal(v, w).df.where("val").select("i0"), "i0"), v.shape)


# ---- wide products

_WIDE = f"q AS ({Q_SQL}), y AS (SELECT r, j, sum(v * (p_retailprice + j * p_size)) AS v FROM q JOIN part ON c = p_partkey CROSS JOIN range(128) t(j) GROUP BY ALL)"


def _wide(s, d, columns: int) -> DenseFrame:
    """Parts by columns: price and so many sizes."""
    own = _table(s, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), "p_retailprice", "p_size")
    return dense_table(own.withColumn("v", F.col("p_retailprice") + F.col("j") * F.col("p_size")), (_count(s, d, "part"), columns), ["p_partkey", "j"], "v")


query("spmm_128_columns", f"WITH {_WIDE} SELECT a.i AS row, b.i AS col, {_val('coalesce(v, 0)')} FROM range({ROWS}) a(i) CROSS JOIN range(128) b(i) LEFT JOIN y ON y.r = a.i AND y.j = b.i")(lambda s, d: quantities(s, d) @ _wide(s, d, 128))
query("matmul_batch_of_8", f"WITH {_WIDE} SELECT b.i // 16 AS i0, a.i AS i1, b.i % 16 AS i2, {_val('coalesce(v, 0)')} FROM range({ROWS}) a(i) CROSS JOIN range(128) b(i) LEFT JOIN y ON y.r = a.i AND y.j = b.i")(
    lambda s, d: quantities(s, d, "csc") @ manipulation.permute_axes(manipulation.reshape(_wide(s, d, 128), (-1, 8, 16)), (1, 0, 2))
)

# ---- long lines

query("sort_vector_descending", f"SELECT row_number() OVER (ORDER BY v DESC) - 1 AS i0, {_val('v')} FROM ({_V})")(lambda s, d: xp.sort(scaled(s, d), descending=True))

# ---- rank-deficient iteration, files and tiles


@query("block_power_repeated_rows", f"WITH x AS (SELECT c, sum(v) AS v FROM ({N_SQL}) WHERE r = c GROUP BY c), k AS (SELECT sqrt(sum(v * v)) AS n FROM x) SELECT CAST(i AS BIGINT) AS i0, {_val('CASE WHEN i = 0 THEN n * n / 1e6 ELSE 0 END')} FROM range(2) t(i), k")
def _rank_one(s, d):
    """The matrix of products of one vector with itself, all of whose rows are multiples of one."""
    diagonal = nations(s, d).df.where("row = col").select(F.col("row").alias("i0"), "val")
    line = reductions.sum(SparseFrame(diagonal.withColumn("i1", F.lit(0).cast("long")).select("i0", "i1", "val"), (25, 1), "coond"), 1).todense()
    outer = xp.multiply(xp.expand_dims(line, 1), xp.expand_dims(line, 0))
    start = creation.full(s, (25, 2), 1.0)
    start = DenseFrame(start.df.withColumn("val", F.lit(1.0) + F.col("row") * F.col("col")), start.shape)
    values = algorithms.block_power(SparseFrame(outer.df, (25, 25), "csr", coalesced=True), start, 6)[1]
    return s.createDataFrame([(k, float(v) / 1e6) for k, v in enumerate(values)], "i0 long, val double")


@query("matrix_market", f"SELECT r AS row, c AS col, {_val('v')} FROM ({Q_SQL})")
def _files(s, d):
    """Quantities, written as MatrixMarket files and read back by byte ranges."""
    folder = shared_folder(s, "matrix")
    matrix_market.write(quantities(s, d), folder)
    return matrix_market.read(s, folder, split_bytes=100_000)


@query("tiles", f"WITH {GRID} SELECT CAST(r // 64 AS BIGINT) AS tile, count(*) AS cells, {_val('sum(v * (c + 1)) / 1e6').replace(' AS val', ' AS total')} FROM g GROUP BY 1")
def _tiles(s, d):
    """The matrix in tiles of 64 rows: their cells, and a sum over them that depends on their places."""
    own, rows = tiles.tiled(daily(s, d), 64 * DAYS)

    @F.pandas_udf("double")
    def total(cells):
        return cells.map(lambda x: float((np.frombuffer(x, "<f8").reshape(-1, DAYS) * np.arange(1, DAYS + 1)).sum()) / 1e6)

    return own.select("tile", (F.length("cells") / 8).cast("long").alias("cells"), total("cells").alias("total"))
