"""The operators as queries over the data folder's tables, and the SQL that checks them.

The matrices are built from whole tables: suppliers by parts (quantities, discounts, line counts), user by
event type by day (values), and customer nation by supplier nation (quantities, every cell stored).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.frame import DenseFrame, SparseFrame, StretchedFrame, dense, dense_table
from gridweave.functions import expr
from gridweave.operators import elementwise, linalg, manipulation, reductions, searching
from gridweave.plans import algorithms
from gridweave.sources import creation
from gridweave.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 4
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spark, sf_dir, name: str) -> int:
    return _table(spark, sf_dir, name).count()


# ---- tensors from the tables

def _triples(spark, sf_dir, value, fmt="coo", where=None) -> SparseFrame:
    """Suppliers by parts, one entry for each line: cells repeat."""
    lines = _table(spark, sf_dir, "lineitem")
    lines = lines.where(where) if where is not None else lines
    shape = (_count(spark, sf_dir, "supplier"), _count(spark, sf_dir, "part"))
    return SparseFrame.from_triples(lines.withColumn("_v", value), shape, ["l_suppkey", "l_partkey"], "_v", fmt)


def quantities(spark, sf_dir, fmt="csr") -> SparseFrame:
    return _triples(spark, sf_dir, F.col("l_quantity"), fmt).coalesce()


def counts(spark, sf_dir, fmt="csr") -> SparseFrame:
    """Lines with a discount: shares some cells with quantities."""
    return _triples(spark, sf_dir, F.lit(1.0), fmt, F.col("l_discount") != 0).coalesce()


def raw_discounts(spark, sf_dir, fmt="coo") -> SparseFrame:
    return _triples(spark, sf_dir, F.col("l_discount"), fmt)


def signed(spark, sf_dir, fmt="csr") -> SparseFrame:
    """Account balances of customers on a diagonal: positive and negative."""
    own = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_custkey").alias("col"), F.col("c_acctbal").alias("val"))
    n = _count(spark, sf_dir, "customer")
    return SparseFrame(own, (n, n), fmt, coalesced=True)


def nations(spark, sf_dir, fmt="csr") -> SparseFrame:
    """Customer nations by supplier nations: quantities sold."""
    joined = (
        _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return SparseFrame.from_triples(joined, (25, 25), ["c_nationkey", "s_nationkey"], "l_quantity", fmt).coalesce()


def events(spark, sf_dir) -> SparseFrame:
    """Users by event types by days: values, cells repeat."""
    users = (_table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] or 0) + 1
    return SparseFrame.from_triples(entries(spark, sf_dir), (users, len(EVENT_TYPES), 31), ["i0", "i1", "i2"], "value", "coond")


def entries(spark, sf_dir) -> DataFrame:
    """The events' users, types, days and values, with their ids, in whose order the table lists them."""
    kind = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("i0"), kind.alias("i1"), (F.dayofmonth("ts") - 1).alias("i2"), "value", "event_id")


def prices(spark, sf_dir) -> DenseFrame:
    return dense_table(_table(spark, sf_dir, "part"), (_count(spark, sf_dir, "part"),), ["p_partkey"], "p_retailprice")


def balances(spark, sf_dir) -> DenseFrame:
    return dense_table(_table(spark, sf_dir, "supplier"), (_count(spark, sf_dir, "supplier"),), ["s_suppkey"], "s_acctbal")


def part_features(spark, sf_dir) -> DenseFrame:
    """Parts by (price, size)."""
    own = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array("p_retailprice", F.col("p_size").cast("double"))).alias("c", "v"))
    return dense_table(own, (_count(spark, sf_dir, "part"), 2), ["p_partkey", "c"], "v")


Q_SQL = "SELECT l_suppkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
C_SQL = "SELECT l_suppkey AS r, l_partkey AS c, CAST(count(*) AS DOUBLE) AS v FROM lineitem WHERE l_discount <> 0 GROUP BY ALL"
D_SQL = "SELECT l_suppkey AS r, l_partkey AS c, l_discount AS v FROM lineitem"
S_SQL = "SELECT c_custkey AS r, c_custkey AS c, c_acctbal AS v FROM customer"
N_SQL = (
    "SELECT CAST(c_nationkey AS BIGINT) AS r, CAST(s_nationkey AS BIGINT) AS c, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"
)
E_SQL = (
    "SELECT user_id AS a, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS BIGINT) AS b, "
    "CAST(day(ts) - 1 AS BIGINT) AS d, value AS v FROM events"
)
ROWS = "(SELECT count(*) FROM supplier)"
COLS = "(SELECT count(*) FROM part)"
N_GRID = "n AS (" + N_SQL + "), g AS (SELECT a.i AS r, b.i AS c, coalesce(v, 0) AS v FROM range(25) a(i) CROSS JOIN range(25) b(i) LEFT JOIN n ON n.r = a.i AND n.c = b.i)"


def query(name: str, sql: str | None):
    """Registers a query; what it returns is rounded and its coordinates named row, col or i0, i1 and so on."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            if isinstance(out, StretchedFrame):  # each cell is rounded once, not wherever it is repeated
                return StretchedFrame(DenseFrame(rounded(out.base.df), out.base.shape), out.shape).df
            return rounded(out.df if isinstance(out, (SparseFrame, DenseFrame)) else out)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(expr.rounded(F.col(c), DIGITS) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _val(sql: str) -> str:
    return f"round({sql}, {DIGITS}) + 0.0 AS val"


FLOOR = "floor(a.v / b.v)"

# ---- products

for _fmt in ("csr", "csc", "coo"):
    query(f"spmv_{_fmt}", f"WITH q AS ({Q_SQL}), y AS (SELECT r, sum(v * p_retailprice) AS v FROM q JOIN part ON c = p_partkey GROUP BY r) SELECT i AS i0, {_val('coalesce(v, 0)')} FROM range({ROWS}) t(i) LEFT JOIN y ON r = i")(
        lambda s, d, fmt=_fmt: (_triples(s, d, F.col("l_quantity"), "coo") if fmt == "coo" else quantities(s, d, fmt)) @ prices(s, d)
    )

_SPMM = f"q AS ({Q_SQL}), f AS (SELECT p_partkey AS k, 0 AS c, p_retailprice AS w FROM part UNION ALL SELECT p_partkey, 1, p_size FROM part), y AS (SELECT q.r, f.c, sum(v * w) AS v FROM q JOIN f ON q.c = k GROUP BY ALL)"
_FULL = f"SELECT a.i AS row, CAST(b.i AS BIGINT) AS col, {_val('coalesce(v, 0)')} FROM range({ROWS}) a(i) CROSS JOIN range(2) b(i) LEFT JOIN y ON y.r = a.i AND y.c = b.i"
query("spmm_dense", f"WITH {_SPMM} {_FULL}")(lambda s, d: quantities(s, d) @ part_features(s, d))


@query("matmul_batched", f"WITH {_SPMM} SELECT CAST(k.i AS BIGINT) AS i0, a.i AS i1, CAST(b.i AS BIGINT) AS i2, {_val('coalesce(v, 0) * (k.i + 1)')} FROM range(2) k(i) CROSS JOIN range({ROWS}) a(i) CROSS JOIN range(2) b(i) LEFT JOIN y ON y.r = a.i AND y.c = b.i")
def _batched(s, d):
    one = part_features(s, d)
    both = [DenseFrame(one.df.withColumn("val", F.col("val") * k), one.shape) for k in (1, 2)]
    return quantities(s, d) @ manipulation.stack(both)


query("vecdot_axis0", f"WITH q AS ({Q_SQL}), y AS (SELECT c, sum(v * s_acctbal) AS v FROM q JOIN supplier ON r = s_suppkey GROUP BY c) SELECT i AS i0, {_val('coalesce(v, 0)')} FROM range({COLS}) t(i) LEFT JOIN y ON c = i")(lambda s, d: linalg.vecdot(quantities(s, d), balances(s, d), 0))
query("vecdot_axis1", ORACLE_SQL["spmv_csr"])(lambda s, d: linalg.vecdot(quantities(s, d, "csc"), prices(s, d), 1))
query("tensordot_matrix", f"WITH {_SPMM} {_FULL}")(lambda s, d: linalg.tensordot(quantities(s, d), part_features(s, d), 1))
query("tensordot_nd", f"WITH e AS ({E_SQL}), w AS (SELECT i AS b, j AS k, CAST((i + 1) * (j + 1) AS DOUBLE) AS w FROM range(5) x(i) CROSS JOIN range(2) y(j)), y AS (SELECT a, d, k, sum(v * w) AS v FROM e JOIN w USING (b) WHERE v <> 0 GROUP BY ALL) SELECT a AS i0, d AS i1, k AS i2, {_val('v')} FROM y WHERE v <> 0")(
    lambda s, d: linalg.tensordot(events(s, d), dense(s, [[(i + 1.0) * (j + 1) for j in range(2)] for i in range(5)]), ([1], [0]))
)
query("vecdot_nd", f"WITH e AS ({E_SQL}) SELECT a AS i0, d AS i1, {_val('sum(v * (b + 1))')} FROM e WHERE v <> 0 GROUP BY ALL")(lambda s, d: linalg.vecdot(events(s, d), dense(s, [1.0, 2.0, 3.0, 4.0, 5.0]), 1))
query("transpose", f"WITH q AS ({Q_SQL}) SELECT c AS row, r AS col, {_val('v')} FROM q")(lambda s, d: quantities(s, d).T)

# ---- pairs

for _name, _sign, _how in (("add", "+", "v"), ("subtract", "-", "-v")):
    query(_name, f"SELECT r AS row, c AS col, {_val('sum(v)')} FROM (({Q_SQL}) UNION ALL (SELECT r, c, {_how} FROM ({C_SQL}))) GROUP BY ALL HAVING sum(v) <> 0")(lambda s, d, name=_name: elementwise.pairwise(name, quantities(s, d), counts(s, d)))
for _name, _value in (("hadamard", "a.v * b.v"), ("divide", "a.v / b.v"), ("floor_divide", FLOOR), ("remainder", f"a.v - b.v * {FLOOR}"), ("pow", "pow(a.v, b.v)")):
    query(_name, f"WITH a AS ({Q_SQL}), b AS ({C_SQL}), y AS (SELECT r, c, {_value} AS v FROM a JOIN b USING (r, c)) SELECT r AS row, c AS col, {_val('v')} FROM y WHERE v <> 0")(
        lambda s, d, name={"hadamard": "multiply"}.get(_name, _name): elementwise.pairwise(name, quantities(s, d, "csc"), counts(s, d, "csc"))
    )
for _name, _op, _empty in (("maximum", "greatest", 0), ("minimum", "least", 0)):
    query(_name, f"WITH a AS ({Q_SQL}), b AS ({C_SQL}), y AS (SELECT r, c, {_op}(coalesce(a.v, 0), coalesce(b.v, 0)) AS v FROM a FULL JOIN b USING (r, c)) SELECT r AS row, c AS col, {_val('v')} FROM y WHERE v <> 0")(lambda s, d, name=_name: elementwise.union_support(name, quantities(s, d), counts(s, d)))

# ---- numbers and single values

_SIGNED = "floor(v / -3.5)"
for _name, _alpha, _sql in (("multiply", 2.5, "v * 2.5"), ("divide", 4.0, "v * 0.25"), ("floor_divide", -3.5, _SIGNED), ("remainder", -3.5, f"v - (-3.5) * {_SIGNED}"), ("pow", 2.0, "v * v")):
    query(f"scalar_{_name}", f"WITH q AS ({S_SQL}) SELECT r AS row, c AS col, {_val(_sql)} FROM q")(lambda s, d, name=_name, alpha=_alpha: elementwise.scalar(name, signed(s, d), alpha))
for _name, _sql in (("abs", "abs(v)"), ("negative", "-v"), ("sign", "CAST(sign(v) AS DOUBLE)"), ("sqrt_abs", "sqrt(abs(v))"), ("floor", "floor(v)"), ("ceil", "ceil(v)"), ("trunc", "trunc(v)"), ("square", "v * v")):
    _path = ["abs", "sqrt"] if _name == "sqrt_abs" else [_name]
    query(_name, f"WITH q AS ({S_SQL}) SELECT r AS row, c AS col, {_val(_sql)} FROM q")(lambda s, d, path=_path: [x := signed(s, d), *[x := elementwise.unary(p, x) for p in path]][-1])
for _name, _sql in (("expm1", "exp(v) - 1"), ("log1p", "ln(1 + v)"), ("sin", "sin(v)"), ("tanh", "tanh(v)"), ("asinh", "asinh(v)"), ("atan", "atan(v)")):
    query(_name, f"SELECT r AS row, c AS col, {_val(_sql)} FROM ({D_SQL}) q")(lambda s, d, name=_name: elementwise.unary(name, raw_discounts(s, d)))
query("prune", f"SELECT r AS row, c AS col, {_val('v')} FROM ({D_SQL}) q WHERE abs(v) > 0.045")(lambda s, d: manipulation.prune(raw_discounts(s, d), 0.045))
query("eliminate_zeros", f"SELECT r AS row, c AS col, {_val('v')} FROM ({D_SQL}) q WHERE v <> 0")(lambda s, d: manipulation.eliminate_zeros(raw_discounts(s, d)))

# ---- reductions

_NR, _NC = f"({COLS})", f"({ROWS})"


def _axis_sql(source: str, kept: str, value: str, default: str, cells: str, size: str, cast: str = "") -> str:
    """A reduction for every line: value over (s, q, n, lo, hi) of its stored cells, default without any."""
    own = f"SELECT {kept} AS k, sum(v) AS s, sum(v * v) AS q, count(*) AS n, min(v) AS lo, max(v) AS hi, product(v) AS p, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS t FROM x GROUP BY {kept}"
    picked = f"CASE WHEN k IS NULL THEN {default} ELSE {value} END"
    out = f"{picked} AS val" if cast else _val(picked)
    return f"WITH x AS ({source}), z AS (SELECT CAST({cells} AS DOUBLE) AS m), y AS ({own}) SELECT i AS i0, {out} FROM range({size}) t(i) CROSS JOIN z LEFT JOIN y ON k = i"


VALUES = {
    "sum": ("s", "0"),
    "mean": ("s / m", "0"),
    "var": ("greatest(0, (q - s * s / m) / m)", "0"),
    "std": ("sqrt(greatest(0, (q - s * s / m) / m))", "0"),
    "min": ("CASE WHEN n < m THEN least(lo, 0) ELSE lo END", "0"),
    "max": ("CASE WHEN n < m THEN greatest(hi, 0) ELSE hi END", "0"),
    "prod": ("CASE WHEN n < m THEN 0 ELSE p END", "0"),
    "all": ("t >= m", "false"),
    "any": ("t > 0", "false"),
    "count_nonzero": ("n", "0"),
}
for _name, (_value, _default) in VALUES.items():
    _kind = "cast" if _name in ("all", "any", "count_nonzero") else ""
    for _axis, _kept, _cells, _size in ((0, "c", ROWS, COLS), (1, "r", COLS, ROWS)):
        query(f"{_name}_axis{_axis}", _axis_sql(Q_SQL, _kept, _value, _default, _cells, _size, _kind))(lambda s, d, name=_name, axis=_axis: reductions.reduce(name, quantities(s, d), axis))
    _all = f"SELECT count(*) AS n, sum(v) AS s, sum(v * v) AS q, min(v) AS lo, max(v) AS hi, product(v) AS p, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS t FROM x"
    query(f"{_name}_all", f"WITH x AS ({N_SQL if _name not in ('prod',) else Q_SQL}), z AS (SELECT {'625.0' if _name != 'prod' else f'CAST({ROWS} * {COLS} AS DOUBLE)'} AS m), y AS ({_all}) SELECT {(_value + ' AS val') if _kind else _val(_value)} FROM y, z")(
        lambda s, d, name=_name: reductions.reduce(name, nations(s, d) if name != "prod" else quantities(s, d))
    )
query("var_sample", _axis_sql(Q_SQL, "r", "greatest(0, (q - s * s / m) / (m - 1))", "0", COLS, ROWS))(lambda s, d: reductions.reduce("var", quantities(s, d), 1, correction=1.0))
query("sum_coo_repeats", _axis_sql(D_SQL, "r", "s", "0", COLS, ROWS))(lambda s, d: reductions.sum(raw_discounts(s, d), 1))
query("var_coo_repeats", _axis_sql(D_SQL, "r", VALUES["var"][0], "0", COLS, ROWS))(lambda s, d: reductions.reduce("var", raw_discounts(s, d), 1))
query("sum_keepdims", f"WITH y AS (SELECT l_partkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT CAST(0 AS BIGINT) AS row, i AS col, {_val('coalesce(v, 0)')} FROM range({COLS}) t(i) LEFT JOIN y ON c = i")(lambda s, d: reductions.sum(quantities(s, d), 0, keepdims=True))
query("cumulative_sum_axis0", f"WITH {N_GRID} SELECT r AS row, c AS col, {_val('sum(v) OVER (PARTITION BY c ORDER BY r)')} FROM g")(lambda s, d: reductions.cumulative_sum(nations(s, d), 0))
query("cumulative_sum_axis1", f"WITH {N_GRID} SELECT r AS row, c AS col, {_val('sum(v) OVER (PARTITION BY r ORDER BY c)')} FROM g")(lambda s, d: reductions.cumulative_sum(nations(s, d), 1))


def _near_one(s, d) -> SparseFrame:
    return elementwise.scalar("divide", nations(s, d), 1024.0)


for _axis, _line, _at in ((0, "c", "r"), (1, "r", "c")):
    query(f"cumulative_prod_axis{_axis}", f"WITH {N_GRID}, h AS (SELECT r, c, log(2, 1 + abs(product(v / 1024) OVER (PARTITION BY {_line} ORDER BY {_at}))) AS v FROM g) SELECT r AS row, c AS col, {_val('v')} FROM h")(
        lambda s, d, axis=_axis: (lambda x: DenseFrame(x.df.withColumn("val", F.log2(1 + F.abs("val"))), x.shape))(reductions.cumulative_prod(_near_one(s, d), axis))
    )
for _n, _sql in ((1, "lead(v, 1) OVER w - v"), (2, "lead(v, 2) OVER w - 2 * lead(v, 1) OVER w + v")):
    for _axis, _line, _at in ((0, "c", "r"), (1, "r", "c")):
        query(f"diff_n{_n}_axis{_axis}", f"WITH {N_GRID}, y AS (SELECT r, c, {_sql} AS v FROM g WINDOW w AS (PARTITION BY {_line} ORDER BY {_at})) SELECT r AS row, c AS col, {_val('v')} FROM y WHERE {_at} < 25 - {_n} AND v <> 0")(
            lambda s, d, n=_n, axis=_axis: reductions.diff(nations(s, d), n, axis)
        )

# ---- more dimensions

query("coond_sum_axes", f"SELECT b AS i0, {_val('sum(v)')} FROM ({E_SQL}) GROUP BY b")(lambda s, d: reductions.reduce_sum_axes(events(s, d), (0, 2)))
query("coond_mean_axes", f"WITH e AS ({E_SQL}) SELECT a AS i0, {_val('sum(v) / 155')} FROM e GROUP BY a")(lambda s, d: reductions.reduce_mean_axes(events(s, d), (1, 2)))
query("coond_sum", f"SELECT {_val('sum(v)')} FROM ({E_SQL})")(lambda s, d: reductions.sum(events(s, d)))
query("coond_mean", f"WITH e AS ({E_SQL}) SELECT round(sum(v) / ((max(a) + 1) * 155), {DIGITS}) + 0.0 AS val FROM e")(lambda s, d: reductions.mean(events(s, d)))
query("coond_var", f"WITH e AS ({E_SQL}), x AS (SELECT sum(v) AS s, sum(v * v) AS q, CAST((max(a) + 1) * 155 AS DOUBLE) AS m FROM e) SELECT {_val('(q - s * s / m) / m')} FROM x")(lambda s, d: reductions.reduce("var", events(s, d)))
query("coond_keepdims", f"SELECT CAST(0 AS BIGINT) AS i0, b AS i1, CAST(0 AS BIGINT) AS i2, {_val('sum(v)')} FROM ({E_SQL}) GROUP BY b")(lambda s, d: reductions.sum(events(s, d), (0, 2), keepdims=True))
query("coond_permute", f"SELECT d AS i0, a AS i1, b AS i2, {_val('v')} FROM ({E_SQL})")(lambda s, d: manipulation.permute_axes(events(s, d), (2, 0, 1)))
query("coond_reshape", f"SELECT a * 5 + b AS i0, d AS i1, {_val('v')} FROM ({E_SQL})")(lambda s, d: (lambda x: manipulation.reshape(x, (x.shape[0] * 5, 31)))(events(s, d)))
query("unfold_csr", f"SELECT b AS row, a * 31 + d AS col, {_val('sum(v)')} FROM ({E_SQL}) GROUP BY ALL")(lambda s, d: manipulation.mode_unfold_to_csr(events(s, d), 1))
query("unfold_csc", f"SELECT d AS row, a * 5 + b AS col, {_val('sum(v)')} FROM ({E_SQL}) GROUP BY ALL")(lambda s, d: manipulation.mode_unfold_to_csc(events(s, d), 2))
query("unfold_axes", f"SELECT d * 5 + b AS row, a AS col, {_val('sum(v)')} FROM ({E_SQL}) GROUP BY ALL")(lambda s, d: manipulation.axes_unfold_to_csr(events(s, d), (2, 1)))


def _weights(s, d) -> SparseFrame:
    return creation.from_coond(s, (1, 5, 1), [[0, k, 0] for k in (0, 2, 3)], [1.0, 3.0, 0.0])


query("coond_hadamard_broadcast", f"SELECT a AS i0, b AS i1, d AS i2, {_val('sum(v) * CASE b WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 0 END')} FROM ({E_SQL}) WHERE b IN (0, 2, 3) GROUP BY a, b, d")(lambda s, d: elementwise.hadamard_broadcast(events(s, d), _weights(s, d)))
query("coond_hadamard", f"SELECT a AS i0, b AS i1, d AS i2, {_val('sum(v) * sum(v)')} FROM ({E_SQL}) GROUP BY a, b, d HAVING sum(v) <> 0")(lambda s, d: elementwise.pairwise("multiply", events(s, d), events(s, d)))
query("coond_add", f"SELECT a AS i0, b AS i1, d AS i2, {_val('3 * sum(v)')} FROM ({E_SQL}) GROUP BY a, b, d HAVING sum(v) <> 0")(lambda s, d: elementwise.pairwise("add", events(s, d), elementwise.scalar("multiply", events(s, d), 2.0)))
query("coond_subtract", f"SELECT a AS i0, b AS i1, d AS i2, {_val('-sum(v)')} FROM ({E_SQL}) GROUP BY a, b, d HAVING sum(v) <> 0")(lambda s, d: elementwise.pairwise("subtract", events(s, d), elementwise.scalar("multiply", events(s, d), 2.0)))

# ---- formats and parts

_PTR = "WITH q AS (SELECT DISTINCT l_suppkey AS r, l_partkey AS c FROM lineitem), n AS (SELECT i AS line, (SELECT count(*) FROM q WHERE {at} < i) AS ptr FROM range({size} + 1) t(i)) SELECT line, ptr FROM n"
query("coo_to_csr", _PTR.format(at="r", size=ROWS))(lambda s, d: manipulation.row_pointers(manipulation.to_csr(_triples(s, d, F.col("l_quantity")))))
query("csr_to_csc", _PTR.format(at="c", size=COLS).replace("(SELECT count(*) FROM q WHERE c < i)", "coalesce((SELECT sum(k) FROM (SELECT c, count(*) AS k FROM q GROUP BY c) x WHERE c < i), 0)").replace("AS ptr FROM range", "::BIGINT AS ptr FROM range"))(lambda s, d: manipulation.row_pointers(manipulation.to_csc(quantities(s, d))))
query("coo_coalesce", f"SELECT r AS row, c AS col, {_val('sum(v)')} FROM ({D_SQL}) GROUP BY ALL")(lambda s, d: manipulation.to_csc(raw_discounts(s, d)))
query("nnz", "SELECT count(*) AS val FROM lineitem")(lambda s, d: s.createDataFrame([(raw_discounts(s, d).nnz,)], "val long"))
query("index_scalar", f"SELECT {_val('coalesce(sum(l_quantity), 0)')} FROM lineitem WHERE l_suppkey = 3 AND l_partkey = 5")(lambda s, d: s.createDataFrame([(float(quantities(s, d)[3, 5]),)], "val double"))
query("index_row", f"WITH y AS (SELECT l_partkey AS c, sum(l_quantity) AS v FROM lineitem WHERE l_suppkey = 3 GROUP BY 1) SELECT i AS i0, {_val('coalesce(v, 0)')} FROM range({COLS}) t(i) LEFT JOIN y ON c = i")(lambda s, d: quantities(s, d)[3, :])
query("index_col", f"WITH y AS (SELECT l_suppkey AS r, sum(l_quantity) AS v FROM lineitem WHERE l_partkey = 5 GROUP BY 1) SELECT i AS i0, {_val('coalesce(v, 0)')} FROM range({ROWS}) t(i) LEFT JOIN y ON r = i")(lambda s, d: quantities(s, d)[:, 5])

# ---- comparisons

for _name, _op in (("equal", "="), ("not_equal", "<>"), ("less", "<"), ("less_equal", "<="), ("greater", ">"), ("greater_equal", ">=")):
    query(f"{_name}_scalar", f"WITH {N_GRID} SELECT r AS row, c AS col, v {_op} 2000 AS val FROM g")(lambda s, d, name=_name: elementwise.compare(name, nations(s, d), 2000.0))
    query(f"{_name}_pair", f"WITH {N_GRID} SELECT x.r AS row, x.c AS col, x.v {_op} y.v AS val FROM g x JOIN g y ON x.r = y.c AND x.c = y.r")(lambda s, d, name=_name: elementwise.compare(name, nations(s, d), nations(s, d).T))

# ---- creation

query("zeros", "SELECT CAST(0 AS BIGINT) AS row, CAST(0 AS BIGINT) AS col, CAST(0 AS DOUBLE) AS val WHERE false")(lambda s, d: creation.zeros(s, (5, 7)))
query("eye", "SELECT i AS row, i AS col, CAST(1 AS DOUBLE) AS val FROM range(9) t(i)")(lambda s, d: creation.eye(s, 9))
query("diag", f"SELECT s_suppkey AS row, s_suppkey AS col, {_val('s_acctbal')} FROM supplier")(lambda s, d: creation.diag(s, balances(s, d)))
query("ones", "SELECT a.i AS row, b.i AS col, CAST(1 AS DOUBLE) AS val FROM range(4) a(i) CROSS JOIN range(3) b(i)")(lambda s, d: creation.ones(s, (4, 3)))
query("arange", "SELECT i AS i0, CAST(2 + i * 3 AS DOUBLE) AS val FROM range(6) t(i)")(lambda s, d: creation.arange(s, 2, 20, 3))
query("linspace", f"SELECT i AS i0, {_val('i / 8.0')} FROM range(9) t(i)")(lambda s, d: creation.linspace(s, 0.0, 1.0, 9))
query("tril", f"SELECT r AS row, c AS col, {_val('v')} FROM ({N_SQL}) WHERE c - r <= 0")(lambda s, d: manipulation.tril(nations(s, d)))
query("triu", f"SELECT r AS row, c AS col, {_val('v')} FROM ({N_SQL}) WHERE c - r >= 1")(lambda s, d: manipulation.triu(nations(s, d), 1))

# ---- shapes

query("concat", f"SELECT r AS row, c AS col, {_val('v')} FROM ({N_SQL}) UNION ALL SELECT r + 25, c, {_val('v')} FROM ({N_SQL})")(lambda s, d: manipulation.concat([nations(s, d), nations(s, d)], 0))
query("stack", f"SELECT CAST(0 AS BIGINT) AS i0, r AS i1, c AS i2, {_val('v')} FROM ({N_SQL}) UNION ALL SELECT 1, r, c, {_val('v')} FROM ({N_SQL})")(lambda s, d: manipulation.stack([nations(s, d), nations(s, d)]))
query("flip", f"SELECT r AS row, 24 - c AS col, {_val('v')} FROM ({N_SQL})")(lambda s, d: manipulation.flip(nations(s, d), 1))
query("roll", f"SELECT (r + 3) % 25 AS row, c AS col, {_val('v')} FROM ({N_SQL})")(lambda s, d: manipulation.roll(nations(s, d), 3, 0))
query("repeat", f"SELECT r * 2 + i AS row, c AS col, {_val('v')} FROM ({N_SQL}) CROSS JOIN range(2) t(i)")(lambda s, d: manipulation.repeat(nations(s, d), 2, 0))
query("tile", f"SELECT r AS row, c + 25 * i AS col, {_val('v')} FROM ({N_SQL}) CROSS JOIN range(3) t(i)")(lambda s, d: manipulation.tile(nations(s, d), (1, 3)))
query("expand_dims", f"SELECT r AS i0, CAST(0 AS BIGINT) AS i1, c AS i2, {_val('v')} FROM ({N_SQL})")(lambda s, d: manipulation.expand_dims(nations(s, d), 1))
query("broadcast_to", f"SELECT i AS row, s_suppkey AS col, {_val('s_acctbal')} FROM supplier CROSS JOIN range(3) t(i)")(lambda s, d: (lambda x: manipulation.broadcast_to(x, (3, x.shape[0])))(balances(s, d)))
query("take", f"SELECT CASE WHEN r = 4 THEN 0 ELSE 1 END::BIGINT AS row, c AS col, {_val('v')} FROM ({N_SQL}) WHERE r IN (4, 2)")(lambda s, d: manipulation.take(nations(s, d), [4, 2], 0))

# ---- searching, sorting, sets

_DENSE = f"WITH {N_GRID}"
query("argmax", f"{_DENSE} SELECT r AS i0, arg_max(c, (v, -c)) AS val FROM g GROUP BY r")(lambda s, d: searching.arg_extreme("argmax", nations(s, d).todense(), 1))
query("argmin", f"{_DENSE} SELECT c AS i0, arg_min(r, (v, r)) AS val FROM g GROUP BY c")(lambda s, d: searching.arg_extreme("argmin", nations(s, d).todense(), 0))
query("nonzero", f"SELECT r AS row, c AS col FROM ({D_SQL}) GROUP BY ALL HAVING sum(v) <> 0")(lambda s, d: searching.nonzero(raw_discounts(s, d)))
query("where", f"{_DENSE} SELECT r AS row, c AS col, {_val('CASE WHEN v > 2000 THEN v ELSE -v END')} FROM g")(lambda s, d: (lambda x: searching.where(elementwise.compare("greater", x, 2000.0), x, elementwise.unary("negative", x)))(nations(s, d).todense()))
query("searchsorted", "SELECT s_suppkey AS i0, (SELECT count(*) FROM range(200) t(i) WHERE i * 50.0 < s_acctbal) AS val FROM supplier")(lambda s, d: searching.searchsorted(creation.linspace(s, 0.0, 9950.0, 200), balances(s, d)))
query("unique_counts", "SELECT CAST(p_size AS DOUBLE) AS val, count(*) AS count FROM part GROUP BY 1")(lambda s, d: searching.unique_counts(_sizes(s, d)))
query("unique_values", "SELECT DISTINCT CAST(p_size AS DOUBLE) AS val FROM part")(lambda s, d: searching.unique_values(_sizes(s, d)))
query("unique_inverse", "SELECT p_partkey AS i0, CAST(p_size AS DOUBLE) AS val, dense_rank() OVER (ORDER BY p_size) - 1 AS inverse FROM part")(lambda s, d: searching.unique_inverse(_sizes(s, d)))
query("unique_all", "SELECT CAST(p_size AS DOUBLE) AS val, count(*) AS count, min(p_partkey) AS index FROM part GROUP BY 1")(lambda s, d: searching.unique_all(_sizes(s, d)))
query("sort", f"{_DENSE} SELECT r AS row, row_number() OVER (PARTITION BY r ORDER BY v, c) - 1 AS col, {_val('v')} FROM g")(lambda s, d: searching.sort(nations(s, d).todense(), 1))
query("argsort", f"{_DENSE} SELECT r AS row, row_number() OVER (PARTITION BY r ORDER BY v, c) - 1 AS col, c AS val FROM g")(lambda s, d: searching.argsort(nations(s, d).todense(), 1))


def _sizes(s, d) -> DenseFrame:
    return dense_table(_table(s, d, "part"), (_count(s, d, "part"),), ["p_partkey"], "p_size")


# ---- iterations and streams

def _unrolled(first: str, rounds: int, step: str, last: str, names: str) -> str:
    """SQL of a fixed number of rounds: `step` makes table x{k} from x{k-1}, written {before}."""
    parts = [names, f"x0 AS MATERIALIZED ({first})"]
    parts += [f"x{k} AS MATERIALIZED ({step.format(before=f'x{k - 1}')})" for k in range(1, rounds + 1)]
    return "WITH " + ", ".join(parts) + " " + last.format(before=f"x{rounds}")


_TOTALS = "n AS MATERIALIZED (" + N_SQL + "), t AS (SELECT r, sum(v) AS s FROM n GROUP BY r)"
_STOCHASTIC = _TOTALS + (
    ", p AS MATERIALIZED (SELECT n.r, n.c, v / s AS v FROM n JOIN t ON n.r = t.r WHERE s <> 0"
    " UNION ALL SELECT i, i, 1.0 FROM range(25) z(i) WHERE i NOT IN (SELECT r FROM t WHERE s <> 0))"
)
_RANK_STEP = (
    "SELECT i, k, s, v / sum(v) OVER (PARTITION BY k) AS v FROM (SELECT z.i, z.k, z.s, 0.85 * coalesce(sum(p.v * b.v), 0) + 0.15 * z.s AS v"
    " FROM {before} z LEFT JOIN p ON p.c = z.i LEFT JOIN {before} b ON b.i = p.r AND b.k = z.k GROUP BY z.i, z.k, z.s)"
)
_STARTS = "SELECT i, k, s, s AS v FROM (SELECT i, k, CASE k WHEN 0 THEN 1.0 / 25 ELSE (i + 1.0) / 325 END AS s FROM range(25) z(i) CROSS JOIN range(2) y(k))"


@query("pagerank_block", _unrolled(_STARTS, 20, _RANK_STEP, f"SELECT i AS row, CAST(k AS BIGINT) AS col, {_val('1e6 * v')} FROM {{before}}", _STOCHASTIC))
def _pagerank(s, d):
    """Ranks in millionths after 20 rounds, of an even start and of one that favours the last nations."""
    p = manipulation.to_csr(algorithms.row_stochastic(nations(s, d)).T)
    starts = dense(s, [[1 / 25, (i + 1) / 325] for i in range(25)])
    ranks = algorithms.block_pagerank(p, starts, 0.85, 0.0, 20)[0]
    return ranks.df.withColumn("val", F.col("val") * 1e6)


_SPD = "n AS MATERIALIZED (" + N_SQL + (
    "), o AS (SELECT r, c, sum(v) AS v FROM (SELECT * FROM n UNION ALL SELECT c, r, v FROM n) WHERE r <> c GROUP BY r, c),"
    " a AS MATERIALIZED (SELECT * FROM o UNION ALL SELECT i, i, coalesce(s, 0) + 0.001 FROM range(25) z(i) LEFT JOIN (SELECT r, sum(abs(v)) AS s FROM o GROUP BY r) ON r = i)"
)
_CG_STEP = (
    "SELECT i, x, r, r + sum(r * r) OVER () / rr * p AS p FROM (SELECT i, x + rr / pap * p AS x, r - rr / pap * ap AS r, p, rr"
    " FROM (SELECT *, sum(r * r) OVER () AS rr, sum(p * ap) OVER () AS pap"
    " FROM (SELECT b.i, b.x, b.r, b.p, sum(a.v * q.p) AS ap FROM {before} b JOIN a ON a.r = b.i JOIN {before} q ON q.i = a.c GROUP BY b.i, b.x, b.r, b.p)))"
)


@query("cg_solve", _unrolled("SELECT i, CAST(0 AS DOUBLE) AS x, 1e6 * (i % 7 + 1) AS r, 1e6 * (i % 7 + 1) AS p FROM range(25) z(i)", 12, _CG_STEP, f"SELECT i AS i0, {_val('x')} FROM {{before}}", _SPD))
def _cg(s, d):
    """The solution of A x = b after at most 12 rounds."""
    b = creation.arange(s, 25)
    b = DenseFrame(b.df.withColumn("val", 1e6 * (F.col("i0") % 7 + 1)), b.shape)
    return algorithms.cg_solve(algorithms.spd(nations(s, d)), b, 1e-13, 12)[0]


_POWER_STEP = (
    "SELECT i, v, w / sqrt(sum(w * w) OVER ()) AS w FROM (SELECT i, v, w - v * sum(v * w) OVER () AS w FROM (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v, w"
    " FROM (SELECT a.r AS i, sum(a.v * b.v) AS v, sum(a.v * b.w) AS w FROM a JOIN {before} b ON b.i = a.c GROUP BY a.r)))"
)
_RITZ = (
    "SELECT CAST(k AS BIGINT) AS i0, round((f + h) / 2 + CASE k WHEN 0 THEN 1 ELSE -1 END * sqrt((f - h) * (f - h) / 4 + g * g), 4) + 0.0 AS val FROM range(2) z(k) CROSS JOIN"
    " (SELECT sum(x.v * a.v * y.v) AS f, sum(x.v * a.v * y.w) AS g, sum(x.w * a.v * y.w) AS h FROM a JOIN {before} x ON x.i = a.r JOIN {before} y ON y.i = a.c)"
)


@query("block_power", _unrolled("SELECT i, CAST(i % 3 + 1 AS DOUBLE) AS v, CAST(i * i % 11 AS DOUBLE) AS w FROM range(25) z(i)", 10, _POWER_STEP, _RITZ, _SPD))
def _power(s, d):
    """The Ritz values after ten rounds of a block of two columns."""
    start = dense(s, [[i % 3 + 1.0, i * i % 11 + 0.0] for i in range(25)])
    values = algorithms.block_power(algorithms.spd(nations(s, d)), start, 10)[1]
    return s.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "i0 long, val double")


query("windowed_sums", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, {_val('sum(value)')}, count(*) AS n FROM events GROUP BY ALL")(
    lambda s, d: incremental.windowed_sums(_table(s, d, "events").withColumnRenamed("value", "val"), "ts", ["user_id"])
)
query("finite", f"WITH {N_GRID} SELECT r AS row, c AS col, true AS val FROM g")(lambda s, d: elementwise.unary("isfinite", nations(s, d).todense()))
query("logical_and", f"WITH {N_GRID} SELECT x.r AS row, x.c AS col, x.v <> 0 AND y.v <> 0 AS val FROM g x JOIN g y ON x.r = y.c AND x.c = y.r")(lambda s, d: elementwise.binary("logical_and", nations(s, d).todense(), nations(s, d).T.todense()))

__all__ = ["ORACLE_SQL", "QUERIES", "expr"]
