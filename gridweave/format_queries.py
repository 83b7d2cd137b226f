"""Every operator again in each format that it accepts, and the functions of the namespace, on tensors with missing cells.

The matrix is users by (event type, day): values less SHIFT, of both signs, a third of the cells stored at small
scale. As coo and coond it has an entry for each event, so cells repeat; as csr and csc they are added up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import xp
from gridweave.frame import DenseFrame, SparseFrame, dense, dense_table
from gridweave.operators import elementwise, linalg, manipulation, reductions, searching
from gridweave.queries import E_SQL, FLOOR, VALUES, _count, _table, _val, balances, entries, events, query

DAYS = 155
SHIFT = 25.0371234


def daily(s, d, fmt: str = "csr") -> SparseFrame:
    own = elementwise_shift(events(s, d))
    cells = own.df.select(F.col("i0").alias("row"), (F.col("i1") * 31 + F.col("i2")).alias("col"), "val")
    out = SparseFrame(cells, (own.shape[0], DAYS), "coo")
    if fmt == "coond":
        return SparseFrame(cells.withColumnsRenamed({"row": "i0", "col": "i1"}), out.shape, "coond")
    if fmt == "coo":
        return out
    listed = entries(s, d).select(F.col("i0").cast("long").alias("row"), (F.col("i1") * 31 + F.col("i2")).cast("long").alias("col"), (F.col("value") - F.lit(SHIFT)).alias("val"), "event_id")
    return manipulation._format(out.like(listed).coalesce("event_id"), fmt)  # ranks tell sums apart by their last digits


def elementwise_shift(a: SparseFrame) -> SparseFrame:
    return a.map_values(lambda v: v - F.lit(SHIFT))


#: Entries as they come, cells added up, and every cell of the matrix.
RAW = f"SELECT a AS r, b * 31 + d AS c, v - {SHIFT} AS v FROM ({E_SQL})"
ADDED = f"SELECT r, c, sum(v) AS v FROM ({RAW}) GROUP BY ALL"
USERS = "(SELECT max(user_id) + 1 FROM events)"
GRID = f"y AS ({ADDED}), g AS (SELECT a.i AS r, b.i AS c, coalesce(v, 0) AS v FROM range({USERS}) a(i) CROSS JOIN range({DAYS}) b(i) LEFT JOIN y ON y.r = a.i AND y.c = b.i)"


def source(fmt: str) -> str:
    return RAW if fmt in ("coo", "coond") else ADDED


def names(fmt: str, cells: str, value: str = "v") -> str:
    """SELECT of a sparse result with columns r, c and v."""
    row, col = ("i0", "i1") if fmt == "coond" else ("row", "col")
    return f"SELECT r AS {row}, c AS {col}, {_val(value)} FROM ({cells})"


# ---- numbers and single values, in each format

_MOD = "floor(v / -3.5)"
SCALARS = {"multiply": (2.5, "v * 2.5"), "divide": (4.0, "v * 0.25"), "floor_divide": (-3.5, _MOD), "remainder": (-3.5, f"v - (-3.5) * {_MOD}"), "pow": (2.0, "v * v")}
for _fmt in ("csr", "csc", "coo", "coond"):
    for _name, (_alpha, _sql) in SCALARS.items():
        query(f"scalar_{_name}_{_fmt}", names(_fmt, source(_fmt), _sql))(lambda s, d, name=_name, alpha=_alpha, fmt=_fmt: elementwise.scalar(name, daily(s, d, fmt), alpha))
    for _name, _sql in (("negative", "-v"), ("abs", "abs(v)"), ("sign", "CAST(sign(v) AS DOUBLE)")):
        query(f"{_name}_{_fmt}", names(_fmt, source(_fmt), _sql))(lambda s, d, name=_name, fmt=_fmt: {"negative": lambda x: -x, "abs": abs, "sign": elementwise.sign}[name](daily(s, d, fmt)))
    query(f"prune_{_fmt}", names(_fmt, source(_fmt)) + " WHERE abs(v) > 7.5")(lambda s, d, fmt=_fmt: daily(s, d, fmt).prune(7.5))
    query(f"eliminate_zeros_{_fmt}", names(_fmt, f"SELECT r, c, CASE WHEN abs(v) < 5 THEN 0 ELSE v END AS v FROM ({source(_fmt)})") + " WHERE v <> 0")(
        lambda s, d, fmt=_fmt: daily(s, d, fmt).map_values(lambda v: F.when(F.abs(v) < 5, 0.0).otherwise(v)).eliminate_zeros()
    )
    query(f"nnz_{_fmt}", f"SELECT count(*) AS val FROM ({source(_fmt)})")(lambda s, d, fmt=_fmt: s.createDataFrame([(daily(s, d, fmt).nnz,)], "val long"))

# ---- reductions, in each format

for _fmt in ("csr", "csc", "coo", "coond"):
    for _name, (_value, _default) in VALUES.items():
        _plain = _name in ("all", "any", "count_nonzero")
        _from = ADDED if _name in ("all", "any") and _fmt == "coo" else source(_fmt)
        _sums = "sum(v) AS s, sum(v * v) AS q, count(*) AS n, min(v) AS lo, max(v) AS hi, product(v) AS p, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS t"
        _out = lambda sql, plain=_plain: f"{sql} AS val" if plain else _val(sql)
        query(f"{_name}_all_{_fmt}", f"WITH x AS ({_from}), z AS (SELECT CAST({USERS} * {DAYS} AS DOUBLE) AS m), y AS (SELECT {_sums} FROM x) SELECT {_out(_value)} FROM y, z")(
            lambda s, d, name=_name, fmt=_fmt: reductions.reduce(name, daily(s, d, fmt))
        )
        if _fmt == "coond" and _name == "count_nonzero":
            continue
        for _axis, _kept, _cells, _size in ((0, "c", USERS, str(DAYS)), (1, "r", str(DAYS), USERS)):
            _own = f"WITH x AS ({_from}), z AS (SELECT CAST({_cells} AS DOUBLE) AS m), y AS (SELECT {_kept} AS k, {_sums} FROM x GROUP BY {_kept})"
            _lines = f"SELECT k AS i0, {_out(_value)} FROM y, z" if _fmt == "coond" else f"SELECT i AS i0, {_out(f'CASE WHEN k IS NULL THEN {_default} ELSE {_value} END')} FROM range({_size}) t(i) CROSS JOIN z LEFT JOIN y ON k = i"
            query(f"{_name}_axis{_axis}_{_fmt}", f"{_own} {_lines}")(lambda s, d, name=_name, axis=_axis, fmt=_fmt: reductions.reduce(name, daily(s, d, fmt), axis))

for _fmt in ("csr", "csc", "coo"):
    for _axis, _line, _at in ((0, "c", "r"), (1, "r", "c")):
        _end = USERS if _axis == 0 else str(DAYS)
        for _n, _sql in ((1, "lead(v, 1) OVER w - v"), (2, "lead(v, 2) OVER w - 2 * lead(v, 1) OVER w + v")):
            query(f"diff_n{_n}_axis{_axis}_{_fmt}", f"WITH {GRID}, z AS (SELECT r, c, {_sql} AS v FROM g WINDOW w AS (PARTITION BY {_line} ORDER BY {_at})) SELECT r AS row, c AS col, {_val('v')} FROM z WHERE {_at} < {_end} - {_n} AND abs(v) > 0.00005")(
                lambda s, d, n=_n, axis=_axis, fmt=_fmt: (lambda x: x.df.where("abs(val) > 0.00005"))(reductions.diff(daily(s, d, fmt), n, axis))
            )
        query(f"cumulative_sum_axis{_axis}_{_fmt}", f"WITH {GRID} SELECT r AS row, c AS col, {_val(f'sum(v) OVER (PARTITION BY {_line} ORDER BY {_at})')} FROM g")(
            lambda s, d, axis=_axis, fmt=_fmt: reductions.cumulative_sum(daily(s, d, fmt), axis)
        )
        query(f"cumulative_prod_axis{_axis}_{_fmt}", f"WITH {GRID}, p AS (SELECT r, c, product(v / 17) OVER (PARTITION BY {_line} ORDER BY {_at}) + 0.0 AS v FROM g) SELECT r AS row, c AS col, {_val('v')} FROM p")(
            lambda s, d, axis=_axis, fmt=_fmt: reductions.cumulative_prod(elementwise.scalar("multiply", daily(s, d, fmt), 1 / 17), axis)
        )

# ---- pairs, in both formats that have them

DOUBLED = f"SELECT c % {USERS} AS r, r % {DAYS} AS c, round(abs(sum(v))) + 1 AS v FROM (SELECT r, c, v FROM ({ADDED}) WHERE v > 0) GROUP BY 1, 2"


def folded(s, d, fmt: str) -> SparseFrame:
    """Whole numbers above zero on other cells: the positive cells, rows and columns exchanged and folded into the shape."""
    own = daily(s, d)
    n, m = own.shape
    cells = own.df.where("val > 0").groupBy((F.col("col") % n).alias("row"), (F.col("row") % m).alias("col")).agg((F.round(F.abs(F.sum("val"))) + 1).alias("val"))
    out = SparseFrame(cells, own.shape, "csr" if fmt == "coond" else fmt, coalesced=True)
    return SparseFrame(cells.withColumnsRenamed({"row": "i0", "col": "i1"}), own.shape, "coond", coalesced=True) if fmt == "coond" else out


PAIRS = {"multiply": "a.v * b.v", "divide": "a.v / b.v", "floor_divide": FLOOR, "remainder": f"a.v - b.v * {FLOOR}", "power": "pow(a.v, b.v)"}
for _fmt in ("csr", "csc", "coond"):
    for _name, _how in (("add", "v"), ("subtract", "-v")):
        query(f"{_name}_{_fmt}", names(_fmt, f"SELECT r, c, sum(v) AS v FROM (({ADDED}) UNION ALL (SELECT r, c, {_how} FROM ({DOUBLED}))) GROUP BY ALL HAVING sum(v) <> 0"))(
            lambda s, d, name=_name, fmt=_fmt: elementwise.pairwise(name, daily(s, d, fmt), folded(s, d, fmt))
        )
    for _name, _value in PAIRS.items():
        if _name == "power":  # log of the size, since powers are large
            _value, _shown = "pow(abs(a.v) / 100, least(b.v, 3))", "v"
            query(f"power_{_fmt}", f"WITH a AS ({ADDED}), b AS ({DOUBLED}), z AS (SELECT a.r, a.c, {_value} AS v FROM a JOIN b ON a.r = b.r AND a.c = b.c) " + names(_fmt, "SELECT * FROM z WHERE v <> 0"))(
                lambda s, d, fmt=_fmt: daily(s, d, fmt).coalesce().map_values(lambda v: F.abs(v) / 100).power(folded(s, d, fmt).map_values(lambda v: F.least(v, F.lit(3.0))))
            )
            continue
        query(f"{_name}_{_fmt}", f"WITH a AS ({ADDED}), b AS ({DOUBLED}), z AS (SELECT a.r, a.c, {_value} AS v FROM a JOIN b ON a.r = b.r AND a.c = b.c) " + names(_fmt, "SELECT * FROM z WHERE v <> 0"))(
            lambda s, d, name=_name, fmt=_fmt: getattr(daily(s, d, fmt), name)(folded(s, d, fmt))
        )
for _name, _op in (("maximum", "greatest"), ("minimum", "least")):
    query(f"{_name}_csc", f"WITH a AS ({ADDED}), b AS ({DOUBLED}), z AS (SELECT r, c, {_op}(coalesce(a.v, 0), coalesce(b.v, 0)) AS v FROM a FULL JOIN b USING (r, c)) " + names("csc", "SELECT * FROM z WHERE v <> 0"))(
        lambda s, d, name=_name: elementwise.union_support(name, daily(s, d, "csc"), folded(s, d, "csc"))
    )

# ---- products, in each format

_W = f"w AS (SELECT i AS c, j AS k, CAST((i % 7 + 1) * (j - 1) + 0.3719 AS DOUBLE) AS w FROM range({DAYS}) x(i) CROSS JOIN range(3) t(j))"


def weights(s, columns: int = 3) -> DenseFrame:
    """Columns of small numbers for each (event type, day)."""
    cells = s.range(DAYS * columns).select((F.col("id") / columns).cast("long").alias("row"), (F.col("id") % columns).alias("col"))
    return DenseFrame(cells.withColumn("val", (F.col("row") % 7 + 1) * (F.col("col") - 1) + F.lit(0.3719)), (DAYS, columns))


def first_weights(s) -> DenseFrame:
    return DenseFrame(weights(s).df.where("col = 2").select(F.col("row").alias("i0"), "val"), (DAYS,))


def by_user(s, d) -> DenseFrame:
    n = daily(s, d).shape[0]
    return DenseFrame(s.range(n).select(F.col("id").alias("i0"), (F.col("id") % 5 - 1.5).alias("val")), (n,))


_SPMM = f"WITH {_W}, x AS ({ADDED}), y AS (SELECT r, k, sum(v * w) AS v FROM x JOIN w USING (c) GROUP BY ALL)"
for _fmt in ("csr", "csc", "coo"):
    _full = f"{_SPMM} SELECT i AS row, CAST(j AS BIGINT) AS col, {_val('coalesce(v, 0)')} FROM range({USERS}) a(i) CROSS JOIN range(3) b(j) LEFT JOIN y ON r = i AND k = j"
    query(f"spmm_{_fmt}", _full)(lambda s, d, fmt=_fmt: daily(s, d, fmt) @ weights(s))
    query(f"tensordot_{_fmt}", _full)(lambda s, d, fmt=_fmt: linalg.tensordot(daily(s, d, fmt), weights(s), 1))
    query(f"vecdot_axis1_{_fmt}", f"{_SPMM} SELECT i AS i0, {_val('coalesce(v, 0)')} FROM range({USERS}) a(i) LEFT JOIN y ON r = i AND k = 2")(lambda s, d, fmt=_fmt: linalg.vecdot(daily(s, d, fmt), first_weights(s), 1))
    query(f"vecdot_axis0_{_fmt}", f"WITH x AS ({ADDED}), y AS (SELECT c, sum(v * (r % 5 - 1.5)) AS v FROM x GROUP BY c) SELECT i AS i0, {_val('coalesce(v, 0)')} FROM range({DAYS}) a(i) LEFT JOIN y ON c = i")(
        lambda s, d, fmt=_fmt: linalg.vecdot(daily(s, d, fmt), by_user(s, d), 0)
    )
    query(f"transpose_{_fmt}", f"SELECT c AS row, r AS col, {_val('v')} FROM ({source(_fmt)})")(lambda s, d, fmt=_fmt: daily(s, d, fmt).T)
    for _to in ("csr", "csc", "coo"):
        if _to != _fmt:
            query(f"{_fmt}_as_{_to}", names(_to, source(_fmt) if _to == "coo" else ADDED))(lambda s, d, fmt=_fmt, to=_to: getattr(daily(s, d, fmt), f"to_{to}")())
query("unfold_axes_csc", f"SELECT d * 5 + b AS row, a AS col, {_val('sum(v)')} FROM ({E_SQL}) GROUP BY ALL")(lambda s, d: manipulation.axes_unfold_to_csc(events(s, d), (2, 1)))
query("astype", names("csr", ADDED))(lambda s, d: daily(s, d).astype(float))
query("spmv_csr_of_repeats", f"WITH {_W}, x AS ({RAW}) SELECT i AS i0, {_val('coalesce(v, 0)')} FROM range({USERS}) a(i) LEFT JOIN (SELECT r, sum(v * w) AS v FROM x JOIN w USING (c) WHERE k = 2 GROUP BY r) ON r = i")(lambda s, d: daily(s, d, "coo") @ first_weights(s))
query("matmul_dense", f"{_SPMM} SELECT i AS row, CAST(j AS BIGINT) AS col, {_val('coalesce(v, 0)')} FROM range({USERS}) a(i) CROSS JOIN range(3) b(j) LEFT JOIN y ON r = i AND k = j")(lambda s, d: xp.matmul(daily(s, d).todense(), weights(s)))

# ---- comparing, searching and sorting, with missing cells

for _name, _op in (("equal", "="), ("not_equal", "<>"), ("less", "<"), ("less_equal", "<="), ("greater", ">"), ("greater_equal", ">=")):
    query(f"{_name}_missing", f"WITH {GRID} SELECT r AS row, c AS col, v {_op} 0 AS val FROM g")(lambda s, d, name=_name: elementwise.compare(name, daily(s, d, "csc"), 0.0))
query("argmax_missing", f"WITH {GRID} SELECT r AS i0, arg_max(c, (v, -c)) AS val FROM g GROUP BY r")(lambda s, d: searching.arg_extreme("argmax", daily(s, d).todense(), 1))
query("argmin_missing", f"WITH {GRID} SELECT CAST(0 AS BIGINT) AS row, c AS col, arg_min(r, (v, r)) AS val FROM g GROUP BY c")(lambda s, d: xp.argmin(daily(s, d).todense(), axis=0, keepdims=True))
query("sort_missing", f"WITH {GRID} SELECT r AS row, row_number() OVER (PARTITION BY r ORDER BY v, c) - 1 AS col, {_val('v')} FROM g")(lambda s, d: searching.sort(daily(s, d).todense(), 1))
query("sort_descending", f"WITH {GRID} SELECT r AS row, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) - 1 AS col, {_val('v')} FROM g")(lambda s, d: xp.sort(daily(s, d).todense(), axis=1, descending=True))
query("argsort_missing", f"WITH {GRID} SELECT row_number() OVER (PARTITION BY c ORDER BY v, r) - 1 AS row, c AS col, r AS val FROM g")(lambda s, d: searching.argsort(daily(s, d).todense(), 0))
query("take_along_axis", f"WITH {GRID}, o AS (SELECT r, c, row_number() OVER (PARTITION BY r ORDER BY v, c) - 1 AS k, v FROM g) SELECT r AS row, k AS col, {_val('v')} FROM o")(
    lambda s, d: (lambda x: manipulation.take_along_axis(x, searching.argsort(x, 1), 1))(daily(s, d).todense())
)
query("tril_missing", names("csr", f"SELECT * FROM ({ADDED}) WHERE c - r <= 3"))(lambda s, d: manipulation.tril(daily(s, d), 3))
query("triu_missing", names("csr", f"SELECT * FROM ({ADDED}) WHERE c - r >= -2"))(lambda s, d: manipulation.triu(daily(s, d), -2))
query("nonzero_missing", f"SELECT r AS row, c AS col FROM ({ADDED}) WHERE v <> 0")(lambda s, d: searching.nonzero(daily(s, d, "coo")))
query("where_missing", f"WITH {GRID} SELECT r AS row, c AS col, {_val('CASE WHEN v > 0 THEN v ELSE 1 - v END')} FROM g")(
    lambda s, d: (lambda x: searching.where(elementwise.compare("greater", x, 0.0), x, elementwise.binary("subtract", 1.0, x)))(daily(s, d).todense())
)

# ---- functions of one and two values, on vectors

_V = "SELECT s_suppkey AS i, s_acctbal / 1024 AS v, (s_suppkey % 9) - 4.0 AS w FROM supplier"
_INF, _NAN = "CAST('inf' AS DOUBLE)", "CAST('nan' AS DOUBLE)"


def scaled(s, d) -> DenseFrame:
    return elementwise.binary("divide", balances(s, d), 1024.0)


def ninths(s, d) -> DenseFrame:
    n = _count(s, d, "supplier")
    return dense_table(_table(s, d, "supplier").withColumn("w", F.col("s_suppkey") % 9 - F.lit(4.0)), (n,), ["s_suppkey"], "w")


ONE = {
    "exp": "exp(v)", "log": f"CASE WHEN v < 0 THEN {_NAN} WHEN v = 0 THEN -{_INF} ELSE ln(CASE WHEN v > 0 THEN v END) END", "cos": "cos(v)", "tan": "tan(v)", "sinh": "sinh(v)", "cosh": "cosh(v)",
    "log2": f"CASE WHEN v < 0 THEN {_NAN} WHEN v = 0 THEN -{_INF} ELSE log2(CASE WHEN v > 0 THEN v END) END", "log10": f"CASE WHEN v < 0 THEN {_NAN} WHEN v = 0 THEN -{_INF} ELSE log10(CASE WHEN v > 0 THEN v END) END",
    "round": "round_even(v, 0)", "positive": "v", "real": "v", "conj": "v", "imag": "0 * v",
}
for _name, _sql in ONE.items():
    query(f"xp_{_name}", f"SELECT i AS i0, {_val(_sql)} FROM ({_V})")(lambda s, d, name=_name: getattr(xp, name)(scaled(s, d)))
for _name, _sql in (("asin", "asin(v / 11)"), ("acos", "acos(v / 11)"), ("atanh", "atanh(v / 11)"), ("acosh", "acosh(1 + v * v)")):
    query(f"xp_{_name}", f"SELECT i AS i0, {_val(_sql)} FROM ({_V})")(lambda s, d, name=_name: getattr(xp, name)((lambda x: elementwise.binary("add", elementwise.unary("square", x), 1.0) if name == "acosh" else elementwise.binary("divide", x, 11.0))(scaled(s, d))))
for _name, _sql in (("signbit", "v < 0"), ("isnan", "false"), ("isinf", "v = 0"), ("logical_not", "v = 0")):
    query(f"xp_{_name}", f"SELECT i AS i0, {_sql} AS val FROM (SELECT i, {'w' if _name in ('isinf', 'logical_not') else 'v'} AS v FROM ({_V}))")(
        lambda s, d, name=_name: getattr(xp, name)({"isinf": lambda: elementwise.binary("divide", 1.0, ninths(s, d)), "logical_not": lambda: ninths(s, d)}.get(name, lambda: scaled(s, d))())
    )
TWO = {
    "add": "v + w", "subtract": "v - w", "multiply": "v * w", "pow": "pow(abs(v), w)", "maximum": "greatest(v, w)", "minimum": "least(v, w)", "atan2": "atan2(v, w)",
    "copysign": "CASE WHEN w < 0 THEN -abs(v) ELSE abs(v) END", "logaddexp": "greatest(v, w) + ln(1 + exp(-abs(v - w)))",
    "divide": f"CASE WHEN w <> 0 THEN v / w WHEN v = 0 THEN {_NAN} WHEN v > 0 THEN {_INF} ELSE -{_INF} END",
}
for _name, _sql in TWO.items():
    query(f"xp_{_name}", f"SELECT i AS i0, {_val(_sql)} FROM ({_V})")(lambda s, d, name=_name: getattr(xp, name)(elementwise.unary("abs", scaled(s, d)) if name == "pow" else scaled(s, d), ninths(s, d)))
for _name, _sql in (("logical_and", "v <> 0 AND w <> 0"), ("logical_or", "v <> 0 OR w <> 0"), ("logical_xor", "(v <> 0) <> (w <> 0)")):
    query(f"xp_{_name}", f"SELECT i AS i0, {_sql} AS val FROM ({_V})")(lambda s, d, name=_name: getattr(xp, name)(scaled(s, d), ninths(s, d)))
_BITS = "SELECT s_suppkey AS i, s_suppkey % 37 AS v, s_suppkey % 5 AS w FROM supplier"


def whole(s, d, by: int) -> DenseFrame:
    n = _count(s, d, "supplier")
    return dense_table(_table(s, d, "supplier").withColumn("w", F.col("s_suppkey") % by), (n,), ["s_suppkey"], "w")


for _name, _sql in (("bitwise_and", "v & w"), ("bitwise_or", "v | w"), ("bitwise_xor", "xor(v, w)"), ("bitwise_left_shift", "v << w"), ("bitwise_right_shift", "v >> w")):
    query(f"xp_{_name}", f"SELECT i AS i0, CAST({_sql} AS DOUBLE) AS val FROM ({_BITS})")(lambda s, d, name=_name: getattr(xp, name)(whole(s, d, 37), whole(s, d, 5)))
query("xp_bitwise_invert", f"SELECT i AS i0, CAST(-v - 1 AS DOUBLE) AS val FROM ({_BITS})")(lambda s, d: xp.bitwise_invert(whole(s, d, 37)))
query("add_broadcast", f"WITH {GRID}, {_W} SELECT g.r AS row, g.c AS col, {_val('v + w')} FROM g JOIN w ON w.c = g.c WHERE k = 2")(lambda s, d: xp.add(daily(s, d).todense(), first_weights(s)))
query("multiply_outer", f"SELECT a.i AS row, b.i AS col, {_val('a.v * b.w')} FROM ({_V}) a CROSS JOIN ({_V}) b")(lambda s, d: xp.multiply(manipulation.expand_dims(scaled(s, d), 1), ninths(s, d)))

# ---- shapes and creation

query("squeeze", f"SELECT s_suppkey AS i0, {_val('s_acctbal')} FROM supplier")(lambda s, d: xp.squeeze(manipulation.expand_dims(balances(s, d), 0), 0))
query("moveaxis", f"SELECT b AS i0, d AS i1, a AS i2, {_val('v')} FROM ({E_SQL})")(lambda s, d: xp.moveaxis(events(s, d), 0, 2))
query("unstack", f"SELECT a AS i0, d AS i1, {_val('v')} FROM ({E_SQL}) WHERE b = 2")(lambda s, d: xp.unstack(events(s, d), axis=1)[2])
query("broadcast_arrays", f"SELECT a.i AS row, b.i AS col, {_val('a.v')} FROM ({_V}) a CROSS JOIN ({_V}) b")(lambda s, d: xp.broadcast_arrays(manipulation.expand_dims(scaled(s, d), 1), ninths(s, d))[0])
query("meshgrid", f"SELECT b.i AS row, a.i AS col, {_val('a.v')} FROM ({_V}) a CROSS JOIN ({_V}) b")(lambda s, d: xp.meshgrid(scaled(s, d), ninths(s, d))[0])
query("full", "SELECT a.i AS row, b.i AS col, CAST(2.5 AS DOUBLE) AS val FROM range(4) a(i) CROSS JOIN range(3) b(i)")(lambda s, d: xp.full((4, 3), 2.5))
query("ones_like", f"SELECT s_suppkey AS i0, CAST(1 AS DOUBLE) AS val FROM supplier")(lambda s, d: xp.ones_like(balances(s, d)))
query("full_like", f"SELECT s_suppkey AS i0, CAST(-3 AS DOUBLE) AS val FROM supplier")(lambda s, d: xp.full_like(balances(s, d), -3.0))
query("repeat_flat", f"WITH {GRID} SELECT (r * {DAYS} + c) * 2 + k AS i0, {_val('v')} FROM g CROSS JOIN range(2) t(k)")(lambda s, d: xp.repeat(daily(s, d).todense(), 2))
query("roll_axes", f"WITH {GRID} SELECT (r + 2) % {USERS} AS row, (c + {DAYS - 3}) % {DAYS} AS col, {_val('v')} FROM g")(lambda s, d: xp.roll(daily(s, d).todense(), (2, -3), (0, 1)))
query("cumulative_sum_vector", f"SELECT i AS i0, {_val('sum(v) OVER (ORDER BY i)')} FROM ({_V})")(lambda s, d: xp.cumulative_sum(scaled(s, d)))
query("diff_vector", f"SELECT i AS i0, {_val('v')} FROM (SELECT i, lead(v) OVER (ORDER BY i) - v AS v FROM ({_V})) WHERE v IS NOT NULL")(lambda s, d: xp.diff(scaled(s, d)))
