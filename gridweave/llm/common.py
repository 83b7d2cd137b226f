"""Helpers shared by the training-data operators: inputs, scratch space, sampling, linked groups."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a hot node, key or label may have before it is salted.
HOT_ROWS = 2_000
#: Rows of a few numbers each that may be sent to all tasks: some 16 to 32 MB.
MOST_SENT = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark wherever that folder is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where the session names none, a temporary one is set if it runs on this machine alone, as in tests.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not held.isDefined():
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, cut from their lineage by a table in the shared folder.

    A table also forgets what the optimiser has derived about the rows; DataFrame.checkpoint() hands that on, and
    over many rounds it grows until planning takes minutes.
    """
    return stored(df, "round")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_at_a_time(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """df, whose whole texts Python functions now get so many rows at a time: a setting of the session that stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, rows)
    return df


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Inside, Python functions get so many rows at a time; for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(folds)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: F.Column, limit: int) -> DataFrame:
    """Texts and labels of at most `limit` labelled rows: those with the smallest hash of their id.

    The bound is what makes the broadcast of the ids safe. Null labels, ids and texts take no part. Of an id that
    is labelled twice the smaller label counts, and of one that has several texts that with the smallest hash.
    """
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    both = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    one = F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text"))
    return both.groupBy("doc_id").agg(one.alias("x")).select("x.text", "x.label")


def _salted_lookup(rows: DataFrame, values: DataFrame, hot: DataFrame, key: str, other: str, salts: int = 64) -> DataFrame:
    """Joins the one row of each key onto all rows of that key; rows of hot keys are dealt over `salts` tasks.

    hot: keys with over HOT_ROWS rows and over a 10,000th of all rows, so 10,000 at most: a safe broadcast.
    """
    hot = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(other), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    spread = (
        values.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def looked_up(rows: DataFrame, values: DataFrame, counts: DataFrame, key: str, other: str) -> DataFrame:
    """rows with the one row of values for their key; counts holds the rows n of each key, hot ones are salted."""
    counts = counts.select(key, "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return _salted_lookup(rows, values, _hot_keys(counts, total), key, other)


def small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df marked for broadcast if its rows, of a few numbers each, are counted to be few; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


_KEPT: dict = {}


def worker_held(key, make):
    """What make() gives, kept in this Python worker for its next task; what it kept before goes, so that a worker keeps one thing."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def spare() -> None:
    """Gives back what tasks of this Python worker have left: things kept, encoders, and memory that is held free."""
    from gridweave.llm import tokens

    _KEPT.clear()
    tokens.release()
    gc.collect()  # encoders refer to themselves
    trim()


def trim() -> None:
    """Gives memory that Arrow and the C library hold free back to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def sparing(read):
    """A function over batches that leaves nothing in its Python worker when a task ends.

    Spark keeps workers for later tasks, and after stages with two Python functions in a task more of them than run at once:
    those that wait would hold what their last task left.
    """

    @functools.wraps(read)
    def own(batches):
        try:
            yield from read(batches)
        finally:
            spare()

    return own


def trimmed(work):
    """A function of one group that gives back what its worker holds free afterwards."""

    @functools.wraps(work)
    def own(rows):
        try:
            return work(rows)
        finally:
            trim()

    return own


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not use, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges (a, b) of ids: a row (id, component) for each id on an edge.

    component is the smallest id reachable. Large-star and small-star rounds, each cut by a checkpoint;
    a round's state is at most one row for each edge. Rows with a null or equal ends are ignored.
    """
    own = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    own = checkpointed(own)
    before = None
    for _ in range(max_rounds):
        own = _small_star(checkpointed(_large_star(own)))
        own = checkpointed(own)
        now = own.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = own.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id"))
    return own.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)


def _hot_keys(best: DataFrame, total: int) -> DataFrame:
    return best.where(F.col("n") > max(HOT_ROWS, total // 10_000))


def _large_star(own: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = own.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(own.select(F.col("u").alias("x"), F.col("v").alias("y")))
    best = checkpointed(both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n"))
    joined = _salted_lookup(both.where("y > x"), best.select("x", "m"), _hot_keys(best, 2 * own.count()), "x", "y")
    return joined.select(F.col("y").alias("v"), F.col("m").alias("u")).where("v != u").distinct()


def _small_star(own: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are linked to the smallest of them."""
    best = checkpointed(own.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")))
    joined = _salted_lookup(own, best.select("v", "m"), _hot_keys(best, own.count()), "v", "u")
    smaller = joined.where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return best.select("v", F.col("m").alias("u")).unionByName(smaller).distinct()


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest one that is reached through the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
