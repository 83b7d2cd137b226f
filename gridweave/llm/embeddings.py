"""Embedding near-duplicates by int8 tile products with error bounds.

Unit vectors are rounded to int8 with a scale each. The product of two tiles of int8 vectors is exact; with
the norms of the rounding errors it bounds every cosine from both sides of the tile, and only pairs that may
reach the threshold are computed in double precision. Equal vectors are compared once for all their copies,
and a tile gives back counts and a spanning set of links, never all its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import components, looked_up, smallest_linked, stored

#: Numbers and rows of a block; a tile is a pair of blocks of one label.
BLOCK_NUMBERS, LEAST_ROWS, MOST_ROWS = 4_000_000, 1_024, 8_192
#: Dimensions whose int8 products add up exactly in single precision.
EXACT_DIMS = 1024
#: Hot labels that may be broadcast with their number of blocks.
MOST_HOT = 1_000_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, scales, bounds of the rounding errors' norms) of the rows of x made unit length."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q, scale, error * (1 + 1e-9) + 1e-12


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the rows of a and b whose cosine in double precision reaches the threshold."""
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    norm_a, norm_b, near_i, near_j = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1), [], []
    right = [qb[:, k : k + EXACT_DIMS].astype(np.float32).T for k in range(0, a.shape[1], EXACT_DIMS)]
    for x in range(0, len(a), chunk):  # rows of the tile at a time
        own = slice(x, x + chunk)
        product = sum((qa[own, EXACT_DIMS * k : EXACT_DIMS * (k + 1)].astype(np.float32) @ r).astype(np.float64) for k, r in enumerate(right))
        # |u.v - st q.r| <= |sq||f| + |e||tr| + |e||f| with |sq| <= 1 + |e| and |tr| <= 1 + |f|
        bound = ea[own, None] + eb[None, :] + 3 * ea[own, None] * eb[None, :]
        i, j = np.nonzero(product * sa[own, None] * sb[None, :] + bound >= threshold - 1e-12)
        for k in range(0, len(i), 50_000):
            p, q = i[k : k + 50_000] + x, j[k : k + 50_000]
            kept = np.einsum("ij,ij->i", a[p], b[q]) / (norm_a[p] * norm_b[q]) >= threshold
            near_i.append(p[kept])
            near_j.append(q[kept])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *near_i]), np.concatenate([none, *near_j])


def tile_links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(cid, n, root) for the vectors of a tile that have links in it: how many vectors, and whom they reach.

    A tile of one block has the links within it, one of two blocks those between them.
    """
    rows = rows.sort_values("cid")
    x, copies, cid, block = np.stack(rows["vector"].to_numpy()).astype(np.float64), rows["copies"].to_numpy(), rows["cid"].to_numpy(), rows["block"].to_numpy()
    first = np.flatnonzero(block == block.min())
    second = np.flatnonzero(block != block.min())
    if rows["low"].iat[0] != rows["high"].iat[0]:
        if not len(second):  # the other block is empty
            return pd.DataFrame({"cid": cid[:0], "n": copies[:0], "root": cid[:0]})
        i, j = near_pairs(x[first], x[second], threshold)
        i, j = first[i], second[j]
    else:
        i, j = near_pairs(x, x, threshold)
        i, j = i[i < j], j[i < j]
    n = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
    at = np.flatnonzero(n)
    return pd.DataFrame({"cid": cid[at], "n": n[at].astype(np.int64), "root": cid[smallest_linked(len(x), i, j)[at]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows of one label and dimension are linked if their cosine reaches the threshold, copies included. A null
    label, and a vector that is null, empty, zero or holds null or non-finite components, links with nothing.
    component_id is the smallest vec_id reachable, itself included; kept is true where that is its own, and
    false for a null vec_id. Repeated rows come back repeated, and count as linked to each other.
    """
    spark = vectors.sparkSession
    own = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists("vector", lambda v: v != 0)
    own = own.withColumn("fine", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    rows = F.lit(block) if block else F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), F.floor(BLOCK_NUMBERS / F.col("dims"))))
    classes = own.where("fine").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "label", F.size("vector").alias("dims"), "vector", "least", "copies"), "vector-classes")

    kinds = ["label", "dims"]
    hot = classes.groupBy(*kinds).count().where(F.col("count") > rows).select(*kinds, F.ceil(F.col("count") / rows).cast("int").alias("blocks"))
    hot = stored(hot, "hot-labels")
    hot = F.broadcast(hot) if hot.count() <= MOST_HOT else hot
    tiles = (
        classes.select("cid", *kinds, "vector", "copies").join(hot, kinds, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )
    found = tiles.groupBy(*kinds, "low", "high").applyInPandas(lambda rows: tile_links(rows, threshold), "cid long, n long, root long")
    found = stored(found, "vector-links")
    groups = stored(components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))), "vector-groups")
    least = groups.join(classes.select(F.col("cid").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    member = groups.join(least, "component").select(F.col("id").alias("cid"), "component_id")
    linked = found.groupBy("cid").agg(F.sum("n").alias("n"))
    known = (
        classes.join(linked, "cid", "left").join(member, "cid", "left")
        .select(F.struct("label", "vector").alias("key"), "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    known = stored(known, "vectors-known")
    keyed = own.where("fine").select("vec_id", F.struct("label", "vector").alias("key"))
    done = looked_up(keyed, known.drop("copies"), known.select("key", F.col("copies").alias("n")), "key", "vec_id").select("vec_id", "n_links", "component_id")
    alone = own.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
