"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of a text.

Each byte of a text gets a label: whether a token of A, of B, of both or of neither ends there. A regex scan cuts the
label string behind each byte where both end, and the labels of a span say how many tokens of either side form the group.
Tokens whose bytes overlap are linked. How many documents hold a pair of ids linked is counted over the corpus; documents
look their links up again: the common pairs in a table of bounded size that every task has, the others, each of which few
documents hold, by a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import batches_of, stored, worker_held
from gridweave.llm.tokens import ByteEncoder, PieceEncoder

#: Labels of a byte, and what ends with a byte where tokens of both sides end.
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
GROUP = re.compile(rb"[^\x03]*\x03")
#: Pairs that every task holds, pairs counted at once, and texts that a Python function gets at a time.
MOST_HELD, COUNTED_AT_ONCE, TEXTS_AT_ONCE = 1_000_000, 2_000_000, 500
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit number for ids of A and B, of 16 bits each; by A first."""
    return (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)


class Aligner:
    """tokens, groups and links of a text by two tokenizers: A of byte-level entries, B of pieces with byte fallback."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteEncoder(path_a), PieceEncoder(path_b)
        tables = self.a.pieces(), self.b.pieces()
        if max(map(len, tables)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in tables]
        # each id with what may follow it, as a row of bytes, zeros behind
        told = [f"{k}{c}".encode() for k in range(max(map(len, tables))) for c in ",|;"]
        self.told = np.array(told, "S6").view(np.uint8).reshape(-1, 6)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both sides for a space and the text; none where either side's bytes are others than that."""
        if text and (a := self.a.ids(" " + text)) is not None and (b := self.b.ids(text)) is not None:
            return np.array(a, np.uint32), np.array(b, np.uint32)
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def labels(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A label for each byte of the tokens."""
        ends = [np.cumsum(sizes[ids]) for ids, sizes in zip((a, b), self.sizes, strict=True)]
        out = np.zeros(int(ends[0][-1]) if len(a) else 0, np.uint8)
        out[ends[0] - 1] |= A_END
        out[ends[1] - 1] |= B_END
        return out

    def groups(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A and of B each group holds: one more than the labels of its own that its span has before the last."""
        spans = GROUP.findall(labels.tobytes())
        ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
        return tuple(np.diff(np.cumsum(labels == label, dtype=np.int64)[ends - 1], prepend=0) + 1 for label in (A_END, B_END))

    def written(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> bytes:
        """The groups as a1,a2|b1;a3|b2,b3."""
        starts = np.cumsum(of_a + of_b) - of_a - of_b
        first = np.repeat(starts, of_a) + np.arange(len(a)) - np.repeat(np.cumsum(of_a) - of_a, of_a)
        second = np.repeat(starts + of_a, of_b) + np.arange(len(b)) - np.repeat(np.cumsum(of_b) - of_b, of_b)
        told = np.zeros(len(a) + len(b), np.int64)
        told[first], told[second] = 3 * a.astype(np.int64), 3 * b.astype(np.int64)
        told[starts + of_a - 1] += 1
        told[starts + of_a + of_b - 1] += 2
        return self.told[told].tobytes().translate(None, b"\0")[:-1]

    def links(self, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The pair of each link: up to each end of a token, from the end before, one token of A and one of B overlap."""
        ends = labels[np.flatnonzero(labels)]
        of_a, of_b = ends & 1, ends >> 1
        return pair_key(a[np.cumsum(of_a, dtype=np.int64) - of_a], b[np.cumsum(of_b, dtype=np.int64) - of_b])

    def aligned(self, text: str | None) -> tuple[int, int, int, int, str, bytes]:
        """(tokens of A, of B, groups, links, hash of the groups, the different pairs and their times)."""
        a, b = self.tokens(text)
        if not len(a):
            return 0, 0, 0, 0, "", b""
        labels = self.labels(a, b)
        of_a, of_b = self.groups(labels)
        links = self.links(a, b, labels)
        return len(a), len(b), len(of_a), len(links), hashlib.sha256(self.written(a, b, of_a, of_b)).hexdigest(), packed_pairs(*np.unique(links, return_counts=True))


def packed_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys by their steps, and how often each comes, byte by byte: high bytes are mostly zero and pack small."""
    columns = np.diff(keys, prepend=np.uint32(0)).astype("<u4"), times.astype("<u4")
    return b"".join(c.view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)


def unpacked_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    columns = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4")[..., 0]
    return np.cumsum(columns[0], dtype=np.uint32), columns[1]


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, kept for the next task of the same worker."""
    return worker_held(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each of docs, with its own number, its sizes and its pairs, in a stored table."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = aligner(path_a, path_b)
        for batch in batches:
            found = [own.aligned(text) for text in batch["text"]]
            columns = zip(*found, strict=True) if found else [[]] * 6
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"].astype("Int64")} | {c: list(x) for c, x in zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"), columns, strict=True)})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with batches_of(docs.sparkSession, TEXTS_AT_ONCE):
        return stored(rows.mapInPandas(read, ALIGNED), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold each pair of ids, and whether no pair of its A id is in more. Stored."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for data in batch["pairs"]:
                held.append(unpacked_pairs(data)[0])
                size += len(held[-1])
                if size > COUNTED_AT_ONCE:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"pair": keys.astype(np.int64), "n": n})

    with batches_of(rows.sparkSession, TEXTS_AT_ONCE):
        counts = stored(rows.select("pairs").mapInPandas(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs-counted")
    of_a = F.shiftright("pair", 16).alias("a")
    most = counts.groupBy(of_a).agg(F.max("n").alias("most"))  # a row for each id of A at most
    return stored(counts.withColumn("a", of_a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _common(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(digits, pairs, n, best): pairs whose n has at least so many binary digits, the fewest that leave `most` pairs or less."""
    digits = F.length(F.bin("n"))
    sizes = {r["digits"]: r["count"] for r in counts.groupBy(digits.alias("digits")).count().collect()}  # 63 rows at most
    least, total = 64, 0
    while least > 1 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    rows = counts.where(digits >= least).orderBy("pair").toPandas()
    return least, rows["pair"].to_numpy(np.uint32), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)


def align(docs: DataFrame, path_a: str, path_b: str, most_held: int = MOST_HELD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each of docs.

    Null and empty texts, and those that one side's tokens do not spell, have no tokens: zeros and an empty hash. Repeated
    rows count as documents of their own; a null doc_id comes back as null. Special tokens in texts are plain text.
    """
    rows = aligned(docs, path_a, path_b)
    counts = pair_counts(rows)
    least, *held = _common(counts, most_held)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(held))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n, best = sent.value
        for batch in batches:
            own = [unpacked_pairs(data) for data in batch["pairs"]]
            sizes = np.array([len(k) for k, _ in own], np.int64)
            keys, times = (np.concatenate([np.zeros(0, np.uint32), *x]) for x in (zip(*own, strict=True) if own else ((), ())))
            times, ends = times.astype(np.int64), np.cumsum(sizes)
            place = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
            known = pairs[place] == keys if len(pairs) else np.zeros(len(keys), bool)
            at, out = place[known], batch[kept].copy()
            for name, value in (("n_best", best[at]), ("count_sum", n[at])):
                each = np.zeros(len(keys) + 1, np.int64)
                each[1:][known] = times[known] * value
                sums = np.cumsum(each)
                out[name] = sums[ends] - sums[ends - sizes]
            out["rest"] = [k[~x].astype(np.int64) for k, x in zip(np.split(keys, ends[:-1]), np.split(known, ends[:-1]), strict=True)]
            out["times"] = [k[~x] for k, x in zip(np.split(times, ends[:-1]), np.split(known, ends[:-1]), strict=True)]
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    form = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, times array<long>"
    with batches_of(docs.sparkSession, TEXTS_AT_ONCE):
        found = stored(rows.mapInPandas(looked, form), "pairs-looked-up")
    rare = found.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("k"))
    rare = rare.join(counts.where(F.length(F.bin("n")) < least), "pair")
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("rare_best"), F.sum(F.col("k") * F.col("n")).alias("rare_sum"))
    whole = found.join(sums, "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
