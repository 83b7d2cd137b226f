"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the distance agree on some segment up to a few
bits, so each is filed under the values of a small Hamming ball around its own value of every segment, and
those that meet under a value are compared in full. Values are dealt to tasks by bounded numbers of rows; a
value with too many is cut into blocks, and pairs of blocks are compared apart. Where a value is crowded with rows
near each other, their pairs are left to a comparison of whole texts block by block, in tasks that give back
only what connects them, so copies never turn into all their pairs and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import batches_of, components, few_at_a_time, free_name, looked_up, small, smallest_linked, sparing, stored, trimmed

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: Filed rows that are compared at once, that a task files, and rows under one value from which it is cut into blocks.
TASK_ROWS, FILED_ROWS, TILE_ROWS = 400_000, 4_000_000, 50_000
#: Fingerprints filed at a time, filed rows that travel as one record, and pairs of whole texts compared at a time.
AT_ONCE, RECORD_ROWS, TEXTS_AT_ONCE = 2_048, 512, 500
#: Slots that values are dealt to by hash: a slot's values are cut into as many blocks as the largest of them needs.
SLOTS = 1 << 20
#: Rows under one value that are compared along with those of others, near pairs a row from which a value is crowded,
#: and texts of one fingerprint that are compared pair by pair.
FEW, CROWD, ALIKE = 256, 1, 8
#: Near copies: fingerprints of five-word shingles in LANES words of 64 bits, at most so many bits apart in the first word and in
#: all of them, and shared shingles as a fraction. Texts that share four fifths differ by 10 and 48 bits on average.
SHINGLE, LANES, DISTANCE, WHOLE_DISTANCE, SHARE = 5, 5, 20, 84, (4, 5)


# ---- fingerprints

def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(held: list[bytes], shingle: int) -> np.ndarray:
    """64-bit hashes of all runs of `shingle` words, repeats included; of all words where there are fewer."""
    if not held:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(held), xxhash.xxh64_intdigest
    if len(held) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint: a bit is 1 if set in over half the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def lanes_of(hashes: np.ndarray) -> list[int]:
    """LANES signed fingerprints: of the hashes themselves, and of as many other hashes made from them."""
    out = [bits_of(hashes)]
    for k in range(1, LANES):
        own = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        own = (own ^ (own >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        own = (own ^ (own >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(bits_of(own ^ (own >> np.uint64(31))))
    return out


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 without words."""
    return bits_of(shingles(words(text), shingle))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", shingle: int = 4) -> DataFrame:
    """All rows and columns of docs, and the fingerprint of each text as a long; a column named `out` is replaced."""

    @F.pandas_udf("long")
    @sparing
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return few_at_a_time(docs).withColumn(out, of(F.col(text_col)))


# ---- filing

class Table(NamedTuple):
    """Where fingerprints are filed: by bits (word, shift, width) of them, within a radius."""

    fields: tuple[tuple[int, int, int], ...]
    radius: int

    @property
    def width(self) -> int:
        return sum(width for *_, width in self.fields)

    def values(self, words: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(words[0]), np.uint64)
        for word, shift, width in self.fields:
            out = (out << np.uint64(width)) | ((words[word] >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        return out

    def column(self, words: list[str]) -> F.Column:
        out = F.lit(0).cast("long")
        for word, shift, width in self.fields:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(words[word], shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return out


def plan_segments(distance: int, segments: int) -> list[Table]:
    """A table for each segment of 64 bits: any two within the distance meet in one of them."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    radius, rest = divmod(distance, segments)
    return [Table(((0, a, b - a),), radius if k <= rest else radius - 1) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if k <= rest or radius]


def plan_wide(width: int = 14, radius: int = 2) -> list[Table]:
    """A table for each pair of neighbouring segments in a ring, with as many segments of `width` bits as fit into the LANES words.

    It is a plan for wide fingerprints, whose two texts differ in a share of bits: two texts that share four fifths of their shingles
    meet in one of the 20 tables of 28 bits with a chance of 0.95, at 0.85 of 0.99. Any other two meet in 3 of 100,000 cases, and each
    text is filed 580 times; the pairs that meet by chance come to outnumber that beyond some 40 million texts, from where a
    larger width is in place.
    """
    segments = [(lane, shift, width) for lane in range(LANES) for shift in range(0, 64 - width + 1, width)]
    return [Table((one, segments[(k + 1) % len(segments)]), radius) for k, one in enumerate(segments)]


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of so many bits with at most `radius` of them set."""
    return np.array([sum(1 << b for b in flips) for n in range(radius + 1) for flips in combinations(range(width), n)], np.uint64)


def around(own: np.ndarray, k: int, width: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, keys) of values of segment k: two within the radius meet under a key.

    Both go halfway. Where the radius is odd, values with an even number of bits go the step that is left over:
    at an odd distance just one of the two has such a number.
    """
    odd = np.bitwise_count(own) & 1
    for at, reach in ((np.flatnonzero(odd == 0), (radius + 1) // 2), (np.flatnonzero(odd), radius // 2)):
        masks = ball(width, reach)
        yield np.repeat(at, len(masks)), (own[at][:, None] ^ masks[None, :]).ravel() | np.uint64(k << 32)


def filed_under(words: list[np.ndarray], plan: list[Table]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(table, positions, keys): where each fingerprint is filed, in all tables."""
    for k, table in enumerate(plan):
        for at, key in around(table.values(words), k, table.width, table.radius):
            yield k, at, key


def mixed(*parts: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def packed(*columns: np.ndarray) -> bytes:
    """64-bit columns, byte by byte, which packs small: the high bytes of sorted numbers hardly change."""
    return b"".join(c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1)).view("<u8")[..., 0]


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(slots)).astype(np.int64)


def gathered(batches: Iterator[pd.DataFrame], words: list[str]) -> Iterator[list[np.ndarray]]:
    """The words of fingerprints, AT_ONCE or more at a time, whatever the size of batches."""
    held, rows = [], 0
    for batch in batches:
        held.append([batch[w].to_numpy().view(np.uint64) for w in words])
        rows += len(batch)
        if rows >= AT_ONCE:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def hot_values(prints: DataFrame, plan: list[Table], words: list[str], tile_rows: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, blocks): the slots that hold keys with many rows, and into how many blocks their keys are cut.

    A key has over tile_rows rows only if some value in its ball is that of many fingerprints, so balls are
    opened around those values alone; what the others add to a key is at most tile_rows again.
    """
    most = max(len(ball(table.width, (table.radius + 1) // 2)) for table in plan)
    each = F.array(*[F.struct(F.lit(k).alias("k"), table.column(words).alias("value")) for k, table in enumerate(plan)])
    values = prints.select(F.explode(each).alias("x")).groupBy("x.k", "x.value").agg(F.count("*").alias("n")).where(F.col("n") * most >= tile_rows)

    @sparing
    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, own in batch.groupby("k"):
                for at, keys in around(own["value"].to_numpy().astype(np.uint64), int(k), plan[int(k)].width, plan[int(k)].radius):
                    yield pd.DataFrame({"key": keys.astype(np.int64), "slot": slot_of(keys, slots), "n": own["n"].to_numpy()[at]})

    keys = values.mapInPandas(opened, "key long, slot long, n long").groupBy("key", "slot").agg(F.sum("n").alias("n")).where(2 * F.col("n") > tile_rows)
    rows = keys.groupBy("slot").agg(F.max("n").alias("n")).toPandas()  # a row for each slot at most
    return rows["slot"].to_numpy(np.int64), 1 + np.ceil(rows["n"].to_numpy(float) / tile_rows).astype(np.int64)


# ---- comparing

def own_key(key: np.ndarray, a: np.ndarray, b: np.ndarray, plan: list[Table]) -> np.ndarray:
    """Whether a key is the one, of all under which fingerprints a and b of 64 bits meet, that stands for the pair.

    That is in their first table that meets, as far from a's value towards b's as a goes.
    """
    at, value, open_, found = key >> np.uint64(32), key & np.uint64((1 << 32) - 1), np.ones(len(key), bool), np.zeros(len(key), bool)
    for k, table in enumerate(plan):
        x, y, radius = table.values([a]), table.values([b]), table.radius
        diff = x ^ y
        apart = np.bitwise_count(diff)
        meets = open_ & (apart <= radius)
        steps = np.minimum(apart, np.where(np.bitwise_count(x) & 1, radius // 2, (radius + 1) // 2))
        for step in range((radius + 1) // 2):
            low = np.where(step < steps, diff & (~diff + np.uint64(1)), np.uint64(0))
            x, diff = x ^ low, diff ^ low
        found |= meets & (at == k) & (value == x)
        open_ &= ~meets
    return found


def own_of_two(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a key is the smaller of the two of its table under which values meet that both go one step.

    a and b: the steps taken, as a mask of one bit or none. Each table has one such key for a pair.
    """
    other = key ^ a ^ b
    return np.where(a == b, (a == 0), key <= other)


class _Union:
    """The groups of rows that links connect, kept while links come in."""

    def __init__(self, rows: int):
        self.root, self.held, self.size = np.arange(rows), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j))
        self.size += len(i)
        if self.size > 200_000:
            self.roots()

    def roots(self) -> np.ndarray:
        if self.held:
            i, j = (np.concatenate(x) for x in zip(*self.held, strict=True))
            at = np.flatnonzero(self.root != np.arange(len(self.root)))
            self.root, self.held, self.size = smallest_linked(len(self.root), np.concatenate([i, at]), np.concatenate([j, self.root[at]])), [], 0
        return self.root


class _Pairs:
    """Near pairs of rows in runs, each given under one key only, and the rows of crowded runs that have pairs there."""

    def __init__(self, fp: np.ndarray, run: np.ndarray, sizes: np.ndarray, stands, crowd: int):
        self.fp, self.run, self.stands = fp, run, stands
        self.room, self.count, self.whole = crowd * sizes, np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        self.missed, self.held = np.zeros(len(run), bool), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        stands = self.stands(i, j)
        np.add.at(self.count, self.run[i], 1)
        crowded = self.count[self.run[i]] > self.room[self.run[i]]
        self._miss(i[stands & crowded], j[stands & crowded])
        self.held.append((i[stands & ~crowded], j[stands & ~crowded]))

    def _miss(self, i: np.ndarray, j: np.ndarray) -> None:
        self.missed[i] = self.missed[j] = True

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, rows with pairs left out, for each of these one row of its run that stands for all of them)."""
        none = np.zeros(0, np.int64)
        i, j = (np.concatenate([none, *x]) for x in (zip(*self.held, strict=True) if self.held else ((), ())))
        crowded = self.count[self.run[i]] > self.room[self.run[i]]
        self._miss(i[crowded], j[crowded])
        missed = np.flatnonzero(self.missed | self.whole[self.run])
        begins = np.flatnonzero(np.r_[True, np.diff(self.run[missed]) != 0][: len(missed)])
        stand = np.repeat(missed[begins], np.diff(np.r_[begins, len(missed)]))
        return i[~crowded], j[~crowded], missed, stand


def compare_runs(out, key: np.ndarray, tile: np.ndarray, fp: np.ndarray, distance: int, few: int) -> None:
    """Gives `out` the pairs of rows that meet under a key and are near.

    Rows come in order of (key, tile without its last bit). A tile is (block, other block, which of the two a
    row is of); of a tile of two blocks only pairs across are compared.
    """
    starts, sizes, run = runs_of(key, tile)
    side = tile & np.uint64(1)
    across = (tile >> np.uint64(28)) != ((tile >> np.uint64(1)) & np.uint64((1 << 27) - 1))

    def near(i, j):
        return (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (~across[i] | (side[i] != side[j]))

    place = np.arange(len(run)) - starts[run]
    at = np.flatnonzero((sizes > 1)[run] & (sizes <= few)[run])
    for k in range(few):  # the k-th row of each run with all that follow it
        at = at[place[at] > k]
        if not len(at):
            break
        hub = starts[run[at]] + k
        hit = near(hub, at)
        if hit.any():
            out.add(hub[hit], at[hit])
    for r in np.flatnonzero(sizes > few).tolist():
        rows = np.arange(starts[r], starts[r] + sizes[r])
        for x in range(0, len(rows), 64):
            hubs = rows[x : x + 64, None]
            if isinstance(out, _Pairs) and out.count[r] > out.room[r]:  # crowded: all its rows are compared elsewhere
                out.whole[r] = True
                break
            for y in range(0, len(rows), 4096):
                cols = rows[None, y : y + 4096]
                a, b = np.nonzero((cols > hubs) & near(hubs, cols))
                if len(a):
                    out.add(hubs[a, 0], cols[0, b])


def runs_of(key: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rows, sizes, run of each row) of the runs of one key and pair of blocks."""
    lane = tile >> np.uint64(1)
    begins = np.r_[True, (key[1:] != key[:-1]) | (lane[1:] != lane[:-1])]
    starts = np.flatnonzero(begins)
    return starts, np.diff(np.r_[starts, len(key)]), np.cumsum(begins) - 1


def spanning(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one it is linked to) for those that links of rows connect."""
    names, place = np.unique(np.concatenate([fp[i], fp[j]]), return_inverse=True)
    root = smallest_linked(len(names), place[: len(i)], place[len(i) :])
    return names, names[root]


def candidates(prints: DataFrame, distance: int, plan: list[Table], pairs: bool = True, tile_rows: int = TILE_ROWS, few: int = FEW, crowd: int = CROWD) -> DataFrame:
    """What connects the distinct fingerprints (fp, and w1 and so on if they are wide) that meet and lie within the distance: rows (a, b, crowd).

    Without pairs, a spanning set of the links: each task's linked fingerprints and one that stands for them, crowd
    null. With pairs, all links as they are, save those that stand under crowded values: their fingerprints come as a, with
    one that all those share which such links connect as crowd, and b null. Of wide fingerprints, which steps of one
    bit lead to the keys of, a pair may come once for each table.
    """
    words = prints.columns
    wide = len(words) > 1
    total, most_slots = prints.count(), SLOTS
    hot_slots, hot_blocks = hot_values(prints, plan, words, tile_rows, most_slots) if total > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    filings = [(len(ball(t.width, t.radius // 2)) + len(ball(t.width, (t.radius + 1) // 2))) / 2 for t in plan]
    each = sum(filings)
    tasks = (total * each + tile_rows * int((hot_blocks * hot_blocks).sum())) / TASK_ROWS
    # each table has buckets of its own, so that what a task files at once in a table falls into few of them
    buckets = [max(1, math.ceil(tasks * n / each)) for n in filings]
    begins = [sum(buckets[:k]) for k in range(len(plan))]

    @sparing
    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = np.ones(most_slots if len(hot_slots) else 0, np.int64)
        slots[hot_slots] = hot_blocks
        for own_words in gathered(batches, words):
            fps = own_words[0]
            for k, at, key in filed_under(own_words, plan):
                if not len(at):
                    continue
                cut = slots[slot_of(key, most_slots)] if len(slots) else np.ones(len(key), np.int64)
                block = (mixed(fps)[at] >> np.uint64(20)).astype(np.int64) % cut
                step = np.arange(len(key)) % np.searchsorted(at, at[0], "right") if wide else np.zeros(len(key), np.int64)
                tile = np.zeros(len(key), np.uint64)
                if (cut > 1).any():
                    times = np.repeat(np.arange(len(key)), cut)
                    other = np.arange(len(times)) - np.repeat(np.cumsum(cut) - cut, cut)
                    at, key, block, step = at[times], key[times], block[times], step[times]
                    tile = ((np.minimum(block, other) << 28) | (np.maximum(block, other) << 1) | (block > other)).astype(np.uint64)
                bucket = begins[k] + (mixed(key, tile >> np.uint64(1)) % np.uint64(buckets[k])).astype(np.int64)
                order = np.lexsort((key, bucket))
                own, bucket = [c[order] for c in (key, tile | (step.astype(np.uint64) << np.uint64(56)), fps[at])], bucket[order]
                place = np.arange(len(order)) - np.maximum.accumulate(np.where(np.r_[True, bucket[1:] != bucket[:-1]], np.arange(len(order)), 0))
                first = np.flatnonzero(place % RECORD_ROWS == 0)  # where a bucket begins, or has filled a record
                ends = [*first[1:].tolist(), len(order)]
                yield pd.DataFrame({"bucket": bucket[first], "rows": [packed(*[c[a:b] for c in own]) for a, b in zip(first.tolist(), ends, strict=True)]})

    @trimmed
    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([unpacked(x, 3) for x in rows["rows"]], axis=1)
        step, own[1] = own[1] >> np.uint64(56), own[1] & np.uint64((1 << 56) - 1)
        order = np.lexsort((mixed(own[2]), own[1] >> np.uint64(1), own[0]))
        key, tile, fp = own[:, order]
        mask = np.where(step[order] > 0, np.uint64(1) << (np.maximum(step[order], 1) - np.uint64(1)), np.uint64(0))

        def stands(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            if wide:
                return own_of_two(key[i], mask[i], mask[j]) & (fp[i] != fp[j])
            return own_key(key[i], np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j]), plan)

        starts, sizes, run = runs_of(key, tile)
        out = _Pairs(fp, run, sizes, stands, crowd) if pairs else _Union(len(key))
        compare_runs(out, key, tile, fp, distance, few)
        if pairs:
            i, j, missed, stand = out.done()
            a, b = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
            names, roots = spanning(fp, missed, stand)
            whole = pd.DataFrame({"a": a.view(np.int64), "b": pd.Series(b.view(np.int64), dtype="Int64"), "crowd": pd.Series([None] * len(a), dtype="Int64")}).drop_duplicates()
            left = pd.DataFrame({"a": names.view(np.int64), "b": pd.Series([None] * len(names), dtype="Int64"), "crowd": pd.Series(roots.view(np.int64), dtype="Int64")})
            return pd.concat([x for x in (whole, left) if len(x)] or [whole])
        root = out.roots()
        at = np.flatnonzero(root != np.arange(len(root)))
        names, roots = spanning(fp, at, root[at])
        return pd.DataFrame({"a": names.view(np.int64), "b": pd.Series(roots.view(np.int64), dtype="Int64"), "crowd": pd.Series([None] * len(names), dtype="Int64")})

    dealt = prints.repartition(max(1, math.ceil(total * each / FILED_ROWS)))
    return dealt.mapInPandas(filed, "bucket long, rows binary").groupBy("bucket").applyInPandas(compared, "a long, b long, crowd long")


def grouped_prints(prints: DataFrame, distance: int, segments: int = 2, tile_rows: int = TILE_ROWS, few: int = FEW) -> DataFrame:
    """(id, component) of each fingerprint that is linked to another one: the groups within the distance."""
    links = candidates(prints.select("fp"), distance, plan_segments(distance, segments), False, tile_rows, few)
    return stored(components(stored(links, "simhash-links").select("a", "b")), "simhash-components")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, segments: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    fingerprint is a long; component_id is the smallest doc_id reachable by links of fingerprints within
    the distance. Null and empty texts have fingerprint 0 and are linked like any others. A row with a null doc_id
    links others like any row, and gets the smallest doc_id of its group, null if the group has none. Repeated rows come
    back repeated, and of other columns none. Two segments of 32 bits bring together one in 8 million of all pairs at
    a distance of 4; every text is filed 50 times.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text"), shingle=shingle).select("doc_id", "fingerprint"), "simhash")
    distinct = stored(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "simhash-distinct")
    groups = grouped_prints(distinct, distance, segments).withColumnRenamed("id", "fp")
    named = distinct.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    known = stored(named.join(least, "component").select(F.col("fp").alias("fingerprint"), "component_id", "n"), "simhash-groups")
    return looked_up(prints, known.drop("n"), known, "fingerprint", "doc_id").select("doc_id", "fingerprint", "component_id")


# ---- near copies, verified on whole texts

def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles share enough of their union, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both) and both > 0


def word_hash(held: list[bytes]) -> bytes:
    """A hash of 128 bits of a sequence of words: texts with the same one are copies."""
    return xxhash.xxh3_128_digest(b" ".join(held), SEED)


WORDS = ["fp", *(f"w{k}" for k in range(1, LANES))]


def text_prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, node, fp, w1 and so on, size) of each row with a doc_id: hash of its words, fingerprint, number of distinct shingles."""

    @sparing
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = words(text)
                hashes = shingles(own, shingle)
                rows.append((doc, word_hash(own), *lanes_of(hashes), len(np.unique(hashes))))
            yield pd.DataFrame(rows, columns=["doc_id", "node", *WORDS, "size"])

    form = f"doc_id long, node binary, {', '.join(f'{w} long' for w in WORDS)}, size int"
    return few_at_a_time(docs).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInPandas(read, form)


def _node():
    @F.pandas_udf("binary")
    @sparing
    def node(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([word_hash(words(t)) for t in texts])

    return node


def _texts_of(needed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the needed nodes, one row each."""
    wanted = stored(nodes.join(needed, "node", "left_semi").select("doc_id", "node"), "near-wanted")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi").withColumn("node", _node()("text"))
    return stored(texts.join(small(wanted), ["doc_id", "node"], "left_semi").dropDuplicates(["node"]).select("node", "text"), "near-texts")


def tile_copies(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    """(a, b): links that connect the similar texts of a tile, (node, fp, set, low, high, block) each.

    A tile of one block has the links within it, one of two blocks those between them. The shingles of all rows are
    looked up for one row after another, which counts what it shares with each.
    """
    rows = rows.sort_values("node")
    sets = [np.asarray(x, np.int64) for x in rows["set"]]
    node, fp, block, sizes = rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["block"].to_numpy(), np.array([len(x) for x in sets])
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    across = rows["low"].iat[0] != rows["high"].iat[0]
    found = _Union(len(sets))
    for i, own in enumerate(sets):
        lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        count = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        both = np.bincount(of[at], minlength=len(sets))
        alike = (SHARE[1] * both >= SHARE[0] * (sizes + sizes[i] - both)) & (np.bitwise_count(fp ^ fp[i]) <= distance)
        j = np.flatnonzero(alike & (block != block[i] if across else True))
        found.add(np.full(len(j), i), j)
    root = found.roots()
    at = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": node[at], "b": node[root[at]]})


def _crowded_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, distance: int, shingle: int, block_rows: int = 512) -> DataFrame:
    """Links (a, b) that connect the similar texts of each crowd: members (node, fp, crowd) are compared block by block."""
    members = stored(members, "near-members")

    @F.pandas_udf("array<long>")
    @sparing
    def shingle_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingles(words(t), shingle)).view(np.int64) for t in texts])

    sizes = small(stored(members.groupBy("crowd").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "near-crowds"))
    with batches_of(docs.sparkSession, TEXTS_AT_ONCE):
        sets = stored(_texts_of(members.select("node"), nodes, docs).select("node", shingle_set("text").alias("set")), "near-sets")
    tiles = (
        members.join(sizes, "crowd").join(sets, "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )
    return stored(tiles.groupBy("crowd", "low", "high").applyInPandas(trimmed(lambda rows: tile_copies(rows, distance)), "a binary, b binary"), "near-crowd-links")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar."""

    @F.pandas_udf("boolean")
    @sparing
    def alike(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, a, b in batches:
            held, out = {}, []
            for k, x, y in zip(key, a, b, strict=True):
                if k not in held:  # pairs come by their second text
                    held = {k: np.unique(shingles(words(y), shingle))}
                out.append(similar(np.unique(shingles(words(x), shingle)), held[k]))
            yield pd.Series(out, dtype=bool)

    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs)
    for side, other in (("a", "b"), ("b", "a")):
        counts = pairs.select(side, other).groupBy(side).agg(F.count("*").alias("n"))
        pairs = looked_up(pairs, texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), counts, side, other)
    with batches_of(docs.sparkSession, TEXTS_AT_ONCE):
        return stored(pairs.where(alike("b", "text_a", "text_b")).select("a", "b"), "near-links")


def near_copies(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, crowd: int = CROWD, alike: int = ALIKE, width: int = 14) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): (doc_id, node) of all rows with a doc_id, and (node, doc_id, component) of all different texts.

    Texts are linked if their wide fingerprints meet in a table of plan_wide(width), are within the distances, and their whole texts share
    SHARE of their distinct shingles; component is one hash for each group. doc_id is the smallest of a text's. Texts without
    words are copies of one another. Pairs are verified one by one; crowds, where nearly all are near each other,
    and texts of one fingerprint where they are many, are compared in blocks that give back what connects them.
    """
    rows = stored(text_prints(docs, shingle), "near-prints")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in (*WORDS, "size")]), "near-nodes")
    own = nodes.where("size > 0").select("node", *WORDS, "size")
    prints = stored(own.groupBy(*WORDS).agg(F.count("*").alias("n")), "near-distinct")
    found = stored(candidates(prints.select(*WORDS), distance, plan_wide(width), crowd=crowd), "near-met")
    several = small(prints.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1"))
    both = found.where("b is not null").select("a", "b").unionByName(several.select(F.col("fp").alias("a"), F.col("fp").alias("b"))).distinct()
    big = several.where(F.col("n") > alike).select("fp")
    for side in ("a", "b"):
        both = both.join(big.select(F.col("fp").alias(side), F.lit(True).alias("big_" + side)), side, "left")
    both = stored(both, "near-both")
    few, many = both.where("big_a is null and big_b is null"), both.where("big_a or big_b").select("a", "b")
    node = own.select("fp", F.struct("node", "size", *WORDS).alias("x"))
    met = few.select("a", "b").join(node.withColumnsRenamed({"fp": "a"}), "a").join(node.withColumnsRenamed({"fp": "b", "x": "y"}), "b")
    fits = SHARE[1] * F.least("x.size", "y.size") >= SHARE[0] * F.greatest("x.size", "y.size")
    apart = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in WORDS), F.lit(0))
    met = met.where(fits & (apart <= WHOLE_DISTANCE)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    links = _verified(stored(met.where("a != b").distinct(), "near-pairs"), nodes, docs, shingle)

    crowds = stored(found.where("b is null").select("a", F.col("crowd").alias("b")).unionByName(many).distinct(), "near-crowded")
    if not crowds.isEmpty():
        named = components(crowds).withColumnRenamed("id", "fp")
        crowded = crowds.select(F.col("a").alias("fp")).distinct().unionByName(many.select(F.col("b").alias("fp"))).distinct().join(named, "fp", "left")
        members = own.select("node", "fp").join(crowded, "fp").select("node", "fp", F.coalesce("component", "fp").alias("crowd"))
        links = links.unionByName(_crowded_links(members, nodes, docs, distance, shingle))
    groups = stored(components(links), "near-components").select(F.col("id").alias("node"), "component")
    named = nodes.join(groups, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "node"), stored(named, "near-named")


def drop_near_copies(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, crowd: int = CROWD, alike: int = ALIKE) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near copies the one with the smallest doc_id.

    Of different texts under one doc_id each is judged by itself, and of one text twice under that doc_id one row
    stays. Rows with a null doc_id take no part and stay; null and empty texts are copies of one another.
    """
    rows, named = near_copies(docs, distance, shingle, crowd=crowd, alike=alike)
    least = named.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("x"))
    kept = stored(least.select("x.doc_id", "x.node"), "near-kept")
    counted = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(kept.groupBy("doc_id").agg(F.count("*").alias("stay")), "doc_id", "left")
    other = stored(counted.where("stay is null or n > 1"), "near-other")  # ids that go, or of which some rows may
    whole = docs.join(small(other.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    if other.where("stay is not null").isEmpty():
        return whole
    name = free_name(docs, "node")

    some = docs.join(small(other.where("stay is not null").select("doc_id")), "doc_id", "left_semi").withColumn(name, _node()("text"))
    some = some.join(small(kept.withColumnRenamed("node", name)), ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return whole.unionByName(some.select(*docs.columns))
