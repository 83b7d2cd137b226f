"""Benchmark decontamination by q-gram counting in diagonal bands, verified by banded alignment.

A benchmark text is cut into overlapping windows, each with an edit budget. By the q-gram lemma a document
region within k edits of a window of n characters shares at least n - q + 1 - k q of its q-grams, all within
k + 1 neighbouring diagonals. Shared q-grams are counted in bands of diagonals that overlap by that much;
bands that reach the bound are verified by aligning the window with the region. Long stretches that repeat a few
characters over and over, such as ruled lines, are cut to one length on both sides first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import few_at_a_time, small, sparing, stored

Q = 12
#: Characters of a window, and from one to the next: wherever WINDOW + STEP - 1 characters of a longer benchmark text
#: are taken from, a whole window is among them.
WINDOW, STEP = 160, 40
EDIT_SHARE = 0.07
#: Benchmark characters that one pass over the documents holds in memory, at some 50 bytes each.
PASS_CHARS = 2_000_000
#: Places of shared q-grams that are looked at together, each in up to five windows.
PLACES = 250_000
#: Periods of stretches that are cut, and to how many characters: short ones so that any phase is within the edit budget,
#: longer ones so that a whole window of any phase is left.
PERIODS, SHORT_PERIOD, SHORT_STRETCH, STRETCH = 32, 8, 64, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
FOUND = "text_key long, start long, end long, edits int"


def normal(text: str) -> str:
    """Lower case, and single spaces for white space."""
    return " ".join(text.lower().split())


def offsets(text: str) -> np.ndarray:
    """Where each character of normal(text) stands in text."""
    at, spaced = [], True
    for i, c in enumerate(text):
        if c.isspace():
            if not spaced:
                at.append(i)
            spaced = True
        else:
            at += [i] * len(c.lower())
            spaced = False
    return np.array(at, np.int64)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram, put together from those of 8 and 4 (or fewer) characters."""
    whole, done, level, width, power = None, 0, codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    rest = q
    while rest:
        if rest & 1:
            part = level[done:]
            if whole is None:
                whole = part
            else:
                n = min(len(whole), len(part))
                whole = whole[:n] * power + part[:n]
            done += width
        rest >>= 1
        if rest:
            level = level[:-width] * power + level[width:] if len(level) > width else level[:0]
            with np.errstate(over="ignore"):
                width, power = 2 * width, power * power
    n = max(0, len(codes) - q + 1)
    mixed = whole[:n]
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, `count` numbers for each."""
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def stretches(codes: np.ndarray, grams: np.ndarray) -> list[int]:
    """Periods, up to PERIODS, with which some stretch longer than SHORT_STRETCH may repeat."""
    if len(grams) <= PERIODS:
        return []
    ahead = np.lib.stride_tricks.sliding_window_view(grams, PERIODS + 1)[::PERIODS]
    return (np.flatnonzero((ahead[:, 1:] == ahead[:, :1]).any(axis=0)) + 1).tolist()


def _cut(codes: np.ndarray, period: int) -> np.ndarray:
    """Which characters stay when stretches of a period are cut to their first so many."""
    most = SHORT_STRETCH if period <= SHORT_PERIOD else STRETCH
    edges = np.flatnonzero(np.diff(np.r_[False, codes[period:] == codes[:-period], False].astype(np.int8)))
    begins, ends = edges[::2], edges[1::2] + period
    keep = np.ones(len(codes), bool)
    for a, b in zip(begins[ends - begins > most].tolist(), ends[ends - begins > most].tolist(), strict=True):
        keep[a + most : b] = False
    return keep


class Prepared:
    """A text in normal form: its codes without what is cut from repeating stretches, their q-grams, and where they stood.

    A stretch that repeats up to 8 characters counts as its first 64 characters, one that repeats up to 32 as its first 256.
    """

    def __init__(self, text: str | None):
        self.text = text or ""
        self.own = normal(self.text)
        self.codes = codes_of(self.own)
        self.grams = gram_hashes(self.codes)
        self.kept: np.ndarray | None = None
        for period in stretches(self.codes, self.grams):
            if len(self.codes) <= period:
                break
            keep = _cut(self.codes, period)
            if not keep.all():
                self.kept = (np.arange(len(keep)) if self.kept is None else self.kept)[keep]
                self.codes = self.codes[keep]
        if self.kept is not None:
            self.grams = gram_hashes(self.codes)
            self.own = self.codes.tobytes().decode("utf-32-le", "surrogatepass")
        self._at: np.ndarray | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Where characters start to end stand in the text as it came, with what was cut within PERIODS characters behind them."""
        if self._at is None:
            self._at = offsets(self.text)
        if end <= start or not len(self.codes):
            return 0, 0
        end = min(end, len(self.codes))
        if self.kept is None:
            return int(self._at[start]), int(self._at[end - 1]) + 1
        near = np.append(self.kept, len(self._at))[end - 1 : end + PERIODS]
        cut = np.flatnonzero(np.diff(near) > 1)
        last = int(near[cut[0] + 1]) - 1 if len(cut) else int(near[0])
        return int(self._at[self.kept[start]]), int(self._at[last]) + 1


def budget(length: int) -> int:
    """Edits allowed in a window, never so many that the q-gram bound falls below one."""
    return max(0, min(int(length * EDIT_SHARE), (length - Q) // Q))


def align(window: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the place in the region nearest to the window, None if over `most` edits.

    The region is a band of diagonals, so a row of the table reaches only `len(region) - len(window)`
    cells beyond its diagonal on either side.
    """
    n, m, wide = len(window), len(region), len(region) - len(window) + most
    if wide < 0:  # the region ends before the window could
        return None
    cost, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i in range(1, n + 1):
        lo, hi = max(0, i - 1 - most), min(m, i + wide)
        new, came = np.full(m + 1, 1 << 20, np.int64), np.zeros(m + 1, np.int64)
        cols = np.arange(max(lo, 1), hi + 1)
        across, down = cost[cols - 1] + (region[cols - 1] != window[i - 1]), cost[cols] + 1
        new[cols], came[cols] = np.minimum(across, down), np.where(across <= down, origin[cols - 1], origin[cols])
        if lo == 0:
            new[0], came[0] = i, 0
        seg = new[lo : hi + 1] - np.arange(lo, hi + 1)
        best = np.minimum.accumulate(seg)
        source = np.maximum.accumulate(np.where(seg == best, np.arange(len(seg)), 0))
        came[lo : hi + 1] = came[lo : hi + 1][source]
        new[lo : hi + 1] = best + np.arange(lo, hi + 1)
        cost, origin = new, came
    end = int(np.argmin(cost))
    return (int(cost[end]), int(origin[end]), end) if cost[end] <= most else None


class Index:
    """q-grams of benchmark windows, and the search of a document for them."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.windows: list[tuple[int | None, str, np.ndarray, int]] = []
        self.origin: list[tuple[int, int]] = []  # which text a window is from, and where it starts there
        self.texts: list[np.ndarray] = []
        grams, places, starts, chars = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
        for item, text in items:
            own = Prepared(text)
            text, codes = own.own, own.codes
            self.texts.append(codes)
            if len(text) < Q:
                continue
            for a in range(0, max(1, len(text) - WINDOW + STEP), STEP):
                a = min(a, max(0, len(text) - WINDOW))
                part = text[a : a + WINDOW]
                self.origin.append((len(self.texts) - 1, a))
                self.windows.append((item, part, codes[a : a + WINDOW], budget(len(part))))
                starts.append(chars + a)
            grams.append(own.grams)
            places.append(np.arange(chars, chars + len(grams[-1])))
            chars += len(text)
        hashes = np.concatenate(grams)
        order = np.argsort(hashes, kind="stable")
        # q-grams by hash, with their place in all texts one after another; and the first and last such place of each window
        self.hashes, self.place = hashes[order], np.concatenate(places)[order]
        self.first = np.array(starts, np.int64)
        self.last = self.first + np.array([len(w[1]) - Q for w in self.windows], np.int64)
        self.shift = np.uint64(64 - max(16, min(27, int(np.log2(len(hashes) + 1)) + 5)))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filter[(self.hashes >> self.shift).astype(np.int64)] = True
        self.budgets = np.array([w[3] for w in self.windows], np.int64)
        self.least = np.array([len(w[1]) - Q + 1 - w[3] * Q for w in self.windows], np.int64)

    def candidates(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, first diagonal, last diagonal) of each band that reaches the q-gram bound."""
        at = np.flatnonzero(self.filter[(grams >> self.shift).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        count = hi - lo
        if not count.any():
            return []
        at, lo, count = at[count > 0], lo[count > 0], count[count > 0]
        cuts = np.searchsorted(np.cumsum(count), np.arange(0, count.sum() + PLACES, PLACES))
        parts = [self._banded(at[a:b], lo[a:b], count[a:b]) for a, b in zip(cuts, [*cuts[1:].tolist(), len(at)], strict=True) if a < b]
        keys, size = parts[0]
        if len(parts) > 1:
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            size = np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)
        window, band = keys >> 34, (keys & ((1 << 34) - 1)) - (1 << 33)
        reached = size >= self.least[window]
        step = self.budgets[window] + 1
        return list(zip(window[reached].tolist(), (band * step)[reached].tolist(), ((band + 2) * step - 1)[reached].tolist(), strict=True))

    def _banded(self, at: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared q-grams counted by window and band of diagonals, for some of a document's q-grams."""
        place = self.place[runs(lo, count)]
        low, high = np.searchsorted(self.last, place, "left"), np.searchsorted(self.first, place, "right")
        window = runs(low, high - low)
        diagonal = np.repeat(np.repeat(at, count) - place, high - low) + self.first[window]
        band = diagonal // (self.budgets[window] + 1)
        return np.unique(np.concatenate([window, window]) * (1 << 34) + np.concatenate([band, band - 1]) + (1 << 33), return_counts=True)

    def verified(self, text: Prepared) -> Iterator[tuple[int, int, int, int]]:
        """(window, edits, start, end) of each place in a prepared text where a window is found, some more than once."""
        own, codes = text.own, text.codes
        if len(own) < Q or not self.windows:
            return
        for w, first, last in self.candidates(text.grams):
            _, part, window, most = self.windows[w]
            a, b = max(0, first - most), min(len(own), last + len(part) + most)
            at = own.find(part, a, b)
            if at < 0 and (hit := align(window, codes[a:b], most)):
                yield w, hit[0], a + hit[1], a + hit[2]
            while at >= 0:
                yield w, 0, at, at + len(part)
                at = own.find(part, at + 1, b)

    def holds(self, text: str | None) -> bool:
        """Whether a window is found in the text."""
        return next(self.verified(Prepared(text)), None) is not None

    def search(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, start, end, edits) for each region of the text that holds an item or part of it.

        A region is a chain of windows of one benchmark text that overlap or touch and follow one another as they do
        in that text; its edits are those to the part of the text that its windows cover. Of places of one window
        that overlap by more than half, those with fewer edits count, of equal ones the first. So a ruled line
        is one region, which spans all of it.
        """
        own = Prepared(text)
        chains: dict[int, list[list]] = {}
        ended: dict[int, list[list]] = {}
        for k, a, w, edits, start, end in sorted((self.origin[w][0], start, w, edits, start, end) for w, held in self._placed(own).items() for edits, start, end in held):
            origin, most = self.origin[w][1], self.windows[w][3]
            active = chains.setdefault(k, [])
            if any(chain[1] < start for chain in active):  # places come by their start: these chains are over
                ended.setdefault(k, []).extend(c for c in active if c[1] < start)
                active[:] = [c for c in active if c[1] >= start]
            for chain in reversed(active):  # [start, end, first and last place in the text, shift, budget of the last, edits, place, item]
                if origin > chain[7] and abs(start - origin - chain[4]) <= most + chain[5]:
                    chain[1], chain[3], chain[4], chain[5] = max(chain[1], end), origin + len(self.windows[w][1]), start - origin, most
                    chain[6], chain[7] = chain[6] + edits, origin
                    break
            else:
                active.append([start, end, origin, origin + len(self.windows[w][1]), start - origin, most, edits, origin, self.windows[w][0]])
        found = []
        for k, active in chains.items():
            for start, end, first, last, _, most, edits, _, item in sorted(ended.get(k, []) + active, key=lambda c: c[:2]):
                if edits and last - first > WINDOW:
                    hit = align(self.texts[k][first:last], own.codes[start:end], edits + 2 * most)
                    edits, start, end = (hit[0], start + hit[1], start + hit[2]) if hit else (edits, start, end)
                found.append((item, *own.span(start, end), edits))
        return list(dict.fromkeys(found))

    def _placed(self, own: Prepared) -> dict[int, list[tuple[int, int, int]]]:
        """(edits, start, end) of the places of each window, without those that lie for the most part on a better one."""
        places: dict[int, list[tuple[int, int, int]]] = {}
        for w, *place in sorted(set(self.verified(own))):
            edits, start, end = place
            held = places.setdefault(w, [])
            reach = len(self.windows[w][1]) + self.windows[w][3]
            near = held[bisect_left(held, (start - reach,)) : bisect_left(held, (end,))]
            if not any(2 * (min(end, e) - max(start, s)) > end - start for s, e, _ in near):
                insort(held, (start, end, edits))
        return {w: [(edits, start, end) for start, end, edits in held] for w, held in places.items()}


def _texts(benchmark: DataFrame) -> DataFrame:
    """(item_id, text_key, text) of the benchmark, each row once; equal texts have one key."""
    rows = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return stored(rows.distinct(), "benchmark")


def _passes(texts: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes over parts of the different texts, and whether there are several.

    A part has PASS_CHARS characters or little more, or is a single text, which is never split: what is found
    does not depend on the parts. The result of each of several passes is stored before the next index is made.
    """
    own = texts.select("text_key", "text").dropDuplicates(["text_key"])
    sizes = own.select("text_key", F.length("text").alias("chars"))
    parts, most = 1, sizes.agg(F.sum("chars")).first()[0] or 0
    while most > PASS_CHARS:
        parts *= 2
        part = F.pmod(F.col("text_key"), F.lit(parts)).alias("part")
        most = sizes.groupBy(part).agg(F.sum("chars").alias("chars"), F.count("*").alias("n")).agg(F.max(F.when(F.col("n") > 1, F.col("chars")))).first()[0] or 0
    for k in range(parts):
        part = own if parts == 1 else own.where(F.pmod(F.col("text_key"), F.lit(parts)) == k)
        rows = [(r["text_key"], r["text"]) for r in part.orderBy("text_key").collect()]
        if rows or parts == 1:
            yield Index(rows), parts > 1


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): each region of a document that holds a benchmark text or part of it.

    start and end count characters of the whole document. Null and empty texts on either side, and benchmark
    texts under 12 characters, match nothing; repeated rows of documents match each time, those of the benchmark
    once; null ids come back as null. Different texts of one item match each for itself.
    """
    texts, found = _texts(benchmark), None
    for index, several in _passes(texts):

        @sparing
        def searched(batches: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for hit in index.search(text)]
                yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype="Int64") for k, c in enumerate(("doc_id", "text_key", "start", "end", "edits"))})

        own = few_at_a_time(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(searched, "doc_id long, " + FOUND)
        own = stored(own, "benchmark-matches") if several else own
        found = own if found is None else found.unionByName(own)
    return found.join(small(texts.select("text_key", "item_id")), "text_key").select("doc_id", "item_id", "start", "end", "edits")


def _free(index: Index):
    @F.pandas_udf("boolean")
    @sparing
    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not index.holds(t) for t in texts], dtype=bool)

    return free


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark text, with all their columns."""
    for index, several in _passes(_texts(benchmark)):
        docs = few_at_a_time(docs).where(_free(index)(F.col("text")))
        docs = stored(docs, "decontaminated") if several else docs
    return docs
