"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document goes whole into the fullest window that
holds it. If none does, the fullest window is topped up with the document's head (unless its gap is within
the slack) and emitted, and the rest goes on to the next. At the end a partition merges its own windows,
and what is left over, one part-filled window a partition, is merged in rounds of bounded groups.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import few_at_a_time, sparing, stored
from gridweave.llm.tokens import encoder

WINDOW = 4096
OPEN_WINDOWS = 64
#: A gap this small is padded rather than filled by cutting a document.
SLACK = 4
#: Leftover windows that one task merges in a round.
MERGED = 128
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, left_over boolean, part long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

#: (doc_id, tokens before it in its document, tokens of the document, ids as 32-bit bytes)
Piece = tuple[int | None, int, int, bytes]


class Packer:
    """Packs pieces in the order they come; `emit` gets each finished window, a list of pieces."""

    def __init__(self, emit: Callable[[list[Piece]], None], window: int = WINDOW, most: int = OPEN_WINDOWS, slack: int = SLACK):
        self.emit, self.window, self.most, self.slack = emit, window, most, slack
        self.gaps: list[tuple[int, int]] = []  # (gap, number) of each open window, least gap first
        self.open: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, piece: Piece) -> None:
        doc, start, total, ids = piece
        ids = memoryview(ids)  # what is left of a long document is not copied for each window
        while len(ids) // 4 >= self.window:
            self.emit([(doc, start, total, bytes(ids[: 4 * self.window]))])
            start, ids = start + self.window, ids[4 * self.window :]
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.gaps, (n, -1))
            if at < len(self.gaps):
                gap, number = self.gaps.pop(at)
            elif len(self.open) < self.most:
                gap, number = self.window, self.made
                self.made += 1
                self.open[number] = []
            else:
                gap, number = self.gaps.pop(0)
                if gap <= self.slack:
                    self.emit(self.open.pop(number))
                    continue
                n = gap
            self.open[number].append((doc, start, total, bytes(ids[: 4 * n])))
            start, ids = start + n, ids[4 * n :]
            if gap == n:
                self.emit(self.open.pop(number))
            else:
                insort(self.gaps, (gap - n, number))

    def close(self) -> list[Piece]:
        """Merges the open windows, fullest first; returns the pieces of the one that stays part-filled."""
        left = [p for _, number in self.gaps for p in self.open[number]]
        self.open, self.gaps = {}, []
        held, room = [], self.window
        for doc, start, total, ids in left:
            while ids:
                n = min(room, len(ids) // 4)
                held.append((doc, start, total, ids[: 4 * n]))
                start, ids, room = start + n, ids[4 * n :], room - n
                if not room:
                    self.emit(held)
                    held, room = [], self.window
        return held


def by_powers(pieces: list[Piece], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Cuts the last window into sequences whose lengths are powers of two, so that none is padded."""
    pieces, left = list(pieces), sum(len(p[3]) // 4 for p in pieces)
    while left:
        size = min(window, 1 << (left.bit_length() - 1))
        left, own = left - size, []
        while size:
            doc, start, total, ids = pieces.pop(0)
            n = min(size, len(ids) // 4)
            own.append((doc, start, total, ids[: 4 * n]))
            if ids[4 * n :]:
                pieces.insert(0, (doc, start + n, total, ids[4 * n :]))
            size -= n
        yield own


class _Rows:
    """Rows of PIECES, gathered until there are enough for a batch."""

    def __init__(self, base: int, part: int, keep_ids: bool, batch: int = 5_000):
        self.base, self.part, self.keep_ids, self.batch, self.rows = base, part, keep_ids, batch, []

    def put(self, pieces: list[Piece], left_over: bool = False) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.base, offset, ids if self.keep_ids or left_over else None, left_over, self.part))
            offset += n
        self.base += 1

    def take(self, least: int) -> Iterator[pd.DataFrame]:
        if len(self.rows) >= max(1, least):
            got = pd.DataFrame(self.rows, columns=[*COLUMNS, "ids", "left_over", "part"])
            self.rows = []
            yield got.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens: one row for each piece.

    Columns: doc_id, start and length (in its document's ids, end id included), ids_crc32, doc_tokens,
    sequence_id, offset (in its sequence, gapless from 0) and, if kept, ids (32-bit little-endian).
    Null and empty texts are a lone end id. Repeated rows are packed each time; a null doc_id stays null.
    Sequences have 4092 tokens or more, save those that the very last window is cut into, whose lengths are
    powers of two. A document is cut if it is longer than a window or tops one up.
    """

    @sparing
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, part = encoder(tokenizer).ids, end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        rows = _Rows(part << 32, part, keep_ids)
        packer = Packer(rows.put)
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "") + end
                packer.add((None if pd.isna(doc) else int(doc), 0, len(ids) // 4, ids))
                yield from rows.take(rows.batch)
        if left := packer.close():
            rows.put(left, left_over=True)
        yield from rows.take(0)

    def merged(level: int, last: bool):
        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            whole = pd.concat(list(batches), ignore_index=True)
            for part, own in whole.sort_values(["part", "sequence_id", "offset"]).groupby(whole["part"] // MERGED):
                rows = _Rows((level << 56) | (int(part) << 32), int(part), keep_ids)
                packer = Packer(rows.put)
                for doc, start, total, ids in zip(own["doc_id"], own["start"], own["doc_tokens"], own["ids"], strict=True):
                    packer.add((None if pd.isna(doc) else int(doc), int(start), int(total), bytes(ids)))
                left = packer.close()
                for pieces in by_powers(left) if last else [left] if left else []:
                    rows.put(pieces, left_over=not last)
                yield from rows.take(0)

        @sparing
        def safe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [b for b in batches if len(b)]
            return merge(iter(held)) if held else iter(())

        return safe

    first = few_at_a_time(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(packed, PIECES)
    done, level = stored(first, "packed"), 0
    parts = 1 + (lambda most: -1 if most is None else most)(done.agg(F.max("part")).first()[0])
    whole, open_ = done.where("not left_over"), done.where("left_over")
    while parts:
        level, last = level + 1, parts <= MERGED
        parts = 0 if last else -(-parts // MERGED)
        dealt = open_.repartition(max(1, parts), F.floor(F.col("part") / MERGED))
        done = stored(dealt.mapInPandas(merged(level, last), PIECES), f"packed-{level}")
        whole, open_ = whole.unionByName(done.where("not left_over")), done.where("left_over")
    return whole.select(*COLUMNS, *(["ids"] if keep_ids else []))
