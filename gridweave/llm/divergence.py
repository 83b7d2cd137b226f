"""Source divergence audit: how the sources of each language differ in their use of its common terms.

Two passes over the texts. The first counts exactly how many documents of a language hold each term; terms held by
enough of them are kept. The second counts the occurrences of kept terms in each (lang, source) group by automata
over the terms with a delimiter on either side. The counts are sparse postings; from them come the distances of all
pairs of sources of a language, in tiles of terms and sources, and the terms that each source uses more than its language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import batches_of, stored, worker_held

#: Bytes of a text that stand outside terms become spaces, and A to Z small; all others stay.
_OWN = {c: c + 32 for c in range(65, 91)} | {c: c for c in range(97, 123)} | {c: c for c in range(128, 256)}
TABLE = bytes(_OWN.get(c, 32) for c in range(256))
#: Documents of a language that hold a kept term at least, and ranks of terms reported.
LEAST, TOP = 30, 50
#: Counts that a task gathers before it gives them on, and characters of the terms in the automata of one pass.
HELD, PASS_CHARS = 400_000, 4_000_000
#: Terms and sources of a tile, and texts that a Python function gets at once.
TILE_TERMS, TILE_SOURCES, TEXTS_AT_ONCE = 1_024, 256, 500
SCALE, PRIOR = 1_000_000_000, 5


def plain(text: bytes) -> bytes:
    """A text in UTF-8 as terms with spaces between and around them."""
    return b" %b " % text.translate(TABLE)


def _texts(docs: DataFrame) -> DataFrame:
    """lang, source and the text in UTF-8."""
    own = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*own).withColumn("text", F.col("text").cast("binary"))


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many documents of each language each term stands."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                own = held.setdefault(lang, Counter())
                size -= len(own)
                own.update(set(plain(text).split()))
                size += len(own)
                if size > HELD:
                    yield flushed(held)
                    size = 0
        if held:
            yield flushed(held)

    def flushed(held: dict[str, Counter]) -> pd.DataFrame:
        rows = [(lang, term, n) for lang, own in held.items() for term, n in own.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "term", "n"])

    parts = _texts(docs).select("lang", "text").mapInPandas(counted, "lang string, term binary, n long")
    return parts.groupBy("lang", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"))


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, id) of the terms that at least so many documents of the language hold; ids are unique."""
    kept = frequencies(docs).where(F.col("n") >= least).select("lang", "term")
    with batches_of(docs.sparkSession, TEXTS_AT_ONCE):
        return stored(kept.withColumn("id", F.monotonically_increasing_id()), "divergence-terms")


def _passes(kept: DataFrame, pass_chars: int) -> Iterator[list[tuple[str, str, int]]]:
    """The kept terms in parts of pass_chars characters or little more, for one pass over the documents each."""
    size = kept.agg(F.sum(F.length("term") + 2)).first()[0] or 0
    parts = 1 + size // pass_chars
    part = F.pmod(F.xxhash64("lang", "term"), F.lit(parts))
    for k in range(parts):
        rows = (kept if parts == 1 else kept.where(part == k)).select("lang", "term", "id").collect()
        if rows:
            yield [tuple(r) for r in rows]


def automata(terms: list[tuple[str, str, int]]) -> dict:
    """An automaton for each language that finds its terms with a space on either side, and gives their ids.

    It runs over bytes of UTF-8, each as a character: no byte of a term is a space, so nothing else is met.
    """
    import ahocorasick

    out: dict = {}
    for lang, term, number in terms:
        out.setdefault(lang, ahocorasick.Automaton()).add_word(f" {term} ".encode().decode("latin-1"), number)
    for own in out.values():
        own.make_automaton()
    return out


def _automata_of(sent) -> dict:
    """The automata over the terms of a broadcast, made once in each worker process and kept for its next task."""
    name, terms = sent.value
    return worker_held(("automata", name), lambda: automata(terms))


def postings(docs: DataFrame, kept: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(lang, source, id, n): occurrences of kept terms in each group, where there are any."""
    texts, found = _texts(docs), None
    for k, terms in enumerate(_passes(kept, pass_chars)):
        sent = docs.sparkSession.sparkContext.broadcast((f"{k}-{hash(terms[0])}-{len(terms)}", terms))

        def counted(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            machines, held, size = _automata_of(sent), {}, 0
            for batch in batches:
                for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                    if lang in machines:
                        own = held.setdefault((lang, source), Counter())
                        size -= len(own)
                        own.update([number for _, number in machines[lang].iter(plain(text).decode("latin-1"))])
                        size += len(own)
                    if size > HELD:
                        yield flushed(held)
                        size = 0
            if held:
                yield flushed(held)

        def flushed(held: dict) -> pd.DataFrame:
            rows = [(*group, number, n) for group, own in held.items() for number, n in own.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["lang", "source", "id", "n"])

        own = texts.mapInPandas(counted, "lang string, source string, id long, n long").groupBy("lang", "source", "id").agg(F.sum("n").alias("n"))
        with batches_of(docs.sparkSession, TEXTS_AT_ONCE):
            own = stored(own, "divergence-postings")
        found = own if found is None else found.unionByName(own)
    return texts.sparkSession.createDataFrame([], "lang string, source string, id long, n long") if found is None else found


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), in whole numbers of 38 digits."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(PRIOR).cast("decimal(1,0)"))
    below = total.cast("decimal(19,0)") + F.lit(PRIOR).cast("decimal(1,0)") * terms.cast("decimal(18,0)")
    return F.call_function("div", above, below) + 1


def _tiled(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b, value): sums of differences over the terms of one tile, for all its pairs of groups.

    rows: (group, block, low, high, terms, slot, p, base). A group has a row of slot null with its base, which holds where it
    has no posting of a term. Pairs are those of a group of block low with one of block high.
    """
    heads, own = rows[rows["slot"].isna()].sort_values("group"), rows[rows["slot"].notna()]
    groups, block = heads["group"].to_numpy(np.int64), heads["block"].to_numpy()
    p = np.repeat(heads["base"].to_numpy(np.int64)[:, None], int(rows["terms"].iat[0]), axis=1)
    p[np.searchsorted(groups, own["group"].to_numpy(np.int64)), own["slot"].to_numpy(np.int64)] = own["p"].to_numpy(np.int64)
    low, high = int(rows["low"].iat[0]), int(rows["high"].iat[0])
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    a, b, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left.tolist():
        js = right[right > i] if low == high else right
        a.append(np.full(len(js), groups[i]))
        b.append(groups[js])
        value.append(np.abs(p[js] - p[i]).sum(axis=1))
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "value": np.concatenate(value)})


def _slots(kept: DataFrame, tile_terms: int) -> tuple[DataFrame, DataFrame]:
    """(lang, id, tile, slot) of each kept term: tiles of a language hold at most tile_terms or so; and (lang, tile, terms)."""
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    tile = F.pmod(F.xxhash64("id"), F.ceil(F.col("terms") / tile_terms)).cast("int")
    slots = kept.join(sizes, "lang").withColumn("tile", tile)
    slots = slots.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "tile").orderBy("id")) - 1)
    slots = stored(slots.select("lang", "id", "tile", "slot"), "divergence-slots")
    return slots, slots.groupBy("lang", "tile").agg(F.count("*").cast("int").alias("terms"))


def pair_distances(groups: DataFrame, shares: DataFrame, kept: DataFrame, tile_terms: int = TILE_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(a, b, value) for each unordered pair of groups of a language, whose numbers are a and b.

    A task has the postings of at most two blocks of groups within one tile of terms; what it gives is a number for each pair
    of these groups, as the result has. A language without kept terms has one tile without terms.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile_sources).cast("int").alias("blocks"))
    own = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("group"), F.col("blocks")).cast("int"))
    slots, tiles = _slots(kept, tile_terms)
    bare = groups.select("lang").distinct().join(kept.select("lang").distinct(), "lang", "left_anti")
    tiles = tiles.unionByName(bare.select("lang", F.lit(0).alias("tile"), F.lit(0).alias("terms")))
    heads = own.join(tiles.select("lang", "tile"), "lang").select("lang", "group", "block", "blocks", "tile", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("p"), "base")
    cells = shares.select("group", "id", "p").join(own, "group").join(slots, ["lang", "id"])
    rows = heads.unionByName(cells.select(*heads.columns)).join(tiles, ["lang", "tile"])
    rows = (
        rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )
    sums = rows.groupBy("lang", "tile", "low", "high").applyInPandas(_tiled, "a long, b long, value long")
    return stored(sums.groupBy("a", "b").agg(F.sum("value").alias("value")), "divergence-pairs")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, pass_chars: int = PASS_CHARS, tile_terms: int = TILE_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each source to each other one of its language, and its own top terms.

    Null texts, languages and sources count as empty strings; repeated rows count each time. A (lang, source) group
    without terms is a source like any other. Ranks go by value, the largest first, then by item in bytes.
    """
    kept = kept_terms(docs, least)
    found = postings(docs, kept, pass_chars)
    groups = _texts(docs).groupBy("lang", "source").agg(F.count("*").alias("rows"))
    groups = stored(groups.select("lang", "source", F.monotonically_increasing_id().alias("group")), "divergence-groups")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = groups.join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    totals = totals.select("lang", "source", "group", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    totals = stored(totals.withColumn("base", base.cast("long")), "divergence-totals")
    shares = found.join(totals, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    shares = stored(shares.select("lang", "source", "group", "id", "n", "p"), "divergence-shares")
    pairs = pair_distances(totals.select("lang", "group", "base"), shares, kept, tile_terms, tile_sources)
    one, other = groups.select("lang", "source", F.col("group").alias("a")), groups.select(F.col("source").alias("item"), F.col("group").alias("b"))
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).join(one, "a").join(other, "b").select("lang", "source", "item", "value")

    whole = totals.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    of_lang = shares.groupBy("lang", "id").agg(F.sum("n").alias("n")).join(whole, "lang").withColumn("q", share(F.col("n"), F.col("total"), F.col("terms")))
    terms = shares.join(of_lang.select("lang", "id", "q"), ["lang", "id"]).where("p > q").join(kept, ["lang", "id"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by_rank))
    first = terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    return ranked.unionByName(first).select("lang", "source", "part", "item", "value", "rank")
