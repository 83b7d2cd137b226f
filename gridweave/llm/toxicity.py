"""Toxicity: a weighted finite-state grammar over clauses, with an insult lexicon learned from labels.

Each token is read as a symbol (insult, threat, target, negation, report, break or other). Four small
transducers are composed into one machine that rewrites the symbols of a clause: reported speech and
negation weaken what follows, a target next to an insult strengthens it, and a threat counts only with
a target. The sum of the weights of the clauses that match is a document's evidence; a logistic curve
fitted on labelled rows turns it into a score between 0 and 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import checkpointed, crc_fold, few_at_a_time, labelled_sample, sparing

OTHER, BREAK, NEGATION, REPORT, TARGET, THREAT, INSULT = range(7)
DIRECTED, NEGATED, REPORTED, MENACE = 7, 8, 9, 10

#: Function words of English, French, German and Spanish by the symbol they stand for.
WORDS = {
    NEGATION: "not no never isn't aren't wasn't don't doesn't ne pas jamais non nicht kein keine nie nunca jamás tampoco",
    REPORT: "said says wrote writes claimed quoted called heard dit disait écrit sagte schrieb gesagt dijo dice escribió",
    TARGET: "you your you're he she they them him her this these tu vous toi ils elles du ihr euch sie er tú usted ustedes ellos",
    THREAT: "kill hurt destroy beat burn shoot attack tuer frapper brûler töten schlagen verbrennen matar golpear quemar",
}
#: What a matched clause adds: a rewritten symbol's factor on the lexicon's weight, 0.0 for no match.
FACTOR = {INSULT: 1.0, DIRECTED: 1.25, NEGATED: 0.5, REPORTED: 0.6, MENACE: 1.0}
MENACE_WEIGHT = 0.5
#: Tokens that a negation reaches, and that may stand between a target and an insult or threat.
REACH = 3
#: Characters of a token that the cache keeps.
LONGEST = 48

SPLIT = re.compile(r"[.!?;:\n]+|[^\s.!?;:]+")
EDGE = "\"'()[]{}<>,*#$%&|«»“”„…¡¿-_"


def _reporting(state: int, symbol: int) -> tuple[int, int]:
    """After a verb of saying, insults are reported until the clause ends."""
    if symbol in (BREAK, REPORT):
        return int(symbol == REPORT), symbol
    return state, REPORTED if state and symbol == INSULT else symbol


def _negating(state: int, symbol: int) -> tuple[int, int]:
    """An insult within reach of a negation is negated; what is reported stays so."""
    if symbol in (BREAK, NEGATION):
        return (REACH if symbol == NEGATION else 0), symbol
    return max(0, state - 1), NEGATED if state and symbol == INSULT else symbol


def _targeting(state: int, symbol: int) -> tuple[int, int]:
    """An insult within reach of a target is directed at it."""
    if symbol in (BREAK, TARGET):
        return (REACH if symbol == TARGET else 0), symbol
    return max(0, state - 1), DIRECTED if state and symbol == INSULT else symbol


def _threatening(state: int, symbol: int) -> tuple[int, int]:
    """A threat followed by a target within reach is a menace."""
    if symbol in (BREAK, THREAT):
        return (REACH if symbol == THREAT else 0), symbol
    if state and symbol == TARGET:
        return 0, MENACE
    return max(0, state - 1), symbol


CASCADE = (_reporting, _negating, _targeting, _threatening)


class Machine:
    """The composition of the transducers; a composed state is made when it is first reached."""

    def __init__(self, parts=CASCADE):
        self.parts, self.start, self.arcs = parts, (0,) * len(parts), {}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            after, out = [], symbol
            for part, own in zip(self.parts, state, strict=True):
                own, out = part(own, out)
                after.append(own)
            arc = self.arcs[state, symbol] = (tuple(after), out)
        return arc


class Grammar:
    """Scores whole texts with a lexicon of words and prefixes (those end in *) and their weights."""

    def __init__(self, lexicon: dict[str, float], reach_cache: int = 100_000):
        self.lexicon = lexicon
        self.lengths = sorted({len(k) - 1 for k in lexicon if k[-1:] == "*"})
        self.fixed = {w: s for s, words in WORDS.items() for w in words.split()}
        self.machine, self.seen, self.most = Machine(), {}, reach_cache

    def weight(self, token: str) -> float:
        """The weight of an insult, else 0; kept for the next time."""
        got = self.seen.get(token)
        if got is None:
            word = token.strip(EDGE)
            keys = [word, *(word[:n] + "*" for n in self.lengths if len(word) >= n)]
            got = max((self.lexicon.get(k, 0.0) for k in keys), default=0.0)
            if len(token) <= LONGEST:
                if len(self.seen) >= self.most:
                    self.seen.clear()
                self.seen[token] = got
        return got

    def clauses(self, text: str) -> list[tuple[float, list[str]]]:
        """Weight and tokens of each clause that matches."""
        found, tokens, total, state = [], [], 0.0, self.machine.start
        for token in SPLIT.findall(text.lower()):
            if token[0] in ".!?;:\n":
                if total:
                    found.append((total, tokens))
                state, tokens, total = self.machine.step(state, BREAK)[0], [], 0.0
                continue
            tokens.append(token)
            word = token.strip(EDGE)
            own = self.weight(token)
            state, out = self.machine.step(state, INSULT if own else self.fixed.get(word, OTHER))
            if factor := FACTOR.get(out):
                total += factor * (MENACE_WEIGHT if out == MENACE else own)
        if total:
            found.append((total, tokens))
        return found

    def evidence(self, text: str) -> float:
        """The sum over all clauses. Texts without any insult or threat skip the machine."""
        tokens = SPLIT.findall(text.lower())
        if not any(map(self.weight, tokens)) and not any(t.strip(EDGE) in THREATS for t in tokens):
            return 0.0
        return sum(w for w, _ in self.clauses(text))


THREATS = frozenset(WORDS[THREAT].split())


#: Lengths of the prefixes that may be entries; a prefix goes if a longer entry has this share of its toxic texts.
PREFIXES = (4, 5, 6)
SAME = 0.9


def _keys(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if len(word) >= 3 else []


def learn_lexicon(sample: DataFrame, min_contexts: int = 4, max_entries: int = 5_000) -> dict[str, float]:
    """Words and prefixes that toxic texts of the sample use and clean ones do not, with weights 0 to 1.

    Evidence for an entry is the number of different (word before, word after) pairs around it, so that
    copies of one toxic text do not make all its words entries. Of a word and its prefixes, the longest that
    has nearly all their toxic texts stays. At most max_entries reach the driver.
    """

    @sparing
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = {0: Counter(), 1: Counter()}
            around = defaultdict(set)
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = [t.strip(EDGE + ".!?;:") for t in text.lower().split()]
                if label:
                    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                        for key in _keys(word):
                            around[key].add(f"{before} {after}")
                texts[label].update({key for word in set(words) for key in _keys(word)})
            rows = [(k, c, 0, 0) for k, pairs in around.items() for c in pairs]
            rows += [(k, None, texts[1][k], texts[0][k]) for k in texts[0].keys() | texts[1].keys()]
            yield pd.DataFrame(rows, columns=["entry", "context", "toxic", "clean"])

    counts = (
        sample.mapInPandas(counted, "entry string, context string, toxic long, clean long")
        .groupBy("entry", "context").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .groupBy("entry").agg(F.count("context").alias("contexts"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    sizes = sample.groupBy("label").count().collect()
    toxic, clean = (next((r["count"] for r in sizes if r["label"] == k), 0) for k in (1, 0))
    if not toxic:
        return {}
    least = max(min_contexts, toxic // 100)
    odds = (F.col("toxic") + 0.5) / (toxic + 1.0) / ((F.col("clean") + 0.5) / (clean + 1.0))
    rows = counts.where((F.col("contexts") >= least) & (F.col("toxic") >= 3)).withColumn("odds", odds).where("odds >= 12").orderBy(F.desc("odds"), "entry").limit(max_entries).collect()
    texts = {r["entry"]: r["toxic"] for r in rows}
    wide = {p for e, n in texts.items() for k in PREFIXES if len(e) > k and (p := e[:k] + "*") != e and n >= SAME * texts.get(p, math.inf)}
    return {r["entry"]: min(1.0, math.log(r["odds"]) / math.log(100.0)) for r in rows if r["entry"] not in wide}


def fit_curve(evidence: np.ndarray, label: np.ndarray, rounds: int = 3_000) -> tuple[float, float]:
    """Slope and offset of the logistic curve over log1p(evidence); both classes weigh the same.

    Each step minimises a quadratic bound on the penalised loss, so it never diverges on separable rows.
    """
    x, y = np.log1p(np.asarray(evidence, float)), np.asarray(label, float)
    if len(y) == 0 or y.min() == y.max():
        return 8.0, -4.0
    w, design = np.zeros(2), np.column_stack([x, np.ones_like(x)])
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    ridge = 1e-4 * np.eye(2)
    bound = np.linalg.inv((design * share[:, None]).T @ design / 4 + ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w -= bound @ (design.T @ ((p - y) * share) + ridge @ w)
    return max(float(w[0]), 0.0), float(w[1])


def fit(sample: DataFrame) -> tuple[dict[str, float], float, float]:
    """Lexicon, slope and offset from (text, label) rows of a bounded sample."""
    lexicon = learn_lexicon(sample)

    @sparing
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon)
        for batch in batches:
            yield pd.DataFrame({"evidence": [grammar.evidence(t) for t in batch["text"]], "label": batch["label"]})

    got = sample.mapInPandas(measured, "evidence double, label int").toPandas()
    return lexicon, *fit_curve(got["evidence"].to_numpy(), got["label"].to_numpy())


def score(docs: DataFrame, model: tuple[dict[str, float], float, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of docs, and each whole text's score; null texts count as empty, and a column named `out` is replaced."""
    lexicon, slope, offset = model

    @F.pandas_udf("double")
    @sparing
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(lexicon)
        for texts in batches:
            raw = np.log1p([grammar.evidence(t or "") for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(slope * raw + offset, -30, 30))))

    return few_at_a_time(docs).withColumn(out, scored(F.col(text_col)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_labelled: int = 8_000):
    """Fits on at most max_labelled labelled rows outside the held-out fold of ids."""
    sample = labelled_sample(few_at_a_time(docs), labels, "toxic", crc_fold("doc_id", folds) != held_out, max_labelled)
    return fit(checkpointed(sample.repartition(max(4, docs.sparkSession.sparkContext.defaultParallelism))))
