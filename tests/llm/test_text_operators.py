"""Classifiers, chat collapse, decontamination and SimHash on small tables, against plain versions."""

import os
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridweave.llm import chat, common, decontaminate, quality, queries, simhash, toxicity

DOCS = "doc_id long, text string, label string, score double"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(texts)], DOCS)


def plain_components(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


# ---- toxicity

def test_grammar_reads_clauses():
    g = toxicity.Grammar({"stupid": 1.0, "tras*": 1.0})
    plain, aimed = g.evidence("a stupid thing"), g.evidence("you are stupid")
    denied, told = g.evidence("this is not stupid"), g.evidence("someone said it was stupid")
    assert aimed > plain > told > 0 and plain > denied > 0
    assert g.evidence("trashy. TRASH!") == pytest.approx(2 * plain)
    assert g.evidence("she said hello. stupid") == plain  # the report ends with its clause
    assert g.evidence("I will kill you") > 0 and g.evidence("kill the process") == 0
    assert g.evidence("") == 0


def test_evidence_is_the_sum_over_clauses():
    pick, found = random.Random(3), 0
    grammar = toxicity.Grammar({"moron": 0.8, "idiot": 0.6, "scum*": 0.7})
    for text in ("you moron; go away", "idiot: leave", "I will *kill* you", "(kill you)", "scummy;;"):
        assert grammar.evidence(text) == sum(w for w, _ in grammar.clauses(text)) > 0, text
    for _ in range(3_000):
        words = pick.choices(["moron", "Idiot", "scummy", "kill", "burn", "you", "not", "said", "a", "fine"], k=pick.randint(1, 3))
        text = "".join(w + "".join(pick.choices(" \n.!?;:*(),-_\"", k=pick.randint(1, 3))) for w in words)
        assert grammar.evidence(text) == sum(w for w, _ in grammar.clauses(text)), text
        found += grammar.evidence(text) > 0
    assert found > 1_000


def test_composed_machine_is_the_transducers_in_turn():
    pick = random.Random(1)
    for _ in range(300):
        symbols = [pick.randrange(7) for _ in range(pick.randint(1, 20))]
        out = symbols
        for part in toxicity.CASCADE:
            state, now = 0, []
            for symbol in out:
                state, got = part(state, symbol)
                now.append(got)
            out = now
        machine = toxicity.Machine()
        state, seen = machine.start, []
        for symbol in symbols:
            state, got = machine.step(state, symbol)
            seen.append(got)
        assert seen == out


def test_toxicity_learns_and_holds_out(spark):
    pick = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    texts, toxic = [], []
    for i in range(240):
        own = [pick.choice(words) for _ in range(40)]
        if i % 3 == 0:
            own[pick.randrange(40)] = own[pick.randrange(40)] = "zorg" + pick.choice(["ish", "ful", ""])
        texts.append(" ".join(own))
        toxic.append(int(i % 3 == 0))
    docs = docs_of(spark, [*texts, "", None])
    labels = spark.createDataFrame([*enumerate(toxic), (240, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(t) for i, t in enumerate(toxic))
    assert got[240] == got[241] < 0.7


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["score"] < 0.7 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


# ---- quality

def test_quality_ranks_junk_last(spark):
    pick = random.Random(2)
    words = [f"{a}{b}" for a in ("ta", "ro", "mi", "ne") for b in ("lon", "ter", "sa", "vik", "dus")]
    good = [" ".join(pick.choice(words) for _ in range(60)).capitalize() + "." for _ in range(120)]
    bad = ["### ".join(pick.choice(words) for _ in range(60)) for _ in range(40)]
    docs = docs_of(spark, [*good, *bad, "", None, "y " * 50_000])
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(160)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels)).select("doc_id", "score")
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert all((got[i] >= quality.CUT) == (i < 120) for i in range(160))
    assert got[160] == got[161] and all(0 <= s <= 1 for s in got.values())
    assert quality.keep_above(scored, 0.5).count() >= 82


def test_quality_fits_the_pair_loss():
    pick = np.random.default_rng(3)
    x, label = pick.normal(size=(60, 4)), np.arange(60) % 2
    x[label == 1, 0] += 1.0
    own = quality.fit(x, label, pairs=4_000, ridge=0.05)
    z, w = (x - x.mean(0)) / (x.std(0) + 1e-6), np.zeros(4)
    good, bad = z[label == 1], z[label == 0]
    d = (good[:, None, :] - bad[None, :, :]).reshape(-1, 4)  # all pairs
    for _ in range(4_000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 0.05 * w)
    assert np.abs(own["w"] - w).max() < 0.1


def test_quality_cut_is_a_quantile():
    cut = quality._cut(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1]))
    assert 1 < cut["cut"] < 2 and cut["slope"] > 0


def test_quality_with_one_label_only(spark):
    docs = docs_of(spark, ["fine words here", "more of them"])
    model = quality.train(docs, spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int"), folds=10**6, held_out=-1)
    assert all(r["score"] >= quality.CUT for r in quality.score(docs, model).collect())


# ---- chat

def rendered(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}\n" for r, t in turns)


def test_chat_keeps_maximal_conversations(spark):
    talks = {
        1: [("user", "hi"), ("bot", "hello")],
        2: [("user", "hi"), ("bot", "hello"), ("user", "bye")],
        3: [("user", "hi"), ("bot", "hello"), ("user", "bye")],
        4: [("user", "hi"), ("bot", "other")],
        5: [("user", None), (None, "")],
        6: [("user", "hi")] + [("user", str(k)) for k in range(1200)],
    }
    rows = [(c, k, r, t, "extra") for c, own in talks.items() for k, (r, t) in enumerate(own)]
    rows += [rows[0], (None, 0, "user", "lost", "extra")]
    got = chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string"))
    whole = {}
    for r in got.orderBy("conv_id", "part").collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["rendered"]
    assert whole == {c: rendered(talks[c]) for c in (2, 4, 5, 6)}


def test_chat_cuts_turns_of_one_number(spark):
    rows = [(1, None, "user", f"{k:05d}") for k in range(1_300)] + [(2, 0, None, None), (2, 0, "", "")]
    got = {(r["conv_id"], r["piece"]): r for r in chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, k]["turns"] for k in range(3)] == [512, 512, 276] and got[2, 0]["turns"] == 1
    assert "".join(got[1, k]["rendered"] for k in range(3)) == "".join(f"<|user|>\n{k:05d}\n" for k in range(1_300))


def test_chat_without_rows(spark):
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- decontamination

def plain_distance(a, b):
    """Fewest edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_hashes_tell_grams_apart():
    codes = decontaminate.codes_of("abcabcabcabcabcx" * 3)
    hashes, text = decontaminate.gram_hashes(codes), "abcabcabcabcabcx" * 3
    grams = [text[i : i + decontaminate.Q] for i in range(len(text) - decontaminate.Q + 1)]
    assert len(hashes) == len(grams) and len(set(hashes.tolist())) == len(set(grams))
    assert all((hashes[i] == hashes[j]) == (grams[i] == grams[j]) for i in range(20) for j in range(20))


@pytest.mark.parametrize("seed", range(4))
def test_alignment_is_exact(seed):
    pick = random.Random(seed)
    for _ in range(60):
        own = [pick.choice("abcd") for _ in range(pick.randint(12, 40))]
        other = own[:]
        for _ in range(pick.randint(0, 5)):
            k = pick.randrange(len(other))
            other[k : k + pick.randint(0, 1)] = pick.choices("abcd", k=pick.randint(0, 2))
        region = pick.choices("abcd", k=pick.randint(0, 3)) + other + pick.choices("abcd", k=pick.randint(0, 3))
        best = plain_distance(own, region)
        a, b = (np.array([ord(c) for c in x]) for x in (own, region))
        # any start is within the band when the region is at most this much longer
        got = decontaminate.align(a, b, 6)
        assert got is None if best > 6 else got[0] == best and plain_distance(own, region[got[1] : got[2]]) == best
    assert decontaminate.align(np.arange(30), np.arange(5), 3) is None


def test_decontamination_finds_what_a_plain_search_finds(spark):
    pick = random.Random(5)
    syllables = ["ta", "ro", "mi", "ne", "lon", "ter", "sa", "vik", "dus", "kel"]
    speak = lambda n: " ".join("".join(pick.choices(syllables, k=pick.randint(1, 4))) for _ in range(n))
    items = [(k, speak(30)) for k in range(6)] + [(6, None), (7, ""), (8, "short"), (None, speak(25))]

    def edited(text, edits):
        for _ in range(edits):
            k = pick.randrange(len(text))
            text = text[:k] + pick.choice("xyz") + text[k + 1 :]
        return text

    texts = [speak(80) for _ in range(10)]
    texts += [speak(20) + " " + items[k][1].upper().replace(" ", "\n  ") + " " + speak(9) for k in range(4)]
    texts += [speak(20) + " " + edited(items[k][1], 5) + " " + speak(9) for k in range(4)]
    texts += [items[9][1], None, "", speak(20_000) + " " + items[5][1]]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(10 + k, k) for k in range(4)} | {(14 + k, k) for k in range(4)} | {(18, None), (21, 5)}
    for (d, k), r in got.items():
        held = decontaminate.normal(texts[d][r["start"] : r["end"]])
        item = decontaminate.normal(dict(items)[k])
        assert plain_distance(held, item) == r["edits"] <= decontaminate.budget(decontaminate.WINDOW)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [*range(10), 19, 20]
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.matches(docs.limit(0), bench).count() == 0



@pytest.mark.parametrize("seed", range(3))
def test_bands_miss_no_window_within_its_budget(seed, monkeypatch):
    monkeypatch.setattr(decontaminate, "PLACES", 50)
    pick = random.Random(seed)
    items = ["".join(pick.choices("abcd ", k=n)) for n in (30, 60, 110)] + ["-" * 40]
    index = decontaminate.Index(list(enumerate(items)))
    for _ in range(25):
        part = pick.choice(items)
        own = list(part)
        for _ in range(pick.randint(0, 9)):
            k = pick.randrange(len(own))
            own[k : k + 1] = pick.choices("abcd", k=pick.randint(0, 2))
        text = decontaminate.normal("".join(pick.choices("abcd ", k=40)) + "".join(own) + "".join(pick.choices("abcd -", k=40)))
        want = {w for w, (_, window, _, most) in enumerate(index.windows) if plain_distance(window, text) <= most}
        assert {w for w, *_ in index.verified(decontaminate.Prepared(text))} == want


def test_every_part_as_long_as_a_window_and_a_step_is_found():
    pick = random.Random(11)
    item = "".join(pick.choices("abcdefgh ", k=700)).replace("  ", " x").strip()
    index, least = decontaminate.Index([(1, "too short"), (3, item), (4, "another text of the benchmark")]), decontaminate.WINDOW + decontaminate.STEP - 1
    for a in range(len(item) - least + 1):
        text = f"ahead {item[a : a + least]} behind"
        (found, start, end, edits), = index.search(text)  # windows that reach a few characters over either end are found too
        assert found == 3 and edits <= 3 * decontaminate.budget(decontaminate.WINDOW) and end - start >= decontaminate.WINDOW
        assert any(item[k : k + decontaminate.WINDOW] in text[start:end] for k in range(a, a + least))


@pytest.mark.parametrize("unit", ["-", "=-", "* ", "abcdefg", "twelve char.", "a stretch of thirty-two letters:"])
def test_repeating_stretches_are_one_region_in_linear_time(unit):
    for left, right in ((400, 4_000), (2_000, 20_000), (20_000, 80_000)):
        index = decontaminate.Index([(1, unit * (left // len(unit)))])
        rule = (unit * (right // len(unit)))[3:]
        begin = time.perf_counter()
        found = index.search(f"Some words. {rule} More words")
        spent = time.perf_counter() - begin
        assert len({f[:3] for f in found}) == len(found) and spent < 2
        assert min(s for _, s, *_ in found) <= 12 + 4 + len(unit) and max(e for *_, e, _ in found) >= 12 + len(rule) - 40
        if len(unit) <= decontaminate.SHORT_PERIOD:
            assert len(found) == 1
        assert index.holds(rule) and not index.holds("Some words. More words, and none of them a rule")


def test_a_text_around_a_ruled_line_is_found_whole():
    text = "What is the name of it?\n" + "-" * 300 + "\nThe name of it is known to no one, said the other one."
    index = decontaminate.Index([(4, text)])
    own = f"Before. {text} After, more of it."
    assert [f[:3] for f in index.search(own)] == [(4, own.index(text), own.index(text) + len(text))]


def test_many_copies_of_a_passage_take_time_in_proportion():
    pick = random.Random(12)
    item = "".join(pick.choices("abcdefgh ", k=390)).replace("  ", " x").strip()
    index, spent = decontaminate.Index([(3, item)]), []
    for copies in (50, 1_000):
        text = " and then ".join([item] * copies)
        begin = time.perf_counter()
        found = index.search(text)
        spent.append((time.perf_counter() - begin) / copies)
        assert len(found) == copies and all(text[s:e] == item and not edits for _, s, e, edits in found)
    assert spent[1] < 4 * spent[0] + 0.001


def test_offsets_lead_back_to_the_text_as_it_came():
    pick = random.Random(13)
    for _ in range(300):
        text = "".join(pick.choice(["a", "B", " ", "  ", "\n", "İ", "ß", "-" * pick.randint(1, 200), "=-" * 90, "word"]) for _ in range(pick.randint(0, 12)))
        own = decontaminate.Prepared(text)
        assert len(own.own) == len(own.codes) <= len(decontaminate.normal(text))
        for _ in range(5):
            a, b = sorted((pick.randint(0, len(own.own)), pick.randint(0, len(own.own))))
            start, end = own.span(a, b)
            assert 0 <= start <= end <= len(text)
            assert own.own[a:b].strip() in decontaminate.normal(text[start:end]) or own.kept is not None or a == b or "İ" in text


def test_decontamination_does_not_depend_on_passes(spark, monkeypatch):
    speak = lambda n, seed: " ".join(f"w{random.Random(seed * 1000 + k).randrange(10**6)}" for k in range(n))
    one, two, three = speak(9, 1), speak(11, 2), speak(50, 3)
    bench = spark.createDataFrame([(1, one), (1, two), (None, two), (None, three), (1, one)], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"{one} x y {two} {speak(5, 4)} {three}"), (8, two), (8, two), (None, one), (9, "-" * 5_000)], "doc_id long, text string")
    found = []
    for chars in (20, 60, 100, 2_000_000):
        monkeypatch.setattr(decontaminate, "PASS_CHARS", chars)
        found.append(sorted((r["doc_id"] or -1, r["item_id"] or -1, r["start"], r["end"], r["edits"]) for r in decontaminate.matches(docs, bench).collect()))
        assert [r["text"] for r in decontaminate.clean(docs, bench).collect()] == ["-" * 5_000]
    assert all(f == found[0] for f in found) and len(found[0]) == 4 + 4 + 1


def test_decontamination_gives_every_region_whole(spark):
    pick = random.Random(9)
    speak = lambda n: " ".join("".join(pick.choices(["ta", "ro", "mi", "lon", "ter", "vik", "dus"], k=pick.randint(1, 4))) for _ in range(n))
    long, short = speak(70), speak(8)
    late = long[:150] + "#" + long[151:300] + "#" + long[301:]
    texts = [f"{speak(20)} {long} {speak(20)}", f"{short} {speak(15)} {short} {speak(3)}", f"{speak(5)} {late} {speak(30)} {long.upper()}", f"{long} {long}"]
    wanted = [[(1, texts[0].index(long), len(long), 0)], [(2, 0, len(short), 0), (2, texts[1].rindex(short), len(short), 0)]]
    wanted += [[(1, texts[2].index(late), len(late), 2), (1, texts[2].rindex(long.upper()), len(long), 0)], [(1, 0, len(long), 0), (1, len(long) + 1, len(long), 0)]]
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    got = decontaminate.matches(docs_of(spark, texts), bench).collect()
    for d in range(4):
        assert sorted((r["item_id"], r["start"], r["end"] - r["start"], r["edits"]) for r in got if r["doc_id"] == d) == wanted[d]
    assert decontaminate.clean(docs_of(spark, texts), bench).count() == 0


# ---- simhash

def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in low).split(" ") if w]
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = ["A b C d e f", "a", "", None, " \t\n", "É é İ x y z w", "a b c d " * 300, "one two three four"]
    got = {r["doc_id"]: r["fingerprint"] & (1 << 64) - 1 for r in simhash.fingerprints(docs_of(spark, texts)).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    native = spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0]
    assert got[7] == native & (1 << 64) - 1


def near_prints(seed, centres=12, each=40):
    pick = random.Random(seed)
    found = set()
    for _ in range(centres):
        base = pick.getrandbits(64)
        for _ in range(each):
            own = base
            for _ in range(pick.randint(0, 8)):
                own ^= 1 << pick.randrange(64)
            found.add(own)
    return np.array(sorted(found), np.uint64).view(np.int64)


@pytest.mark.parametrize("distance", [0, 1, 4, 5, 8, 13])
def test_near_fingerprints_meet(distance):
    pick = random.Random(distance)
    base = np.array([pick.getrandbits(64) for _ in range(40)], np.uint64)
    other = np.array([int(x) ^ sum(1 << k for k in pick.sample(range(64), distance)) for x in base], np.uint64)
    for segments in (2, 3, 4) if distance < 8 else (3, 4):
        keys = [{}, {}]
        for held, prints in zip(keys, (base, other), strict=True):
            for _, at, key in simhash.filed_under([prints], simhash.plan_segments(distance, segments)):
                for i, k in zip(at.tolist(), key.tolist(), strict=True):
                    held.setdefault(i, set()).add(k)
        assert all(keys[0][i] & keys[1][i] for i in range(40))


def near_by(prints, distance):
    bits = [int(x) for x in prints.view(np.uint64)]
    return [(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if (bits[i] ^ bits[j]).bit_count() <= distance]


def same_groups(found, place, pairs):
    own, groups = plain_components(len(place), pairs), {}
    for r in found.collect():
        groups.setdefault(r["component"], set()).add(place[r["id"]])
    members = {own[i]: {j for j in place.values() if own[j] == own[i]} for pair in pairs for i in pair}
    return sorted(map(sorted, groups.values())) == sorted(map(sorted, members.values()))


@pytest.mark.parametrize(("segments", "tile_rows"), [(3, 8), (2, 20_000)])
def test_linked_fingerprints(spark, segments, tile_rows):
    prints = near_prints(segments, centres=6)
    table = spark.createDataFrame([(int(p),) for p in prints], "fp long").repartition(3)
    place = {int(p): i for i, p in enumerate(prints)}
    want = near_by(prints, 4)
    got = {(place[r["a"]], place[r["b"]]) for r in simhash.candidates(table, 4, simhash.plan_segments(4, segments), tile_rows=tile_rows, crowd=10**6).collect()}
    assert got == set(want)
    assert same_groups(simhash.grouped_prints(table, 4, segments, tile_rows), place, want)


@pytest.mark.parametrize(("few", "slots"), [(4, 1 << 20), (256, 1)])
def test_crowded_values_are_left_to_crowds(spark, monkeypatch, few, slots):
    monkeypatch.setattr(simhash, "SLOTS", slots)
    prints = near_prints(5, centres=2, each=120)
    want = near_by(prints, 6)
    table = spark.createDataFrame([(int(p),) for p in prints], "fp long").repartition(2)
    place = {int(p): i for i, p in enumerate(prints)}
    found = simhash.candidates(table, 6, simhash.plan_segments(6, 3), tile_rows=60, few=few, crowd=2).collect()
    pairs = [(place[r["a"]], place[r["b"]]) for r in found if r["b"] is not None]
    crowd = plain_components(len(prints), [(place[r["a"]], place[r["crowd"]]) for r in found if r["b"] is None])
    left = {place[r["a"]] for r in found if r["b"] is None}
    assert len(set(pairs)) == len(pairs) and set(pairs) < set(want)  # each once
    assert all(p in pairs or (set(p) <= left and crowd[p[0]] == crowd[p[1]]) for p in want)
    assert same_groups(simhash.grouped_prints(table, 6, 3, 60, few), place, want)


@pytest.mark.parametrize(("crowd", "alike"), [(4, 8), (0, 2)])
def test_near_copies_are_those_of_a_plain_search(spark, crowd, alike):
    pick = random.Random(crowd)
    base = [f"w{pick.randrange(10**6)}" for _ in range(120)]
    line = [f"c{k}" for k in range(12)]
    texts = [" ".join(base), " ".join(base[:-1] + [base[-1], "."]), " ".join(base[:60] + ["other"] + base[61:]).upper()]
    for _ in range(40):  # a common line in texts of their own, and copies with one to four words changed
        own = [f"w{pick.randrange(10**6)}" for _ in range(pick.choice([8, 40, 90]))] + line
        texts.append(" ".join(own))
        for n in range(1, 5):
            for at in pick.sample(range(len(own)), n):
                own[at] = f"x{pick.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += ["a b c d e " * 50 + f"x{k} y z" for k in range(6)]  # one fingerprint, and alike
    texts += ["a b c d e f g " * 40 + " ".join(f"{k}v{n}" for n in range(30)) for k in range(6)]  # one fingerprint at most, not alike
    texts += ["", None, "a b", "A  b", " ".join(line), " ".join(line[1:])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else {()} for t in texts]
    alike_pairs = [(i, j) for j in range(len(texts)) for i in range(j) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    lanes = [[x & (1 << 64) - 1 for x in simhash.lanes_of(simhash.shingles(simhash.words(t), 5))] for t in texts]

    def met(i, j):
        bits = [(x ^ y) for x, y in zip(lanes[i], lanes[j], strict=True)]
        near = bits[0].bit_count() <= simhash.DISTANCE and sum(x.bit_count() for x in bits) <= simhash.WHOLE_DISTANCE
        segments = [(bits[k // 4] >> 14 * (k % 4) & (1 << 14) - 1).bit_count() for k in range(20)]
        return near and any(segments[k] + segments[(k + 1) % 20] <= 2 for k in range(20))

    pairs = [(i, j) for i, j in alike_pairs if sets[i] == sets[j] or met(i, j)]
    assert len(pairs) >= 0.95 * len(alike_pairs) and len(pairs) > 40
    top = plain_components(len(texts), pairs)
    kept = {top[i] for i in range(len(texts))}
    assert len(kept) < len(texts) - 40
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, node string, fp int").repartition(4)
    left = simhash.drop_near_copies(docs, crowd=crowd, alike=alike)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(kept)


def test_texts_without_ids_link_others_all_the_same(spark):
    pick = random.Random(21)
    near = lambda x, y: ((simhash.fingerprint(x) ^ simhash.fingerprint(y)) & (1 << 64) - 1).bit_count()
    while True:  # a and b are each near n, but not near each other
        n = [f"w{pick.randrange(10**6)}" for _ in range(150)]
        a, b = " ".join(["x1", *n[1:]]), " ".join([*n[:-2], "y1", "y2"])
        if near(a, " ".join(n)) <= 4 and near(" ".join(n), b) <= 4 and near(a, b) > 4:
            break
    for ids, want in (((1, None, 2), [1, 1, 1]), ((1, 3, 2), [1, 1, 1]), ((5, None, None), [5, 5, 5]), ((None, None, None), [None] * 3)):
        docs = spark.createDataFrame(list(zip(ids, (a, " ".join(n), b), strict=True)), "doc_id long, text string")
        assert [r["component_id"] for r in simhash.near_duplicates(docs).collect()] == want


def test_near_copies_of_repeated_ids(spark):
    speak = lambda seed: " ".join(f"w{random.Random(seed * 100 + k).randrange(10**6)}" for k in range(40))
    rows = [(1, speak(1)), (1, speak(1)), (2, speak(1)), (2, speak(2)), (None, speak(1)), (None, None), (3, None), (4, ""), (5, speak(3)), (5, speak(3).upper())]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: (r[0] or 0, (r[1] or "").lower())
    assert sorted(map(key, got.collect())) == sorted(map(key, [(1, speak(1)), (2, speak(2)), (None, speak(1)), (None, None), (3, None), (5, speak(3))]))
    assert simhash.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates(spark):
    pick = random.Random(3)
    base = [f"w{pick.randrange(500)}" for _ in range(400)]
    near = [*base[:200], "changed", *base[201:]]
    texts = [" ".join(base), " ".join(near), " ".join(base).upper(), "", None, "alone here"]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got[2] == 0 and got[3] == got[4] == 3 and got[5] == 5
    twice = docs_of(spark, texts).unionByName(docs_of(spark, texts))
    assert simhash.near_duplicates(twice).count() == 12
    assert simhash.near_duplicates(twice.limit(0)).count() == 0


def test_components(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    pick = random.Random(4)
    pairs = [(k, k + 1) for k in range(12)] + [(100, 100 + k) for k in range(1, 50)] + [(pick.randrange(200, 400), pick.randrange(200, 400)) for _ in range(120)]
    edges = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(edges).collect()}
    want = plain_components(400, pairs)
    assert got == {k: want[k] for k in {x for p in pairs for x in p if p[0] != p[1]}}
    assert common.components(edges.limit(0)).count() == 0


# ---- the queries

@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_return_what_they_promise(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, sf, "documents").collect()}
    for name, folds, held, cut in (("op1_quality", 5, 0, 0.3), ("op9_toxicity", 3, 1, 0.7)):
        got = queries.QUERIES[name](spark, sf).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(docs)
        for r in got:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    got = {r["doc_id"]: r["fingerprint"] for r in queries.op7_simhash(spark, sf).collect()}
    assert got == {d: f"{plain_fingerprint(t):016x}" for d, t in docs.items()}
    assert queries.op4_packing(spark, sf).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    found = queries.op2_decontaminate(spark, sf)
    assert found.columns == ["doc_id", "item_id", "start", "end", "edits"]
    items = {r["item_id"]: decontaminate.normal(r["text"]) for r in common.table(spark, sf, "benchmark").collect()}
    whole = {(d, i) for d, t in docs.items() for i, item in items.items() if item in decontaminate.normal(t)}
    assert whole <= {(r["doc_id"], r["item_id"]) for r in found.collect()}
