"""Credentials, source divergence and alignment, against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from gridweave.llm import alignment, credentials, divergence, tokens

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "extra", 7, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, start long, kind string")


# ---- credentials

ACCESS, BLOB = "AKIA" + "Z9" * 8, "aB3" * 10
TEXTS = [
    f"id {ACCESS} then {BLOB} end",
    f"{BLOB} alone, and far below\n\n{ACCESS}",
    f"{ACCESS}{' ' * 256}{BLOB}", f"{ACCESS}{' ' * 257}{BLOB}",
    "user: bob\nPassword = 'hunter2hunter2' at https://db.example.org/x?y=1",
    "user: bob and nothing else, https://example.org", "user=x password=abcdefgh", "login: someone, 0123456789abcdef0123456789abcdef",
    "0123456789abcdef0123456789abcdef https://example.org/sum", "token=token:abcdefgh secret=short API_KEY==abcdefghij apikey \"x\"",
    f"token = {BLOB}", f"account={BLOB}", "AKIAAKIA AKIA0123456789A AKIA0123456789AB", "é" * 300 + f" {ACCESS} \U0001f600 {BLOB}",
    "password:" + " " * 5000 + "abcdefgh", "ab" * 40000, f"s3://bucket/{'x' * 3000} {ACCESS}", None, "", " ", "same token=abcdefgh", "same token=abcdefgh",
]


def plain_spans(text):
    placed = []
    for k, (kind, pattern, _) in enumerate(credentials.KINDS):
        for m in re.finditer(pattern, text, re.ASCII):
            if kind == "assign" and len(m[2]) < 8 or kind == "login" and len(m[2]) < 3:
                continue
            if kind == "blob" and not all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]")):
                continue
            placed.append((m.start(), k, m.end()))
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = {p: sum(b < p[0] for b in breaks) for p in placed}
    strong = [p for p in placed if credentials.KINDS[p[1]][0] in credentials.STRONG]
    free = [p for p in placed if p not in strong and not any(p[0] < s[2] and s[0] < p[2] for s in strong)]
    linked = [
        p for p in free
        if any(
            credentials.KINDS[c[1]][0] in credentials.COMPLETES[credentials.KINDS[p[1]][0]] and scope[c] == scope[p] and 0 <= max(c[0] - p[2], p[0] - c[2]) <= credentials.REACH
            for c in strong + free
        )
    ]
    return sorted(strong), sorted(strong + linked)


def told(spans):
    return ",".join(f"{credentials.KINDS[k][0]}:{a}:{b}" for a, k, b in spans)


def test_credentials_match_a_plain_search(spark):
    pick = random.Random(5)
    parts = [ACCESS, BLOB, "user=bob", "login : alice", "token=abcdefgh", "secret='x'", "https://a.b/c", "0" * 32, "\n\n", "\n \n", " ", "\n", "word ", "é", "x" * 200, "postgresql://u@h/d"]
    texts = TEXTS + ["".join(pick.choice(parts) for _ in range(pick.randint(1, 30))) for _ in range(300)]
    ids = [None if k % 50 == 7 else k for k in range(len(texts))]
    rows = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in credentials.report(docs_of(spark, texts, ids)).collect()]
    want = []
    for i, text in zip(ids, texts, strict=True):
        base, every = plain_spans(text or "")
        count = Counter(credentials.KINDS[k][0] for _, k, _ in base)
        want.append((i, count["assign"], count["access"], count["hex"], hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert sum(len(plain_spans(t or "")[1]) > len(plain_spans(t or "")[0]) for t in texts) > 50


def test_weak_parts_need_what_completes_them():
    kinds = {t: {credentials.KINDS[k][0] for _, k, _ in plain_spans(t)[1]} for t in TEXTS if t}
    assert kinds[TEXTS[0]] == {"access", "blob"} and kinds[TEXTS[1]] == {"access"}
    assert "blob" in kinds[TEXTS[2]] and "blob" not in kinds[TEXTS[3]]
    assert kinds[TEXTS[4]] == {"login", "assign", "endpoint"} and not kinds[TEXTS[5]]


def test_no_python_in_the_credential_plan(spark):
    plan = credentials.spans(docs_of(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_credentials_of_an_empty_table(spark):
    assert credentials.report(docs_of(spark, ["x"]).where("false")).collect() == []
    found = credentials.spans(docs_of(spark, TEXTS[:1])).collect()
    assert sorted((r["kind"], r["start"], r["end"], r["class"]) for r in found) == [("access", 3, 23, "identifier"), ("blob", 29, 59, "secret")]


# ---- divergence

def plain_audit(rows, least, top):
    terms = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    df, n = Counter(), defaultdict(Counter)
    for lang, source, text in [[x or "" for x in r] for r in rows]:
        found = terms.findall(text.translate(lower))
        df.update((lang, t) for t in set(found))
        n[lang, source].update(found)
    out = []
    for lang in {g[0] for g in n}:
        kept = [t for (of, t), k in df.items() if of == lang and k >= least]
        groups = {g[1]: n[g] for g in n if g[0] == lang}
        whole = Counter()
        for own in groups.values():
            whole.update(own)

        def p(own, kept=kept):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 5) // (total + 5 * len(kept)) for t in kept}

        shares, q = {s: p(own) for s, own in groups.items()}, p(whole)
        for s, own in shares.items():
            pairs = sorted((-sum(abs(own[t] - other[t]) for t in kept), o.encode(), o) for o, other in shares.items() if o != s)
            high = sorted((q[t] - own[t], t.encode(), t) for t in kept if groups[s][t] and own[t] > q[t])[:top]
            out += [(lang, s, part, name, -v, k + 1) for part, found in (("pair", pairs), ("term", high)) for k, (v, _, name) in enumerate(found)]
    return sorted(out)


def test_divergence_matches_a_plain_version_in_many_passes_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 30)
    pick = random.Random(2)
    words = ["Straße", "STRASSE", "the", "The", "a1b", "ÀB", "日本", "x\u0000y", "it's", "É", "é", "z" * 3000, "tie", "tied", "\U0001f600"]
    rows = [(pick.choice(["en", "de", "", None]), pick.choice(["s1", "s2", "S1", "", None, "ü", "s3"]), " ".join(pick.choices(words, k=pick.randint(0, 30)))) for _ in range(250)]
    rows += [("en", "empty", None), ("en", "none", ""), ("none", "a", "rare"), ("none", "b", None), ("none", "c", "x")] + [rows[0]] * 40
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "lang string, source string, text string, id long, term string, n int")
    for settings in ({}, {"pass_chars": 20, "tile_terms": 3, "tile_sources": 2}):
        found = divergence.audit(docs, least=6, top=4, **settings).collect()
        assert sorted(tuple(r) for r in found) == plain_audit(rows, 6, 4)


def test_divergence_of_an_empty_table_and_of_huge_counts(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(docs).collect() == []
    from pyspark.sql import functions as F

    huge = spark.range(1).select(divergence.share(F.lit(9 * 10**17), F.lit(10**18), F.lit(10**12)).alias("p")).first()["p"]
    assert huge == 1 + 10**9 * (9 * 10**17 + 5) // (10**18 + 5 * 10**12)


# ---- alignment

ALIGNED = [
    "Hello world, this is a text.\nAnd a line.", "", None, " leading  double   spaces \n\n and \t tabs", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve Straße ŉ İı 日本語 \U0001f600\U0001f64f",
    "x " * 9000, "a▁b", "Å é", "same text here", "same text here", "\x00\x01", " ", "\n", "supercalifragilistic" * 300, "①ﬁａ", "the cat the cat the cat",
]


def plain_alignment(texts):
    a_lib, b_lib = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    own, names = tokens.letter_bytes(), {v: k for k, v in a_lib.get_vocab().items()}
    rows, docs_with = [], Counter()
    for text in texts:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes = [bytes(own[c] for c in names[t]) for t in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(t)[3:5], 16)]) if b_lib.is_byte(t) else b_lib.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in (a_bytes, b_bytes)):
            rows.append(([], [], [], []))
            continue
        spans = []
        for ids, parts in ((a, a_bytes), (b, b_bytes)):
            at, held = 0, []
            for t, part in zip(ids, parts, strict=True):
                held.append((t, at, at + len(part)))
                at += len(part)
            spans.append(held)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append(["|".join(",".join(str(t) for t, s, e in side if low <= s and e <= cut) for side in spans)])
            low = cut
        links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if s < v and u < e] if len(a) < 3000 else None
        if links is None:  # walk along both sides
            links, i, j = [], 0, 0
            while i < len(a) and j < len(b):
                links.append((a[i], b[j]))
                e, v = spans[0][i][2], spans[1][j][2]
                i, j = i + (e <= v), j + (v <= e)
        docs_with.update(set(links))
        rows.append((a, b, [g[0] for g in groups], links))
    best = defaultdict(int)
    for (x, _), n in docs_with.items():
        best[x] = max(best[x], n)
    return [
        (len(a), len(b), len(g), len(k), sum(docs_with[p] == best[p[0]] for p in k), sum(docs_with[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, k in rows
    ]


def test_alignment_matches_a_plain_version_with_common_and_rare_pairs(spark):
    pick = random.Random(4)
    parts = [*"ab Z.,'\n\té", " the", " cat", "日", "İ", " ", "don't", "▁", "\U0001f600", " 12", "<s>", "<|endoftext|>"]
    texts = ALIGNED + ["".join(pick.choice(parts) for _ in range(pick.randint(1, 40))) for _ in range(150)]
    ids = [None if k == 9 else k for k in range(len(texts))]
    docs, want = docs_of(spark, texts, ids), plain_alignment(texts)
    want = sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=repr)
    for most in (1_000_000, 40, 0):
        found = alignment.align(docs, BYTES, PIECES, most_held=most)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert alignment.align(docs.where("false"), BYTES, PIECES).collect() == []


def test_encoders_are_those_of_the_libraries():
    own, library, pick = tokens.PieceEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(6)
    spelt = own.pieces()
    parts = [*"ab Z.,'\n\t\r é́ßİ日１2!?\x00", " ", " the", "\n", "  ", " word,", "▁", "<s>", "ﬁ", "don't", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 25)))
        ids = library.encode(text)
        assert own.ids(text) == (ids if b"".join(spelt[i] for i in ids) == (" " + text).encode() else None), text
    plain, hf = tokens.ByteEncoder(BYTES), Tokenizer.from_file(BYTES)
    hf.encode_special_tokens = True
    for n in range(20000):
        text = "".join(pick.choice(parts) if n % 2 else chr(pick.choice([pick.randrange(32, 127), pick.randrange(128, 1024), pick.randrange(0x3000, 0x9000), pick.randrange(0x1F300, 0x1F700)])) for _ in range(pick.randint(0, 25)))
        assert plain.ids(text) == hf.encode(text, add_special_tokens=False).ids, text
