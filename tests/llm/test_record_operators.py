"""Packing, record files, archives, URL rules, embeddings and the pipeline, against plain versions."""

import base64
import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridweave.llm import common, embeddings, packing, queries, records, tokens, urls, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello world, this is a text.\nAnd a line.", "", None, " leading  double   spaces \n\n and \t tabs", "<|endoftext|> inside", "naïve Straße ŉ İı 日本語", "x " * 9000, "same", "same"]


def docs_of(spark, texts):
    rows = [(i, t, "extra", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, start long")


def plain_ids(path, text):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


# ---- tokens

@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_cached_encoding_is_exact(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    encoder, library, pick = tokens.Encoder(path), Tokenizer.from_file(path), random.Random(1)
    parts = [*"ab Z.,'\n\t\r\u00a0é\u0301ßİΣσ日１2!?", " ", " ", " the", "\n", "  ", "\n\n", "don't", " I'll", "Ω", "ﬁ", "<|endoftext|>", " word,", "\nNew"]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 25)))
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.ids(text) == want, text


# ---- packing

def check_packed(rows, texts):
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        documents.setdefault(r["doc_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= packing.WINDOW
        assert at >= packing.WINDOW - packing.SLACK or at & (at - 1) == 0
    for doc, text in texts.items() if isinstance(texts, dict) else enumerate(texts):
        ids, at = plain_ids(WORDS, text), 0
        for r in sorted(documents[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            piece = ids[at : at + r["length"]].tobytes()
            assert r["ids_crc32"] == zlib.crc32(piece) and ("ids" not in r.asDict() or bytes(r["ids"]) == piece)
            at += r["length"]
        assert at == len(ids)


@pytest.mark.parametrize("keep_ids", [True, False])
def test_packing(spark, keep_ids):
    texts = TEXTS + ["word " * n for n in (5000, 3000, 1000, 500, 4094, 4095, 4096, 7)]
    check_packed(packing.pack(docs_of(spark, texts).repartition(3), WORDS, keep_ids=keep_ids).collect(), texts)


def test_packing_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 2)
    texts = [f"some words {k} " * 60 for k in range(40)]
    check_packed(packing.pack(docs_of(spark, texts).repartition(9), WORDS).collect(), texts)


def test_packing_nothing_and_repeats(spark):
    docs = docs_of(spark, ["one", "two"])
    assert packing.pack(docs.limit(0), WORDS).count() == 0
    twice = packing.pack(docs.unionByName(docs), WORDS)
    assert twice.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n != 2 * m").count() == 0
    null = packing.pack(docs.withColumn("doc_id", F.lit(None).cast("long")), WORDS)
    assert null.where("doc_id is null").count() == 2


def test_packer_places_best_fit():
    made = []
    p = packing.Packer(made.append, window=10, most=2, slack=1)
    add = lambda doc, n: p.add((doc, 0, n, bytes(4 * n)))
    add(1, 6), add(2, 7), add(3, 3)  # 3 goes to the window that 2 fills to 7
    assert [[(x[0], len(x[3]) // 4) for x in own] for own in made] == [[(2, 7), (3, 3)]]
    add(4, 9), add(5, 4)  # 5 fills the window that 1 began
    assert [(x[0], len(x[3]) // 4) for x in made[1]] == [(1, 6), (5, 4)]
    assert sum(len(x[3]) // 4 for x in p.close()) == 9


# ---- record files

def test_records(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    docs = docs_of(spark, TEXTS).unionByName(spark.createDataFrame([(None, "no id", "", 0)], "doc_id long, text string, shard string, start long"))
    shards = records.write(docs.repartition(4), folder, BYTES, shards=3)
    got = records.read(spark, folder, shards).orderBy("start").collect()
    want, at = [(None, "no id"), *enumerate(TEXTS)], 0
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    for r, (_, text) in zip(got, want, strict=True):
        ids = plain_ids(BYTES, text)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = shards.orderBy("shard").first()
    order = list(range(first["records"]))[::-1]
    for k, (doc_id, before, ids) in zip(order, records.read_at(folder, first["path"], order), strict=True):
        assert (doc_id, before) == (got[k]["doc_id"], got[k]["start"]) and len(ids) == got[k]["n_tokens"]
    path = tmp_path / "records" / (first["path"] + ".bin")
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        records.read(spark, folder, shards).collect()


def test_records_of_nothing(spark, tmp_path):
    shards = records.write(docs_of(spark, TEXTS).limit(0), f"file://{tmp_path}/none", BYTES)
    assert shards.count() == 0 and records.read(spark, f"file://{tmp_path}/none", shards).count() == 0


def test_frames_are_checked():
    whole = records.frame(b"payload")
    assert records.read_frame(io.BytesIO(whole)) == b"payload" and records.read_frame(io.BytesIO(b"")) is None
    for bad in (whole[:-1], whole[:5], b"\1" + whole[1:], whole[:14] + b"?" + whole[15:]):
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bad))


# ---- archives

PAGES = "page_id long, url string, html string, first long, key string"


def test_archives(spark, tmp_path):
    rows = [(3, "http://a/\n%0A", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u%", "y"), (None, "z", "y"), (None, "q", "only"), (7, "e", None), (5, "e", ""), (9, "é", "ü" * 100_000)]
    rows += [(100 + k, f"http://h/{k}", f"<html><body>page {k} of many, all much alike</body></html>") for k in range(400)]
    pages = spark.createDataFrame([(*r, 0, "k") for r in rows], PAGES)
    for min_bytes in (0, 5):
        folder = f"file://{tmp_path}/w{min_bytes}"
        got = warc.read(spark, folder, warc.write(pages.repartition(2), folder, min_bytes)).collect()
        key = lambda p, u: (-1 if p is None else p, u or "")
        by = {key(r["page_id"], r["url"]): r for r in got}
        assert len(got) == len(rows)
        for page_id, url, html in rows:
            r, payload = by[key(page_id, url)], (html or "").encode()
            same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
            revisit = len(payload) >= min_bytes and same and page_id != min(same)
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
            assert (r["record_type"], r["refers_to"]) == (("revisit", min(same)) if revisit else ("response", None))
            assert r["payload"] is None if revisit else bytes(r["payload"]) == payload
    assert warc.read(spark, "file:///none", warc.write(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_archive_frames():
    words = zstandard.train_dictionary(2048, [b"some words that are alike %d" % k for k in range(500)]).as_bytes()
    packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    bodies = [b"some words that are alike 3", b"", b"x" * 3_000_000]
    data = b"".join(packed.compress(b) for b in bodies)
    for held in (words, zstandard.ZstdCompressor().compress(words)):  # the dictionary may be compressed itself
        head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(held)) + held
        assert list(warc.frames(io.BytesIO(head + data))) == bodies
    assert list(warc.frames(io.BytesIO(b""))) == []
    for bad in (data, head[:20], head + data[:-3], head + data + b"junk!"):
        with pytest.raises(Exception):  # noqa: B017
            list(warc.frames(io.BytesIO(bad)))


def test_archive_records_are_checked():
    whole = warc.record(4, "http://a", b"payload", None, False, "2000-01-01T00:00:00Z")
    assert warc.parse(whole)["payload"] == b"payload"
    for bad in (whole[:-1], whole.replace(b"payload\r\n", b"paylord\r\n"), whole.replace(b"WARC/1.1", b"HTTP/1.1"), whole.replace(b"Length: 7", b"Length: 8"), whole.replace(b"WARC-Record-ID", b"X-ID")):
        with pytest.raises(ValueError):
            warc.parse(bad)


# ---- urls

URLS = [
    "http://A.Example.NET/en/1?x", "https://example.net/EN/", "http://example.com/de/", "x://m.example.org/fr/z#t", "http://net/", "http://net", None,
    "no scheme", "", "://", "http://host.net?q=1", "http://notexample.net/en/", "http://b.example.com:80/de/", "a://b://c/d", "http://É.ORG/fr/é",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "fine", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: r for r in urls.judge(pages, queries.RULES, urls.junk(F.col("html"))).collect()}
    for i, url in enumerate(URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
        fits = [(len(r), r, how) for how, r in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), url
    assert urls.judge(pages.limit(0), queries.RULES, urls.junk(F.col("html"))).count() == 0


def test_reputation(spark):
    rows = [("good.example.com", 0)] * 200 + [("bad.spam.org", 1)] * 60 + [("other.spam.org", 1)] * 2 + [("new.spam.org", None), ("one.fresh.com", 1)] + [("x.co.uk", 0), ("y.co.uk", 0)]
    got = {r["host"]: r for r in urls.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.spam.org"]["low"] > 0.2 > got["good.example.com"]["rate"]
    assert got["new.spam.org"]["rate"] > got["one.fresh.com"]["rate"] > got["good.example.com"]["rate"]  # known only by those above them
    assert got["one.fresh.com"]["low"] < 1 and all(0 <= r["rate"] <= 1 for r in got.values())


def test_names_without_ports_users_and_addresses(spark):
    hosts = ["a.b.example.com:8080", "me@www.x.co.uk", "10.0.0.1", "10.0.0.1:80", "[::1]:443", "localhost", "", "x.y.test"]
    table = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in table.select(urls.domain_of(F.col("host")), urls.suffix_of(F.col("host"))).collect()]
    assert got == [("example.com", "com"), ("x.co.uk", "co.uk"), ("10.0.0.1",) * 2, ("10.0.0.1",) * 2, ("[::1]",) * 2, ("localhost",) * 2, ("", ""), ("y.test", "test")]
    assert table.select(urls.suffix_of(F.col("host"), ("y.test",))).collect()[-1][0] == "y.test"


def test_urls_with_nulls_and_repeats(spark, monkeypatch):
    rows = [(1, "http://a.org/", None), (1, "http://a.org/", "x"), (None, None, None), (None, "http://b.org/#", "$$$$"), (3, "http://b.org/de/", "$" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [("allow", "b.org/"), ("block", "b.org/")]  # of equal rules block wins
    want = [(1, "a.org", "/", None), (1, "a.org", "/", None), (None, "", "", None), (None, "b.org", "/", "b.org/"), (3, "b.org", "/de/", "b.org/")]
    for sent in (urls.MOST_SENT, 0):
        monkeypatch.setattr(urls, "MOST_SENT", sent)
        got = urls.judge(pages, rules, urls.junk(F.col("html"))).collect()
        assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, want))
        assert {r["verdict"] for r in got if r["rule"]} == {"block"}


# ---- embeddings

def test_tiles_beyond_any_number_of_blocks():
    rows = pd.DataFrame({"cid": [1, 2], "copies": [1, 1], "vector": [[1.0, 0.1], [1.0, 0.11]], "block": [0, 100_001], "low": [0, 0], "high": [100_001, 100_001]})
    assert embeddings.tile_links(rows, 0.98)["n"].tolist() == [1, 1]


def plain_links(rows, threshold=0.98):
    out = {}
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    for i, (_, v, label) in enumerate(rows):
        out[i] = []
        for j, (_, w, other) in enumerate(rows):
            if i != j and ok[i] and ok[j] and label == other and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    out[i].append(j)
    return out


def test_embeddings(spark):
    pick = np.random.default_rng(6)
    rows = []
    for c in range(25):
        base = pick.normal(size=16)
        for k in range(8):
            rows.append((len(rows), np.float32(base + pick.normal(size=16) * 0.09 * k).tolist(), c % 2))
    rows += [(200, rows[3][1], rows[3][2]), (201, rows[3][1], 5), (202, None, 1), (203, [0.0] * 16, 1), (204, [1.0, None], 1), (205, [float("nan")] * 16, 1), (206, rows[3][1], None), (207, [], 1), (208, rows[40][1][:8], 1), (None, rows[60][1], rows[60][2]), (4, rows[4][1], rows[4][2])]
    table = spark.createDataFrame([(*r, 0, "b") for r in rows], "vec_id long, embedding array<float>, label int, n long, block string").repartition(3)
    links = plain_links(rows)
    root = {i: i for i in links}
    least = lambda i: (rows[i][0] is None, rows[i][0] if rows[i][0] is not None else 0)
    for _ in rows:
        for i, own in links.items():
            root[i] = min([root[i], *[root[j] for j in own]], key=least)
    want = sorted(((-1 if rows[i][0] is None else rows[i][0]), len(own), rows[root[i]][0]) for i, own in links.items())
    assert sum(n for _, n, _ in want) > 100
    for block in (1024, 16):
        got = embeddings.near_duplicates(table, 0.98, block).collect()
        assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_quantised_bounds_hold():
    pick = np.random.default_rng(7)
    a, b = pick.normal(size=(80, 1500)), pick.normal(size=(90, 1500))
    b[:40] = a[:40] + pick.normal(size=(40, 1500)) * 0.2
    (qa, sa, ea), (qb, sb, eb) = embeddings.quantise(a), embeddings.quantise(b)
    u, v = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    gap = np.abs(u @ v.T - (qa.astype(float) @ qb.astype(float).T) * sa[:, None] * sb[None, :])
    assert (gap <= ea[:, None] + eb[None, :] + 3 * ea[:, None] * eb[None, :]).all()
    i, j = embeddings.near_pairs(a, b, 0.97, chunk=7)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*[x.tolist() for x in np.nonzero(u @ v.T >= 0.97)], strict=True))


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    pick = random.Random(8)
    syllables = ["ta", "ro", "mi", "ne", "lon", "ter", "sa", "vik", "dus", "kel"]
    speak = lambda n: " ".join("".join(pick.choices(syllables, k=pick.randint(1, 4))) for _ in range(n)).capitalize() + "."
    items = [speak(30) for _ in range(3)]
    texts = [speak(60) for _ in range(60)]
    texts += [speak(30) + f" zorgish {speak(5)} zorgful " + speak(20) for _ in range(15)]
    texts += ["### ".join(speak(1) for _ in range(50)) for _ in range(15)]
    texts += [texts[0], texts[0].replace(".", " ."), speak(20) + " " + items[1] + " " + speak(10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, rows, schema in (
        ("labels", [(i, int(not 75 <= i < 90), int(60 <= i < 75)) for i in range(90)], "doc_id long, quality int, toxic int"),
        ("benchmark", list(enumerate(items)), "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    left, own = set(range(93)), docs
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:-1], (set(range(60, 75)), set(range(75, 90)), {90}, {92}), strict=True):
        own = common.stored(stage(spark, own, str(tmp_path)), name)
        assert own.columns == docs.columns
        now = {r["doc_id"] for r in own.select("doc_id").collect()}
        assert gone <= left - now <= gone | {91}, name
        left = now
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == left
    check_packed(packed, {i: texts[i] for i in left})


def clashing(docs):
    """docs with columns named like those that the stages add."""
    return docs.withColumns({c: F.lit(9.0) for c in ("score", "_score", "node", "fp", "size", "evidence")})


def test_pipeline_stages_take_any_rows(spark, tmp_path):
    speak = lambda n, seed: " ".join(f"w{random.Random(seed * 10**6 + k).randrange(10**6)}" for k in range(n))
    texts = [speak(60, 1), speak(60, 2), None, "", speak(40_000, 3), speak(60, 1)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, speak(50, 4), None, None, None), (1, texts[1], "en", "s", 1), (5, speak(60, 6), "en", "s", 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    spark.createDataFrame([(i, 1, 0) for i in range(3)] + [(None, 1, None), (1, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, speak(12, 9)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (r["doc_id"] is None, r["doc_id"], (r["text"] or "")[:20], r["score"], r["node"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = common.stored(stage(spark, docs, str(tmp_path)), name)
        assert got.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        want = [r for r in docs.collect() if name != "near_duplicates" or (r["doc_id"], r["text"]) not in ((3, ""), (5, texts[5]))]
        if name == "near_duplicates":  # one of the two rows of document 1
            want.remove(next(r for r in want if r["doc_id"] == 1))
        assert sorted(map(key, got.collect())) == sorted(map(key, want)), name
    check_packed(corpus_pipeline.pack(spark, docs.where("doc_id <> 1 and doc_id <> 5"), str(tmp_path)).collect(), {i: texts[i] for i in (0, 2, 3, 4)})


# ---- what tasks leave in Python workers

def test_workers_keep_no_encoder_after_packing(spark):
    """Waiting workers that held one took an executor of the pipeline over its memory."""

    def held(batches):
        for batch in batches:
            yield batch.assign(n=len(common._KEPT) + len(tokens._HELD))

    docs = docs_of(spark, [f"word {i} of a text that is packed" for i in range(64)]).repartition(8)
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).where("start = 0").count() == 64
    assert spark.range(0, 64, 1, 8).mapInPandas(held, "id long, n long").agg(F.sum("n")).first()[0] == 0


def test_sparing_gives_back_when_a_task_ends_early():
    def read(batches):
        for batch in batches:
            yield common.worker_held("kept", lambda: batch)

    rows = common.sparing(read)(iter([1, 2]))
    assert next(rows) == 1 and common._KEPT
    rows.close()
    assert not common._KEPT
    assert common.trimmed(lambda rows: rows + 1)(1) == 2
