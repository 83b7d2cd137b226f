"""The operators as queries over the data folder's tables, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import alignment, chat, credentials, decontaminate, divergence, embeddings, packing, quality, records, simhash, toxicity, urls, warc
from gridweave.llm.common import crc_fold, scratch, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the fifth of ids with remainder 0 are never read."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a document holds a benchmark text, with few edits."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that is not the start of a longer one, rendered."""
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, keep_ids=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to compressed archives and read back from them."""
    folder = scratch(spark, "archives")
    files = warc.write(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read(spark, folder, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by how much of its host's pages is junk."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES, urls.junk(F.col("html")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-bit SimHash of every document and its group at four or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to record files in the order of doc_id and read back from them."""
    folder = scratch(spark, "token-records")
    shards = records.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return records.read(spark, folder, shards)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the third of ids with remainder 1 are never read."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.98 within its label, and its group."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with weak parts beside what completes them."""
    return credentials.report(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their use of its common terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every document."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_decontaminate, op3_chat, op4_packing, op5_warc, op6_urls, op7_simhash, op8_token_records, op9_toxicity, op10_embeddings,
        op11_credentials, op12_divergence, op13_alignment,
    )
}

OP3_SQL = """
WITH own AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list({'t': turn, 'r': role, 'x': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM own GROUP BY conv_id),
starts AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM whole)),
logged AS (SELECT min(conv_id) AS conv_id, l FROM whole GROUP BY l),
kept AS (SELECT conv_id FROM logged WHERE NOT EXISTS (SELECT 1 FROM starts WHERE starts.l = logged.l))
SELECT conv_id, part, piece, count(*) AS turns,
    string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1) // 512 AS BIGINT) AS piece
    FROM (SELECT *, CAST(coalesce(floor(turn / 512), 0) AS BIGINT) AS part FROM own JOIN kept USING (conv_id)))
GROUP BY conv_id, part, piece
"""

OP6_SQL = r"""
WITH own AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
        CASE WHEN html IS NULL THEN NULL WHEN length(html) - length(translate(html, '#$%*|', '')) > 0.01 * length(html) THEN 1 ELSE 0 END AS bad
    FROM pages),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM own GROUP BY host),
named AS (SELECT *, CASE WHEN regexp_matches(name, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$') THEN [name] ELSE string_split(name, '.') END AS p FROM counted),
hosts AS (
    SELECT host, n, bad, CASE WHEN array_to_string(p[-2:], '.') IN (SUFFIXES) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
        CASE WHEN array_to_string(p[-2:], '.') IN (SUFFIXES) THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix
    FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
units AS (SELECT 'h' AS level, n, bad FROM hosts UNION ALL SELECT 'd', n, bad FROM domains UNION ALL SELECT 's', n, bad FROM suffixes),
sums AS (
    SELECT level, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(bad) / CAST(sum(n) AS DOUBLE) AS m, CAST(sum(n * n) AS DOUBLE) AS nn, sum(bad * bad / CAST(n AS DOUBLE)) AS sq
    FROM units WHERE n > 0 GROUP BY level),
between_ AS (SELECT level, m, CASE WHEN n - nn / n > 0 THEN (sq - n * m * m - (k - 1) * m * (1 - m)) / (n - nn / n) ELSE 0 END AS b FROM sums),
prior AS (SELECT level, m, CASE WHEN b > 0 THEN least(10000.0, greatest(1.0, m * (1 - m) / b - 1)) ELSE 10000.0 END AS s FROM between_),
p AS (SELECT max(m) FILTER (level = 's') AS mean, max(s) FILTER (level = 's') AS ss, max(s) FILTER (level = 'd') AS ds, max(s) FILTER (level = 'h') AS hs FROM prior),
top AS (SELECT suffix, (bad + ss * mean) / (n + ss) AS above FROM suffixes, p),
middle AS (SELECT domain, suffix, (bad + ds * above) / (n + ds) AS above FROM domains JOIN top USING (suffix), p),
rated AS (SELECT host, n, (bad + hs * above) / (n + hs) AS rate, hs FROM hosts JOIN middle USING (domain, suffix), p),
known AS (SELECT host, CASE WHEN rate - sqrt(19.0) * sqrt(rate * (1 - rate) / (n + hs + 1)) > 0.2 THEN 'block' ELSE 'allow' END AS by_host FROM rated),
ruled AS (
    SELECT page_id, own.host, path, by_host,
        CASE WHEN (own.host = 'example.net' OR own.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (own.host = 'example.com' OR own.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (own.host = 'org' OR own.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (own.host = 'net' OR own.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM own JOIN known ON own.host = known.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE by_host END AS verdict FROM ruled
""".replace("SUFFIXES", "'" + "', '".join(urls.DOUBLE_SUFFIXES) + "'")

OP5_SQL = """
WITH own AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
summed AS (SELECT page_id, octet_length(payload) AS payload_bytes, CAST(unhex(sha1(payload)) AS BIT) AS bits FROM own),
named AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + 16 * get_bit(bits, CAST(5 * i AS INT)) + 8 * get_bit(bits, CAST(5 * i + 1 AS INT)) + 4 * get_bit(bits, CAST(5 * i + 2 AS INT))
            + 2 * get_bit(bits, CAST(5 * i + 3 AS INT)) + get_bit(bits, CAST(5 * i + 4 AS INT)) AS BIGINT), 1)), '') AS payload_digest
    FROM summed),
first AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM first
"""

OP10_SQL = """
WITH RECURSIVE own AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (
    SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS size FROM own
    WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM own UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT own.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, own.vec_id = component_id AS kept
FROM own JOIN least ON own.vec_id = least.vec_id LEFT JOIN counted ON own.vec_id = counted.vec_id
"""



def _op11_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    found = [
        f"""SELECT row, {k} AS kind, unnest(range(1, len(found) + 1)) AS place, gaps, found, {value} AS own FROM (
            SELECT row, string_split_regex(text, {quoted(pattern)}) AS gaps, regexp_extract_all(text, {quoted(pattern)}) AS found,
                regexp_extract_all(text, {quoted(pattern)}, {group}) AS own FROM own WHERE regexp_matches(text, {quoted(pattern)}))"""
        for k, (pattern, value, group) in enumerate([*((p, "own", 2 if k in ("assign", "login") else 0) for k, p, _ in credentials.KINDS), (credentials.BREAK_PATTERN, "own", 0)])
    ]
    number, reach = credentials.NUMBER, credentials.REACH
    fits = " OR ".join(f"w.kind = {number[k]} AND c.kind IN ({', '.join(str(number[o]) for o in others)})" for k, others in credentials.COMPLETES.items())
    names = ", ".join(quoted(k) for k, *_ in credentials.KINDS)
    return f"""
WITH own AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
every AS ({" UNION ALL ".join(found)}),
ended AS (
    SELECT row, kind, found[place] AS part, own[place] AS own,
        CAST(list_sum(list_transform(gaps[1:place], lambda x: length(x))) + list_sum(list_transform(found[1:place], lambda x: length(x))) AS BIGINT) AS "end"
    FROM every),
counted AS (
    SELECT row, kind, "end" - length(part) AS start, "end" FROM ended
    WHERE CASE kind WHEN {number["assign"]} THEN length(own) >= 8 WHEN {number["login"]} THEN length(own) >= 3
        WHEN {number["blob"]} THEN regexp_matches(part, '[A-Z]') AND regexp_matches(part, '[a-z]') AND regexp_matches(part, '[0-9]') ELSE true END),
placed AS (
    SELECT row, kind, start, "end", (SELECT count(*) FROM counted b WHERE b.row = a.row AND b.kind = {credentials.BREAK} AND b.start < a.start) AS scope
    FROM counted a WHERE kind <> {credentials.BREAK}),
strong AS (SELECT * FROM placed WHERE kind IN ({", ".join(str(number[k]) for k in credentials.STRONG)})),
free AS (
    SELECT * FROM placed w WHERE kind IN ({", ".join(str(number[k]) for k in credentials.COMPLETES)})
        AND NOT EXISTS (SELECT 1 FROM strong s WHERE s.row = w.row AND s.start < w."end" AND w.start < s."end")),
linked AS (
    SELECT w.* FROM free w WHERE EXISTS (
        SELECT 1 FROM (SELECT * FROM strong UNION ALL SELECT * FROM free) c
        WHERE c.row = w.row AND c.scope = w.scope AND ({fits}) AND greatest(c.start - w."end", w.start - c."end") BETWEEN 0 AND {reach})),
reported AS (SELECT *, [{names}][kind + 1] || ':' || start || ':' || "end" AS told FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked))
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {number[k]}) AS n_{k}" for k in credentials.STRONG)},
    sha256(coalesce(string_agg(told, ',' ORDER BY start, kind) FILTER (kind <= {max(number[k] for k in credentials.STRONG)}), '')) AS base_sha256,
    coalesce(string_agg(told, ',' ORDER BY start, kind), '') AS spans
FROM own LEFT JOIN reported ON own.row = reported.row GROUP BY own.row, doc_id
"""


OP11_SQL = _op11_sql()

OP12_SQL = r"""
WITH own AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
met AS (
    SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM own),
kept AS (SELECT lang, term FROM met GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM own),
posted AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM met JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN posted p ON g.lang = p.lang AND g.source = p.source GROUP BY ALL),
p AS (
    SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 5) // (CAST(total AS HUGEINT) + 5 * v) AS p
    FROM totals t JOIN kept k ON t.lang = k.lang JOIN langs l ON t.lang = l.lang LEFT JOIN posted o ON o.lang = t.lang AND o.source = t.source AND o.term = k.term),
q AS (
    SELECT lang, term, 1 + 1000000000 * (n + 5) // (total + 5 * v) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM p GROUP BY ALL) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) JOIN langs USING (lang)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, source, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 50
"""

#: SQL cannot express the others; tests hold them against plain versions, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op3_chat": OP3_SQL, "op5_warc": OP5_SQL, "op6_urls": OP6_SQL, "op10_embeddings": OP10_SQL, "op11_credentials": OP11_SQL, "op12_divergence": OP12_SQL}
