"""Multipart credential linking: secrets by their own form, and weak parts that count only beside what completes them.

Strong spans (assignments, access identifiers, long hex) are reported by themselves. Logins, random-looking strings and
endpoints are weak: each is reported only if a part that completes it stands in the same scope, that is in the same
paragraph and at most REACH characters away. Parts are matched by built-in expressions, and linked by an interval
join on bins of REACH characters, so the work grows with the text, whatever stands in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import stored

#: Characters between two parts of one credential, at most.
REACH = 256


def either_case(word: str) -> str:
    """A pattern for the word in capitals, small letters or both; ASCII alone, in any regex dialect."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(names: list[str], value: str) -> str:
    return "(" + "|".join(map(either_case, names)) + r""")["']?\x20*[:=]\x20*["']?(""" + value + ")"


#: Kind, pattern, class of part; in the order in which kinds are listed where spans begin together.
KINDS = [
    ("assign", _assigned(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"), "secret"),
    ("access", "AKIA[A-Z0-9]{12,}", "identifier"),
    ("hex", "[0-9a-f]{32,}", "secret"),
    ("login", _assigned(["username", "user", "login", "account", "client_?id"], "[A-Za-z0-9+/_.@=-]+"), "identifier"),
    ("blob", "[A-Za-z0-9+/]{24,}={0,2}", "secret"),
    ("endpoint", r"""(?:https?|s?ftps?|ssh|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|rediss?|amqps?)://[^\x00-\x20"'<>|]+""", "endpoint"),
]
NUMBER = {kind: k for k, (kind, *_) in enumerate(KINDS)}
STRONG = ["assign", "access", "hex"]
#: What completes a weak part. A hash beside a link is an everyday thing, so hex completes no endpoint.
COMPLETES = {"login": ["assign", "hex", "blob"], "blob": ["access", "login"], "endpoint": ["assign", "access"]}
BREAK, BREAK_PATTERN = len(KINDS), r"\n[ \t\r]*\n"


def _parts(text: Column, kind: int, pattern: str) -> Column:
    """Every leftmost match of a pattern: (kind, place among them, characters before it since the last one, its size, whether it counts)."""
    columns = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")]
    if kind == NUMBER["assign"] or kind == NUMBER["login"]:
        columns.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))

    def part(x: Column, place: Column) -> Column:
        counts = F.lit(True)
        if kind == NUMBER["assign"]:
            counts = F.length(x["value"]) >= 8
        elif kind == NUMBER["login"]:
            counts = F.length(x["value"]) >= 3
        elif kind == NUMBER["blob"]:
            counts = x["found"].rlike("[A-Z]") & x["found"].rlike("[a-z]") & x["found"].rlike("[0-9]")
        fields = {"kind": F.lit(kind), "place": place, "gap": F.length(x["gap"]), "size": F.length(x["found"]), "counts": counts}
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    return F.filter(F.transform(F.arrays_zip(*columns), part), lambda x: x["size"].isNotNull())


def _found(docs: DataFrame) -> DataFrame:
    """(row, doc_id, parts): a row for each of docs with its own number, and the matches in its text, in a stored table."""
    text = F.col("text")
    own = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    own = own.select("*", *[text.rlike(pattern).alias(kind) for kind, pattern, _ in KINDS])
    may = {kind: F.col(kind) & F.greatest(*[F.col(c) for c in others]) for kind, others in COMPLETES.items()}
    own = own.withColumn("linked", F.greatest(*may.values()))
    none = F.expr("cast(array() as array<struct<kind: int, place: int, gap: int, size: int, counts: boolean>>)")
    arrays = [F.when(F.col(kind) & (F.lit(True) if kind in STRONG else F.col("linked")), _parts(text, k, pattern)).otherwise(none) for k, (kind, pattern, _) in enumerate(KINDS)]
    arrays.append(F.when(F.col("linked"), _parts(text, BREAK, BREAK_PATTERN)).otherwise(none))
    return stored(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*arrays).alias("parts")), "credential-parts")


def _placed(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, scope) of the parts that count; a scope is the number of paragraphs before."""
    whole = found.where(F.size("parts") > 0).select("row", F.explode("parts").alias("x")).select("row", "x.*")
    along = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = whole.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(along)).where("counts")
    placed = ends.select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    before = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("scope", F.count(F.when(F.col("kind") == BREAK, True)).over(before)).where(F.col("kind") != BREAK)


def _binned(spans: DataFrame, reach: int, prefix: str) -> DataFrame:
    """The spans, once for each bin of REACH characters within `reach` of them; columns but the joined ones get a prefix."""
    first, last = F.greatest(F.col("start") - reach, F.lit(0)) / REACH, (F.col("end") + reach) / REACH
    bins = F.sequence(F.floor(first), F.floor(last))
    return spans.withColumn("bin", F.explode(bins)).withColumnsRenamed({c: prefix + c for c in ("kind", "start", "end")})


def _linked(placed: DataFrame) -> DataFrame:
    """The weak spans that overlap no strong one and have a part beside them that completes them."""
    weak_kinds = [NUMBER[k] for k in COMPLETES]
    strong, weak = placed.where(~F.col("kind").isin(weak_kinds)), placed.where(F.col("kind").isin(weak_kinds))
    covered = _binned(weak, 0, "").join(_binned(strong, 0, "_"), ["row", "bin"]).where("_start < end and start < _end")
    free = weak.join(covered.select("row", "kind", "start").distinct(), ["row", "kind", "start"], "left_anti")
    near = _binned(free, 0, "").join(_binned(strong.unionByName(free), REACH, "_"), ["row", "scope", "bin"])
    fits = F.lit(False)
    for kind, others in COMPLETES.items():
        fits |= (F.col("kind") == NUMBER[kind]) & F.col("_kind").isin([NUMBER[c] for c in others])
    apart = F.greatest(F.col("_start") - F.col("end"), F.col("start") - F.col("_end")).between(0, REACH)
    return near.where(fits & apart).select("row", "kind", "start", "end").distinct()


def _spans(found: DataFrame) -> DataFrame:
    """(row, kind, start, end) of all that is reported; kind by its number."""
    placed = stored(_placed(found), "credential-spans")
    strong = placed.where(F.col("kind").isin([NUMBER[k] for k in STRONG])).select("row", "kind", "start", "end")
    return strong.unionByName(_linked(placed))


def _names() -> Column:
    return F.array(*[F.lit(kind) for kind, *_ in KINDS])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, kind, start, end, class): every reported span, in code points, end exclusive.

    row tells repeated documents apart. Null and empty texts have no spans; a null doc_id comes back as null.
    """
    found = _found(docs)
    classes = F.array(*[F.lit(of) for *_, of in KINDS])
    named = _spans(found).join(found.select("row", "doc_id"), "row")
    return named.select("doc_id", "row", _names()[F.col("kind")].alias("kind"), "start", "end", classes[F.col("kind")].alias("class"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): a row for each of docs, whatever its text or id.

    spans is kind:start:end, comma-joined, by start and then in the order of KINDS; base_sha256 is the hash of that
    string for strong spans alone, of the empty string where there are none. A row's spans are put together in one
    task, and are no more than its text.
    """
    found = _found(docs)
    one = F.struct("start", "kind", "end")
    base = F.col("kind").isin([NUMBER[k] for k in STRONG])
    counts = [F.count(F.when(F.col("kind") == NUMBER[k], True)).alias(f"n_{k}") for k in STRONG]
    rows = _spans(found).groupBy("row").agg(*counts, F.sort_array(F.collect_list(one)).alias("all"), F.sort_array(F.collect_list(F.when(base, one))).alias("base"))

    def joined(spans: str) -> Column:
        named = F.transform(F.col(spans), lambda x: F.concat_ws(":", _names()[x["kind"]], x["start"], x["end"]))
        return F.coalesce(F.array_join(named, ","), F.lit(""))

    whole = found.select("row", "doc_id").join(rows, "row", "left")
    return whole.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in STRONG],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"),
    )
