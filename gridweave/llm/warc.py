"""WARC archives compressed with Zstandard: a dictionary up front, one frame for each record.

A file starts with a skippable frame that holds the dictionary; every record after it is a frame of its
own, so records can be decoded one by one. Payloads that were seen before are written as revisit records,
which name the response they repeat instead of holding its payload again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import MOST_SENT, few_at_a_time, small, stored
from gridweave.llm.records import filesystem, put

#: The skippable frame that holds a dictionary, an ordinary frame, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
#: The dictionary is trained on a file's first records, so many and so many bytes at most.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 256, 2_000_000, 32_768
#: Rows, and bytes of payload, that a reader gives back at once.
READ_ROWS, READ_BYTES = 500, 8_000_000
CHUNK = 1 << 20
FILES = "shard long, path string, records long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<{URN}{'none' if page_id is None else page_id}>"


def page_of(text: str) -> int | None:
    own = text.strip("<>").removeprefix(URN)
    return None if own == "none" else int(own)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, repeats: bool, date: str) -> bytes:
    """A WARC record around an HTTP response; a revisit has the response's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if repeats else http + payload
    head = [("WARC-Type", "revisit" if repeats else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", "sha1:" + digest(payload)))
    if repeats:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(first))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        found[name.strip().lower()] = value.strip(" ")
    return found


def parse(data: bytes) -> dict:
    """The parts of a record, all lengths and the digest checked; ValueError if any does not hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    of = _headers(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-payload-digest", "content-length"} - of.keys():
        raise ValueError(f"no {', '.join(sorted(missing))}")
    n = int(of["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("a record's block is not as long as its header says")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP head in a record")
    size, kind = int(_headers(http.split(b"\r\n")[1:])["content-length"]), of["warc-type"]
    own = of["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != own):
        raise ValueError("a payload does not match its length or digest")
    if kind not in ("response", "revisit") or (kind == "revisit" and (payload or "warc-refers-to" not in of)):
        raise ValueError(f"unexpected record of type {kind}")
    url = of.get("warc-target-uri")
    return {
        "page_id": page_of(of["warc-record-id"]),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload_bytes": size,
        "payload_digest": own,
        "record_type": kind,
        "refers_to": page_of(of["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def frames(source) -> Iterator[bytes]:
    """The decoded frames of an open archive, one at a time, with the dictionary that it starts with."""
    head = source.read(8)
    if not head:
        return
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary at the start of the archive")
    n = struct.unpack("<I", head[4:])[0]
    words = source.read(n)
    if len(words) != n:
        raise ValueError("the dictionary is cut off")
    if words[:4] == struct.pack("<I", FRAME_MAGIC):
        words = zstandard.ZstdDecompressor().decompress(words)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    held = b""
    while True:
        while len(held) < 4 and (more := source.read(CHUNK)):
            held += more
        if not held:
            return
        if len(held) < 4 or struct.unpack("<I", held[:4])[0] != FRAME_MAGIC:
            raise ValueError("not a frame")
        part, out = decoder.decompressobj(), []
        while True:
            out.append(part.decompress(held))
            if part.eof:
                held = part.unused_data
                break
            held = source.read(CHUNK)
            if not held:
                raise ValueError("a frame is cut off")
        yield b"".join(out)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns a row of FILES for each archive.

    Of rows with equal payloads (by SHA-256 and length) of at least min_bytes bytes, those with the smallest page_id
    are responses, all of them where a page_id repeats, and the others revisits of it. Null html is an empty payload;
    null ids are larger than any other and, if no row of the payload has an id, all are responses. Rows with one
    page_id get one WARC-Record-ID. An archive is renamed when whole.
    """
    own = few_at_a_time(pages).select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("key", F.concat_ws(":", F.sha2("html", 256), F.octet_length("html")))
    long_enough = F.octet_length("html") >= min_bytes
    seen = own.where(long_enough).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    seen = small(stored(seen.select("key", "first"), "repeated-payloads"), MOST_SENT // 4)  # the pages themselves then stay where they are
    marked = own.join(seen, "key", "left").select("page_id", "url", "html", F.when(long_enough, F.col("first")).alias("first"))

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        context = TaskContext.get()
        name, number = f"pages-{context.partitionId():06d}.warc.zst", 0
        tmp, out, encoder, held, size = f"{base}/_{name}-{context.taskAttemptId()}", None, None, [], 0

        def begin():
            nonlocal out, encoder, held
            words, size = [], 0
            for data in held[:TRAIN_RECORDS]:
                if size < TRAIN_BYTES:
                    words.append(data[: TRAIN_BYTES - size])
                    size += len(words[-1])
            try:
                trained = zstandard.train_dictionary(DICTIONARY_BYTES, words, steps=1, d=8, k=256) if len(words) > 7 else None
            except zstandard.ZstdError:  # too little to learn from
                trained = None
            raw = trained.as_bytes() if trained else b""
            encoder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True) if trained else zstandard.ZstdCompressor(level=3, write_checksum=True)
            fs.create_dir(base, recursive=True)
            out = fs.open_output_stream(tmp, compression=None, buffer_size=CHUNK)
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            for data in held:
                out.write(encoder.compress(data))
            held = []

        for batch in batches:
            for page_id, url, html, first in batch.itertuples(index=False):
                page_id, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), first, first is not None and page_id != first, date)
                number += 1
                if out is not None:
                    out.write(encoder.compress(data))
                    continue
                held.append(data)
                size += len(data)
                if len(held) >= TRAIN_RECORDS or size >= TRAIN_BYTES:
                    begin()
        if held:
            begin()
        if out is not None:
            out.close()
            put(fs, tmp, f"{base}/{name}")
            yield pd.DataFrame([(context.partitionId(), name, number)], columns=["shard", "path", "records"])

    done = marked.mapInPandas(written, FILES).collect()  # a row for each archive
    return pages.sparkSession.createDataFrame(sorted(done), FILES)


def read(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """A row of READ for each record of the archives that write() returned; payload is null for revisits.

    Headers, lengths and digests are checked, and each archive must hold as many records as were written.
    """
    listed = [(r["path"], r["records"]) for r in files.collect()]
    schema = READ if payloads else READ.removesuffix(", payload binary")
    names = [x.split()[0] for x in schema.split(", ")]
    if not listed:
        return spark.createDataFrame([], schema)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)

        def batch_of(rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame([[r[c] for c in names] for r in rows], columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        for batch in batches:
            for path, records in batch.itertuples(index=False):
                rows, number, size = [], 0, 0
                with fs.open_input_stream(f"{base}/{path}", compression=None, buffer_size=CHUNK) as source:
                    for data in frames(source):
                        rows.append(parse(data))
                        number += 1
                        size += len(rows[-1]["payload"] or b"") if payloads else 0
                        if len(rows) >= READ_ROWS or size >= READ_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                if number != records:
                    raise ValueError(f"{path} holds {number} records, not {records}")
                if rows:
                    yield batch_of(rows)

    return spark.createDataFrame(listed, "path string, records long").repartition(len(listed)).mapInPandas(parsed, schema)
