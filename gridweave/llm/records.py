"""Token ids in length-delimited binary records with masked checksums, and an offset index beside them.

A shard file holds, after 8 bytes of name and 4 of id width, one record for each document:
length (8 bytes), masked checksum of those bytes (4), payload, masked checksum of the payload (4).
The payload is a flag (1 if there is a doc_id), the doc_id (8) and the ids, 2 or 4 bytes each, all
little-endian. Its index file holds the offset of each record and the ids before it (8 bytes each), so
that records can be read in any order. Checksums are CRC-32, rotated and shifted so that a checksum of
data that holds checksums stays strong.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import few_at_a_time
from gridweave.llm.tokens import encoder

NAME = b"TOKENS01"
MASK = 0xA282EAD8
#: Bytes of text that a shard holds about at most.
SHARD_BYTES = 256_000_000
SHARDS = "shard long, path string, records long, tokens long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record around a payload."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def read_frame(source) -> bytes | None:
    """The next payload of an open file, None at its end; ValueError if anything is cut off or damaged."""
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged length of a record")
    n = struct.unpack("<Q", head[:8])[0]
    body = source.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("damaged record")
    return body[:n]


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<?q", doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def parse_payload(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    known, doc_id = struct.unpack("<?q", payload[:9])
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=9)


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)


def put(fs: pafs.FileSystem, tmp: str, path: str) -> None:
    """Renames a whole file, unless another attempt of the task has: its file holds the same and is never taken away."""
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        try:
            fs.move(tmp, path)
        except OSError:  # some stores refuse a name that another attempt has just taken
            if fs.get_file_info(path).type == pafs.FileType.NotFound:
                raise
    if fs.get_file_info(tmp).type != pafs.FileType.NotFound:
        fs.delete_file(tmp)


def open_shard(fs: pafs.FileSystem, path: str):
    """The open file, past its head, and the width of its ids."""
    source = fs.open_input_stream(path, buffer_size=1 << 20)
    head = source.read(12)
    if head[:8] != NAME:
        raise ValueError(f"not a token file: {path}")
    return source, struct.unpack("<I", head[8:])[0]


def read_at(folder: str, name: str, positions: list[int]) -> list[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the shard, ids) of records by position in the shard, in any order."""
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/{name}.idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    found = []
    with fs.open_input_file(f"{base}/{name}.bin") as f:
        width = struct.unpack("<I", f.read(12)[8:])[0]
        for k in positions:
            f.seek(int(index[k, 0]))
            found.append((lambda p, before: (p[0], before, p[1]))(parse_payload(read_frame(f), width), int(index[k, 1])))
    return found


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, width: int = 2, shards: int | None = None) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; returns a row of SHARDS for each file.

    Null ids come first, rows of one id in the order of their texts' hashes; null texts count as empty, and
    repeated rows are written each time. Each shard is one range of that order, unless given as many as the session
    has shuffle partitions, or more where they would hold over SHARD_BYTES of text. A shard is written under a
    name of its attempt and renamed when whole, so a task that is run again does no harm. width is the bytes of
    an id; ids that need more raise ValueError.
    """
    spark = docs.sparkSession
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).ids, end_id.to_bytes(4, "little")
        fs, base = filesystem(folder)
        context = TaskContext.get()
        name, index, records, tokens, at = f"shard-{context.partitionId():06d}", array("Q"), 0, 0, 12
        tmp = f"{base}/_{name}-{context.taskAttemptId()}"
        out = None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(tmp + ".bin", buffer_size=1 << 20)
                    out.write(NAME + struct.pack("<I", width))
                ids = np.frombuffer(encode(text or "") + end, "<u4")
                if width < 4 and ids.max() >= 1 << (8 * width):
                    raise ValueError(f"ids of this tokenizer need more than {width} bytes")
                record = frame(payload_of(None if pd.isna(doc_id) else int(doc_id), ids, width))
                out.write(record)
                index.extend((at, tokens))
                at, tokens, records = at + len(record), tokens + len(ids), records + 1
        if out is not None:
            out.close()
            with fs.open_output_stream(tmp + ".idx") as f:
                f.write(np.array(index, "<u8").tobytes())
            for kind in (".idx", ".bin"):
                put(fs, tmp + kind, f"{base}/{name}{kind}")
            yield pd.DataFrame([(context.partitionId(), name, records, tokens, at)], columns=["shard", "path", "records", "tokens", "bytes"])

    own = few_at_a_time(docs).select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text")
    done = ordered.mapInPandas(written, SHARDS).collect()  # a row for each file
    return spark.createDataFrame(sorted(done), SHARDS)


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record of the shards that write() returned.

    Every record is checked, and each shard must hold as many records and ids as were written.
    """
    before, listed = 0, []
    for r in shards.orderBy("shard").collect():
        listed.append((r["path"], before, r["records"], r["tokens"]))
        before += r["tokens"]
    if not listed:
        return spark.createDataFrame([], READ)

    def batch_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        for batch in batches:
            for path, before, records, tokens in batch.itertuples(index=False):
                rows, at, number = [], before, 0
                source, width = open_shard(fs, f"{base}/{path}.bin")
                with source:
                    while (payload := read_frame(source)) is not None:
                        doc_id, ids = parse_payload(payload, width)
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at, number = at + len(ids), number + 1
                        if len(rows) >= 10_000:
                            yield batch_of(rows)
                            rows = []
                if (number, at - before) != (records, tokens):
                    raise ValueError(f"{path} holds {number} records, not {records}")
                yield batch_of(rows)

    return spark.createDataFrame(listed, "path string, start long, records long, tokens long").repartition(len(listed)).mapInPandas(parsed, READ)
