"""From raw documents to packed training sequences: toxicity, quality, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last keep the columns of documents, and judge every row by its own text: null
and empty texts count as empty, repeated rows get the same verdict, empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import decontaminate, packing, quality, simhash, toxicity
from gridweave.llm.common import free_name, stored, table

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches TOXIC."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = free_name(docs, "score")
    return toxicity.score(docs, model, out=out).where(F.col(out) < TOXIC).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the cut."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = free_name(docs, "score")
    return quality.score(docs, model, out=out).where(F.col(out) >= quality.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash brings together and whose texts share 0.8 of their five-word shingles."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens: a row for each piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against plain versions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents of the data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
