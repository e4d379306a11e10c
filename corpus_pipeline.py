"""A corpus from raw documents to piece ids: five stages, each run on all that its predecessor kept.

    language     documents without a recognised language go
    lines        repeated runs of three lines go, but for their first occurrence, and documents of which nothing is left
    copies       of each group of near-duplicates one document stays
    benchmark    documents that hold a passage of a benchmark item go
    pieces       texts become piece ids

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``, under any names and with their values.
Rows with a null text go in the first stage; null ids and rows that repeat an id are treated as each operator's docstring says;
an empty table gives an empty table. ``run`` writes each result as Parquet
to the shared scratch folder and reads it for the next stage, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeprofile.llm.common import read_table, write_and_read
from lakeprofile.llm.decontaminate import drop_contaminated
from lakeprofile.llm.language_id import drop_undetermined
from lakeprofile.llm.line_dedup import dedup_lines
from lakeprofile.llm.near_duplicates import drop_near_duplicates
from lakeprofile.llm.pieces import round_trip
from lakeprofile.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_undetermined(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The operator's own columns must not stand in for columns of these names that come in.
    own = {name: f"__in_{name}" for name in ("n_lines", "n_removed") if name in docs.columns}
    cut = dedup_lines(docs.withColumnsRenamed(own)).filter("n_removed = 0 or length(trim(translate(text, '\n\r\t', ''))) > 0")
    changed = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return cut.withColumns(changed).select(*[F.col(f"`{own.get(name, name)}`").alias(name) for name in docs.columns])


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_crc32``, ``ids`` and ``same``: whether decoding the ids gives the text back."""
    return round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("language", language), ("lines", lines), ("copies", copies), ("benchmark", benchmark), ("pieces", pieces)]

#: The learned language model and the piece encoder can't be written in SQL; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
