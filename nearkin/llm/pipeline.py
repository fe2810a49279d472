"""The corpus pipeline: five operators, one after another, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; other columns are left out.

Defined cases: a null text, or one without a letter, goes at the first stage; a null lang is replaced by the predicted one, and
null source and n_chars stay; a row without doc_id is no duplicate of anything and goes only if it is contaminated itself; rows that
repeat an id are judged each by its own text; a text of any length is judged whole; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm import queries as q
from nearkin.llm.decontaminate import find_windows
from nearkin.llm.language_id import identify, learned_from
from nearkin.llm.line_dedup import dedup_lines
from nearkin.llm.near_dedup import near_duplicates
from nearkin.llm.sentencepiece_bpe import encode_digest
from nearkin.llm.textcore import dealt_join, free_finished, reliable, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bits per byte from which a text is no text of a learned language: no better than a uniform byte code.
REJECT_BITS = 8.0
#: A near-duplicate shares 80 % of the five-word shingles.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language and writes the predicted one to lang."""
    found = identify(docs, learned_from(docs), carry=("text", "source", "n_chars"))
    good = found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < REJECT_BITS))
    return good.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks of lines that earlier documents have; documents that lose every line go."""
    kept = dedup_lines(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays: the one with the smallest id. docs are Parquet files, whose rows keep
    their numbers."""
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row"))
    named = rows.select("text", F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("_row"))
    classes = near_duplicates(named, percent=NEAR_PERCENT, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    several = classes.where("component_id <> _row").select("component_id").distinct()
    members = reliable(classes.join(several, "component_id", "left_semi").join(rows.select("_row", "doc_id"), "_row"))
    free_finished(spark)
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_first"))
    gone = dealt_join(members, first, ["component_id"]).where("_row <> _first").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    found = find_windows(docs, q.table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left: their number and digest, and the digest of the text that they decode to."""
    return encode_digest(docs, q.tokenizer("piece_bpe_32k.model"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]

#: Language models, alignments and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared checkpoint folder and read again. What a
    stage has read is deleted when its own rows are written; those of the last but one stay for the result."""
    docs, place = q.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, place = place, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return STAGES[-1][1](spark, docs, sf_dir)
