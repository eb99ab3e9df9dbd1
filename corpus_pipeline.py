"""Corpus pipeline: documents through five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm import line_dedup, mixing, piece_transducer, quality_rules
from sheetwright.llm import near_copies as near
from sheetwright.llm.common import cut, table
from sheetwright.llm.queries import PIECE_MODEL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the model behind them keep."""
    rows = quality_rules.apply_rules(docs, table(spark, sf_dir, "labels"))
    return rows.filter("kept").select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that repeat over documents; n_chars, where there is one, follows the text."""
    rows = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return rows.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 or more of five-word shingles): one row, of the least doc_id, null last."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "rows")
    groups = near.near_copies(rows.select("row", "doc.doc_id", "doc.text"))
    others = cut(groups.filter("row <> first").select("row"), "near-copies")
    return rows.join(others, "row", "left_anti").select("doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = mixing.mix_sources(docs).filter("n_copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy")).select("doc.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids and round_trip of each row."""
    rows = piece_transducer.encode_texts(docs, piece_transducer.read_model(PIECE_MODEL))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("pieces", pieces)]

#: The quality model and XXH64 can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
