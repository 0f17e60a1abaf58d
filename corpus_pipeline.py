"""A corpus pipeline of five stages: language, lines, near-duplicates, mixture, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes what a stage returns to the shared
scratch folder as Parquet and gives it, read again, to the next one.  A stage takes an empty table to an empty one,
and passes other columns on, but for packing, whose result is pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import common, language, lines, mixing, near, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject (and those without a letter, or with a null text) go; null ids and
    repeated rows stay.  Without a labelled row no model can be fitted, and all stay."""
    return language.keep_identified(docs, language.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go, and documents that lose their last words so; n_chars, if there, follows.
    Null texts and those without words stay; null ids come last in the order; of repeated rows the first keeps its lines."""
    out = lines.drop_lines(docs, lines.mark_lines(docs))
    return out.withColumn("n_chars", common.F.length("text").cast("long")) if "n_chars" in out.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays: that of the
    smallest id, null last.  Null and wordless texts are one group; of repeated rows one stays."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as the mixture takes them: whole, in part, or repeated.  Null and wordless texts are in no mix; a null
    source is a source; null ids stay."""
    return mixing.take(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as the packing operator returns them.  A null or empty text is its end id alone;
    null ids stay null; each row is a document of its own."""
    return packing.pack(docs, packing.vocabulary_path(), json_path=packing.added_path())


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):  # a stage's working tables go when its documents are written
            docs = common.result(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
