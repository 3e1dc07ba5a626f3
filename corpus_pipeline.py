"""Corpus pipeline: language ID, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; the runner writes each
stage's result as Parquet and reads it back. All stages but the last return the columns of documents. When a stage
begins, the result of the one before is written, so the intermediate tables of that stage are deleted then.

Defined cases: rows without text or letters are rejected by language ID; of documents that near-duplicate links
connect, the one with the smallest id stays; rows with a null id pass that stage; repeated rows become one row there;
leaks are dropped by id and text, so null and shared ids are told apart; further columns may have any names; an empty
table passes through every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, langid, mixing, tokens
from tessera.llm.common import Scratch, beside, clear_shared, materialise, owned

#: Documents whose best language scores lower are rejected.
LEAST_SCORE = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(after: str | None = None) -> Callable[[Stage], Stage]:
    """A stage that first deletes what the stage before it left in the shared folder."""

    def wrap(work: Stage) -> Stage:
        @functools.wraps(work)
        def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if after:
                clear_shared(spark, after)
            with owned(work.__name__):
                return work(spark, docs, sf_dir)

        return begin

    return wrap


def _packed(docs: DataFrame) -> DataFrame:
    """The rows as one column beside id and hash of the text, so that no name of theirs can clash with one of ours.

    Ids can be null or shared by different texts; the hash tells the rows apart and keeps shuffles small.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("copy"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@_stage()
def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), langid.detector(spark, model)(F.col("text")).alias("found"))
    return _unpacked(rows.where((F.col("found.lang_pred") != langid.UNDETERMINED) & (F.col("found.score") >= LEAST_SCORE)), docs)


@_stage("identify_languages")
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keep the document with the smallest id."""
    groups = jaccard.jaccard_components(docs, n=5, percent=80)
    gone = materialise(groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct(), "pipeline-gone")
    kept = _packed(docs).join(beside(gone, 16), F.col("id") == F.col("gone"), "left_anti")
    # Only rows whose id comes again can repeat; as a rule there are none, and no text is shuffled.
    again = docs.groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("again")
    again = beside(materialise(again, "pipeline-again"), 16)
    same = F.col("id").eqNullSafe(F.col("again"))
    once = kept.join(again, same, "left_semi").dropDuplicates(["id", "copy"])
    return _unpacked(kept.join(again, same, "left_anti").unionByName(once), docs)


@_stage("drop_near_duplicates")
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_copy=True)
    leaked = materialise(found.select(F.col("doc_id").alias("leaked"), F.col("copy").alias("leaked_copy")).distinct(), "pipeline-leaks")
    held = F.col("id").eqNullSafe(F.col("leaked")) & (F.col("copy") == F.col("leaked_copy"))
    return _unpacked(_packed(docs).join(beside(leaked, 24), held, "left_anti"), docs)


@_stage("drop_benchmark_leaks")
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


@_stage("mix_sources")
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed corpus, and what they hold of each document."""
    return tokens.read_tokens(tokens.write_tokens(docs), with_ids=False)


STAGES = [
    ("language_id", identify_languages),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("token_files", write_tokens),
]

#: Trained classification and tokenizers cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of the stages' written results, only the latest is kept."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.drop_all(but=(f"pipeline-{name}",))
    out = STAGES[-1][1](spark, docs, sf_dir)
    # The files are written by now, and nothing else is read.
    scratch.drop_all()
    return out
