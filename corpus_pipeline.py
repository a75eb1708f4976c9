"""A corpus from raw documents: language, line dedup, near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` applies them in order, writing
each stage's rows to the shared folder, reading them again and deleting those of the stage before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reckon.llm import bpe, language, line_dedup, mixing, near_duplicates
from reckon.llm.common import dropped, prepare, stored, table

#: Share of a text's n-grams that its language must know, below which the text is rejected.
LEAST_SCORE = 0.2
#: SQL can't express the fitted language filter, so the pipeline is tested against brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with columns of these names under others, as the stage adds its own, and the columns that bring them back."""
    hidden = {c: f"{c}_of_documents" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(hidden), [F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null texts, texts without letters and unknown languages go."""
    prepare(spark)
    rows, own = _aside(docs, ("lang_pred", "lang_score"))
    known = language.identify(rows, language.train(docs)).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return known.select(*own)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier runs of lines; n_chars follows the text."""
    prepare(spark)
    rows, own = _aside(docs, ("n_lines", "n_removed"))
    clean = line_dedup.dedup_lines(rows)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*own)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    prepare(spark)
    return near_duplicates.keep_one(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    prepare(spark)
    rows, own = _aside(docs, ("size", "h", "source_size", "target", "taken", "mixed_copy"))
    taken = mixing.mix(rows, keep=True)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    repeated = F.explode(F.sequence(F.lit(1), times))
    return taken.where(F.col("taken") > 0).withColumn("mixed_copy", repeated).select(*own)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and the digests of the ids and of the text they decode to, of every document of the mix."""
    return bpe.digests(docs, bpe.vocabulary_path(), ("doc_id", "source"), ids=True)


STAGES = [
    ("language", by_language),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
