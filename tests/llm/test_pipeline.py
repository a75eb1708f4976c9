from collections import Counter

import duckdb
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reckon.llm import bpe, line_dedup, mixing
from reckon.llm.common import stored, table

from .test_documents import brute

FOLDER = "/root/testdata/sf0.001"


def by_sql(sql, docs):
    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text", "source").toPandas())
    return connection.execute(sql).df().set_index("doc_id")


def test_each_stage_against_brute_force(spark):
    odd = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "123 456", "en", None, 7)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = table(spark, FOLDER, "documents").unionByName(odd)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "near_duplicates", "mixing", "bpe"]

    known = stored(stages["language"](spark, docs, FOLDER), "t")
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in docs.join(known, "doc_id", "left_anti").collect()} == {10**6, 10**6 + 1}

    clean = stored(stages["line_dedup"](spark, known, FOLDER), "t")
    want = by_sql(line_dedup.ORACLE["op9_line_dedup"], known)["text_md5"].to_dict()
    assert {r["doc_id"]: r["m"] for r in clean.select("doc_id", F.md5("text").alias("m")).collect()} == want
    assert clean.columns == docs.columns and clean.where("n_chars <> length(text)").count() == 0

    single = stored(stages["near_duplicates"](spark, clean, FOLDER), "t")
    classes = [eval(x) for x in brute([(r["doc_id"], r["text"]) for r in clean.collect()])]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c, _ in classes})

    mix = stored(stages["mixing"](spark, single, FOLDER), "t")
    plan = by_sql(mixing.ORACLE["op6_source_mixing"], single)
    want = Counter({k: int(r["taken"] / r["size"]) for k, r in plan.iterrows() if r["size"] and r["taken"]})
    assert Counter(r["doc_id"] for r in mix.collect()) == want and mix.columns == docs.columns

    library = Tokenizer.from_file(bpe.vocabulary_path())
    text = {r["doc_id"]: r["text"] for r in mix.collect()}
    rows = stages["bpe"](spark, mix, FOLDER).collect()
    assert len(rows) == sum(want.values())
    assert all(r["n_tokens"] == len(library.encode(text[r["doc_id"]], add_special_tokens=False).ids) for r in rows)


def test_no_documents(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_columns_that_clash_with_those_of_stages_come_through(spark):
    names = ["h", "_copy", "n_lines", "n_removed", "size", "source_size", "target", "taken", "mixed_copy", "lang_pred", "lang_score", "key", "id", "doc", "Size2"]
    docs = table(spark, FOLDER, "documents").limit(60).select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, FOLDER), "t")
        assert kept.columns == docs.columns and kept.count() > 0, name
        assert kept.where(" OR ".join(f"`{n}` <> '{n}:' || doc_id" for n in names)).count() == 0, name
        docs = kept
