"""The training-corpus pipeline: five stages over ``documents``, each written and read again.

Every stage decides row by row, never by doc_id: rows without an id are treated like any other, repeated rows
and different texts under one id are separate rows. An empty table stays empty. All but the last stage return
the columns they were given, further ones included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate as _decontaminate
from strandline.llm import jaccard, packing, secrets
from strandline.llm import toxicity as _toxicity
from strandline.llm.common import discard, prepare, shared_dir, stored, table

#: Columns that a stage adds for itself and takes off again.
MARK = "_strandline_mark"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows scored 0.7 or more by a model trained on the labels' own texts. Null, empty and wordless
    texts score below one half and stay; equal texts score alike."""
    prepare(spark)
    model = _toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _toxicity.score(docs, model, MARK).where(F.col(MARK) < 0.7).drop(MARK)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked texts (five words, similarity 0.8): the one with the smallest
    doc_id, a row without id only where no other has one; of ties (repeated ids) just one. Null, empty and
    wordless texts link with nothing and stay."""
    rows = stored(docs.withColumn(MARK, F.monotonically_increasing_id()), "pipeline-rows")
    groups = jaccard.link_documents(rows.select(F.col(MARK).alias("doc_id"), "text"), n=5, percent=80).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", MARK)
    linked = rows.select(MARK, "doc_id").join(groups.select(F.col("doc_id").alias(MARK), "component_id"), MARK)
    first = linked.groupBy("component_id").agg(F.min(order)[MARK].alias(MARK)).select(MARK)
    # rows meet by their own number, not by group: a group of any size is dealt over all tasks
    gone = linked.select(MARK).join(first, MARK, "left_anti")
    return rows.join(gone, MARK, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a window of a benchmark item. Null, empty and wordless texts hold none and stay."""
    found = _decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), MARK)
    return found.where(F.col(MARK) == 0).drop(MARK)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets inside the texts; every row stays, null and empty texts as they are."""
    prepare(spark)
    return secrets.redact(docs, secrets.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: one row per piece, null and empty texts as
    the end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and token ids are beyond SQL; tests/llm/test_pipeline.py holds every stage and the whole
#: pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(before)
        docs = spark.read.parquet(path)
        docs._strandline_path = path
        before = docs
    return docs
