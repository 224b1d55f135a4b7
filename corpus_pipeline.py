"""A corpus pipeline of five of the training-data operators.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``docs``. ``run`` applies them to the table ``documents``.

1. ``language``: documents without a letter in their text (null texts too) go.
2. ``near_copies``: of each group of documents linked by five-word shingles of a Jaccard
   similarity of 0.8 or more, the one of the least id stays.
3. ``decontaminate``: documents of which at least 5 % of the words lie in windows of 13 words of
   test items go; others stay as they are.
4. ``secrets``: secrets in the texts are replaced by ``[secret]``; ``n_chars`` follows.
5. ``encode``: the ids and the decoded text of each document's byte-pair encoding.

Every stage reads all that its predecessor kept, and passes rows with null ids, repeated rows,
empty tables and columns of any name through as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (decontaminate, fragment_bpe, jaccard_join, language_kernel,
                            secret_ledger)
from tallyspark.llm.common import stored
from tallyspark.session import shared_dir

# The stages cannot be put in SQL (a learned classifier; byte-pair encoding); the tests hold
# them against plain versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is learned from the pipeline's own table; ``und`` is rejected. A prediction
    depends on the text alone, so the decision is taken on the row itself."""
    model = language_kernel.fit_model(docs)
    return language_kernel.reject_unknown(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_ledger.redact(docs, shared_dir(spark, "secret-ledger"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    got = fragment_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminated),
          ("secrets", secrets), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
