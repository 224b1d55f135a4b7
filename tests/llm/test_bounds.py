"""Inputs beyond what operators once took: long lists, many languages, clashing names."""

import random

from pyspark.sql import functions as F

from tallyspark.llm import jaccard_join, language_kernel, secret_ledger, toxicity, url_cascade
from tallyspark.session import shared_dir


def test_filter_level_of_millions_of_keys(spark):
    n = 3_000_000
    keys = spark.range(n).select(F.concat(F.lit("host"), "id", F.lit(".example")).alias("key"))
    level = url_cascade.make_level(keys, n, 0.5, 0)
    assert level.bits > 1 << 22
    listed = keys.where("hash(key) % 300 = 0")
    assert listed.where(~level.has(F.col("key"))).count() == 0
    others = spark.range(4000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert 1000 < others.where(level.has(F.col("key"))).count() < 3000


def test_every_language_is_learned(spark):
    """300 languages of a few short texts, and one that has only a very long text."""
    rnd = random.Random(1)
    rows = []
    for k in range(300):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(5)]
        rows += [(len(rows) + i, " ".join(rnd.choice(words) for _ in range(30)), f"l{k}") for i in range(8)]
    rows += [(9000 + i, "ýþæ ðöl " * 40_000, "long") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_kernel.fit_model(docs)
    assert set(model.langs) == {r[2] for r in rows}
    got = dict(language_kernel.identify(docs.where("doc_id >= 9000 OR doc_id < 80"), model).select(
        "doc_id", "lang_pred").collect())
    want = {d: x for d, _, x in rows}
    assert sum(want[d] == x for d, x in got.items()) >= 0.9 * len(got) and got[9000] == "long"
    small = language_kernel.fit_model(docs, language_kernel.Fit(sample_bytes=100_000))
    assert set(small.langs) == set(model.langs)


def test_names_that_operators_use_inside(spark):
    schema = "doc_id long, text string, spans int, blob string, __spans int, own_id string, __id int, keys int, __keys int"
    rows = [(1, "password=abcdef1 a b c d", 1, "x", 2, "y", 3, 4, 5), (2, None, 1, "x", 2, "y", 3, 4, 5),
            (1, "password=abcdef1 a b c d", 1, "x", 2, "y", 3, 4, 5)]
    docs = spark.createDataFrame(rows, schema)
    out = secret_ledger.redact(docs, shared_dir(spark, "ledger-test"))
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, spark.createDataFrame(
        [(r[0], r[1] and "[secret] a b c d", *r[2:]) for r in rows], schema).collect()))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    pages = docs.withColumn("url", F.lit("http://a.net/x"))
    got = url_cascade.filter_urls(pages)
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"] and got.first()["__keys"] == 5


def test_private_keys_go_whole(spark):
    body = "\n".join("Ab+/" * 16 for _ in range(3))
    ended = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\n-----END RSA PRIVATE KEY-----"
    rows = [(1, f"a {ended} z"), (2, f"a -----BEGIN PRIVATE KEY-----\n{body}\nend of text"),
            (3, f"-----BEGIN PRIVATE KEY-----\n{body} {ended}"), (4, "-----BEGIN PRIVATE KEY----- only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(secret_ledger.redact(docs, shared_dir(spark, "ledger-test")).collect())
    assert out == {1: "a [secret] z", 2: "a [secret]\nend of text", 3: "[secret] [secret]", 4: "[secret] only"}


def test_toxicity_fit_is_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a, b = (toxicity.fit_model(d, x) for d, x in ((docs, labels), (docs.repartition(7, "text"), labels.repartition(3))))
    texts = ["you idiot", "a calm text", *[r.text for r in docs.limit(50).collect()]]
    assert [a.score(t) for t in texts] == [b.score(t) for t in texts]
