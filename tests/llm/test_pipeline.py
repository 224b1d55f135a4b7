"""The pipeline against plain versions of its stages."""

import re

import brute
import corpus_pipeline
from conftest_llm import ODD, SMALL


def plain(rows, items):
    """(doc_id, n_tokens) of what the stages keep, from (doc_id, text) rows of distinct ids."""
    rows = [(d, t) for d, t in rows if t is not None and any(map(str.isalpha, t))]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, brute.links(rows, 5, 80)) if c == d]
    rows = [(d, t) for (d, t), c in zip(rows, brute.contamination(rows, items)) if not c[5]]
    out = []
    for d, t in rows:
        spans = [(int(a), int(z)) for _, a, z in (x.split(":") for x in brute.secrets(t)[4].split(",") if x)]
        spans += [m.span() for m in re.finditer(
            r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----(?:(?:[^-]|-(?!-))*-----END \1PRIVATE KEY-----"
            r"|(?:\s+[A-Za-z0-9+/=]{16,})*)", t)]
        made, at = "", 0
        for a, z in sorted(spans):
            if a >= at:
                made += t[at:a] + "[secret]"
            at = max(at, z)
        made += t[at:]
        out.append((d, *brute.bpe(made)))
    return sorted(out)


def got_of(df):
    return sorted((r.doc_id, r.n_tokens, brute.sha(" ".join(map(str, r.ids))), brute.sha(r.decoded))
                  for r in df.collect())


def test_pipeline_matches_plain_stages(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert got_of(corpus_pipeline.run(spark, SMALL)) == plain(docs, items)


def test_stages_on_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, score int"
    texts = [*ODD, "password = hunter22 here", "same words in this text of copies", "same words in this text of copies"]
    rows = [(i, t, None, None, None, "x", None) for i, t in enumerate(texts)] + [(None, "null id", "en", None, 1, "", 1)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.dtypes == docs.dtypes, name
            docs = spark.createDataFrame(out.collect(), schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert last.count() == docs.count()
        if table:
            left = {r.doc_id: r.text for r in docs.collect()}
            assert None in left and len(texts) - 1 not in left and len(texts) - 2 in left
            assert left[len(texts) - 3] == "[secret] here" and 0 not in left
