"""Ranked search, Merkle manifest and WARC archives, against plain versions of their contracts."""

import gzip
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest_llm import ODD, SMALL, docs_of, same
from tallyspark.llm import lexical_search, merkle_manifest, warc
from tallyspark.plans.inspect import python_nodes
from tallyspark.session import shared_dir

MID = "/root/testdata/sf0.01"


def tuples(df):
    return [tuple(r) for r in df.collect()]


def items_of(spark, sf):
    return tuples(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"))


# Ranked search

@pytest.mark.parametrize("sf", [SMALL, MID])
def test_search_query(spark, sf):
    got = tuples(lexical_search.op11_ranked_search(spark, sf))
    assert sorted(got) == sorted(brute.ranked(docs_of(spark, sf), items_of(spark, sf)))


def crowd(seed, n):
    """Texts with shared beginnings, copies and ties."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < .4:
            t = rnd.choice(out)[1]
            t = t + f" w{rnd.randint(0, 60)}" if rnd.random() < .5 else t
        else:
            t = " ".join(f"W{min(rnd.randint(0, 60), rnd.randint(0, 60))}" for _ in range(rnd.randint(0, 40)))
        out.append((i * 37 % 1009, t))
    return out


@pytest.mark.parametrize("cells,leaf,part", [(1 << 24, 48, 1 << 14), (1 << 12, 4, 40), (1, 1, 1)])
def test_search_blocks_leaves_and_parts(spark, cells, leaf, part):
    rows = crowd(1, 300) + [(2000 + i, t) for i, t in enumerate(ODD)]
    items = [(i, t) for i, t in enumerate(["w1 w2 w3", "w0", None, "", "w59 w60 zzz", "don't İstanbul é b", "w5 W5 w5"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 10, 1000):
        got = tuples(lexical_search.search(docs, asked, k, cells=cells, leaf=leaf, part_terms=part))
        assert sorted(got) == sorted(brute.ranked(rows, items, k))
        if part == 1:
            break


def test_search_edges(spark):
    rows = [(None, "a b", 1, ""), (3, "a b", 1, ""), (3, "a b", 1, ""), (2, None, 1, ""), (9, "c", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, uid string")
    items = spark.createDataFrame([("x", "a", 1), ("x", "a", 1), (None, "c a", 2)], "item_id string, text string, rank int")
    got = [(r.item_id, r["rank"], r.doc_id) for r in lexical_search.search(docs, items).collect()]
    one = [("x", 1, 3), ("x", 2, 3), ("x", 3, None)]
    assert same(got, one + one + [(None, 1, 9), (None, 2, 3), (None, 3, 3), (None, 4, None)])
    none = spark.createDataFrame([], docs.schema)
    assert tuples(lexical_search.search(none, items)) == [] and tuples(
        lexical_search.search(docs, items.limit(0))) == []


def test_search_long_text(spark):
    text = "far " * 700_000 + "near"                       # over two pieces
    docs = spark.createDataFrame([(1, text), (2, "near far")], "doc_id long, text string")
    rows = [(1, text), (2, "near far")]
    asked = [(0, "near"), (1, "far")]
    got = tuples(lexical_search.search(docs, spark.createDataFrame(asked, "item_id long, text string")))
    assert sorted(got) == sorted(brute.ranked(rows, asked))


def test_tree_bounds_hold_and_cut():
    """No document scores above the bound of a node it lies below, and a good threshold cuts."""
    rnd = np.random.default_rng(1)
    n_terms, docs = 40, []
    for _ in range(600):
        docs.append(np.flatnonzero(rnd.random(n_terms) < np.linspace(.9, .02, n_terms)))
    sizes = np.array([len(d) for d in docs])
    flat = np.concatenate(docs)
    tf = rnd.integers(1, 9, len(flat))
    m = rnd.integers(10, 400, len(docs))
    tree = lexical_search.DocumentTree(flat, tf, sizes, m, n_terms, 8)
    leaves = [(a, z) for a, z, c in zip(tree.low, tree.high, tree.children) if not c]
    assert sorted(leaves)[0][0] == 0 and sum(z - a for a, z in leaves) == len(docs) and len(leaves) > 40
    terms, weight = np.array([3, 30, 39]), np.array([100, 3000, 5000])
    bound = lexical_search.part_scores(tree.most[:, terms], tree.least, weight)
    score = lexical_search.part_scores(tree.tf[:, terms], tree.m, weight)
    for node in range(len(tree.low)):
        assert score[tree.low[node]:tree.high[node]].max() <= bound[node]
    best = lexical_search.Best(5)
    best.block(list(range(len(docs))), np.arange(len(docs)))
    scored = tree.search(terms, weight, best)
    assert [s for s, _ in best.rows] == sorted(score.tolist(), reverse=True)[:5] and scored < len(leaves) / 2


# Merkle manifest

def tampered(r):
    if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
        return (*r[:4], r[4].replace("\n", ""))
    return r


@pytest.mark.parametrize("sf", [SMALL, MID])
def test_manifest_query(spark, sf):
    rows = tuples(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text"))
    assert sorted(tuples(merkle_manifest.op12_merkle_manifest(spark, sf))) == sorted(brute.merkle(rows, tampered))


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_odd_rows(spark, height):
    """Sources of 1 to 400 leaves (one holds most), null and empty fields, repeated rows."""
    rnd = random.Random(height)
    rows = [(i, f"s{min(12, int(rnd.expovariate(.9)))}", rnd.choice(["en", "", None]), rnd.choice([None, 5]),
             rnd.choice(ODD)) for i in range(500)]
    rows += [(1000 + i, x, "en", 3, "a\nb") for i, x in enumerate([None, None, "", "alone", "é", "\U0001f600", "￿"])]
    rows += rows[:5] + [(None, "s0", "en", 1, "n\n"), (None, None, None, None, None), (2**60 + 1, "s0", "x", 1, "big")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame([(*r, 1, "") for r in rows], schema + ", tree int, node string").repartition(5)
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    told = {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    got = tuples(merkle_manifest.manifest(docs, claim=told, height=height, digest=True))
    assert same(got, brute.merkle(rows, tampered))
    plain = merkle_manifest.manifest(docs, height=height)
    assert plain.where("not verified").count() == 0
    for r in plain.limit(40).collect():
        assert merkle_manifest.fold(r.leaf, r.proof) == r.root


def test_manifest_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert tuples(merkle_manifest.manifest(spark.createDataFrame([], schema))) == []
    for rows in ([(1, "a", "en", 1, "x")], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "y\n")],
                 [(1, None, None, None, "long " * 400_000 + "\n")]):
        got = tuples(merkle_manifest.manifest(spark.createDataFrame(rows, schema), digest=True))
        assert same(got, brute.merkle(rows, lambda r: r))


# WARC archives

@pytest.mark.parametrize("sf", [SMALL, MID])
def test_warc_query(spark, sf):
    rows = tuples(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"))
    assert sorted(tuples(warc.op13_warc(spark, sf)), key=repr) == sorted(brute.archived(rows), key=repr)


def pages(rows):
    return "page_id long, url string, html string, file string, low int", [(p, u, t, "x", 1) for p, u, t in rows]


@pytest.mark.parametrize("range_bytes,least", [(1 << 24, 0), (900, 5)])
def test_warc_round_trip(spark, range_bytes, least):
    rnd = random.Random(range_bytes)
    rows = [(i, rnd.choice([None, "http://a/\r\nb é", "http://x"]), rnd.choice(ODD)) for i in range(60)]
    rows += [(None, None, "a"), (None, "u", "only null"), (None, "u", "only null"), (7, "u", "w" * 3000),
             (2**60 + 1, "u", "a"), (-5, "u", "minus"), (900, "u", "".join(map(chr, range(0x4e00, 0x9000))))]
    rows += [(3, "u", "twice"), (3, "u", "twice"), (2, "u", "twice")]
    schema, data = pages(rows)
    path = shared_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(data, schema).repartition(3), path, min_bytes=least)
    got = warc.payloads(warc.read_warc(spark, path, range_bytes=range_bytes)).where("record_type <> 'warcinfo'")
    out = [(None if r.key is None else int(r.key), r.payload_bytes, r.payload_digest, r.record_type,
            None if r.refers_to_key is None else int(r.refers_to_key), bytes(r.payload).decode()) for r in got.collect()]
    want = [(*a, t or "") for a, (_, _, t) in zip(brute.archived([(p, t) for p, _, t in rows], least), rows)]
    assert same(out, want)
    assert {r.url for r in got.select("url").distinct().collect()} == {None, "http://a/ b é", "http://x", "u"}


def test_warc_stray_and_empty(spark):
    schema, data = pages([(1, "u", "a"), (2, "v", "b")])
    path = shared_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(data, schema), path)
    with open(f"{path.replace('file:', '')}/part-000000-lost.warc.gz", "wb") as f:
        f.write(b"\x1f\x8b\x08 half a member of a lost attempt")
    assert warc.read_warc(spark, path).where("record_type = 'response'").count() == 2
    empty = shared_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], schema), empty)
    assert warc.read_warc(spark, empty).count() == 0


@pytest.mark.parametrize("range_bytes", [1 << 24, 997, 100])
def test_warc_archive_inside_a_payload(spark, range_bytes):
    """A foreign archive: stored members that hold archives and gzip magic, padding, no index."""
    def stored_member(data):
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    def plain(kind, body, i):
        head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"
    inner = b"".join(gzip.compress(plain("resource", b"inner %d" % i, 100 + i)) for i in range(30))
    bodies = [b"one", inner, warc.MAGIC * 200, b"", os.urandom(3000), inner + b"tail", b"last"]
    path = shared_dir(spark, "warc-test")
    with open(f"{path.replace('file:', '')}/a.warc.gz", "wb") as f:
        for i, b in enumerate(bodies):
            f.write(stored_member(plain("resource", b, i)) + (b"\0" * 9 if i == 2 else b""))
    got = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, path, range_bytes=range_bytes).collect()}
    assert got == {f"<urn:x:{i}>": b for i, b in enumerate(bodies)}


def test_native_query_runs_no_python(spark):
    from tallyspark.llm import url_cascade
    assert python_nodes(url_cascade.op10_url_filter(spark, SMALL)) == []
