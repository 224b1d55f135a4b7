"""Operators that compare texts, against plain versions of their contracts."""

import random

import numpy as np
import pytest

import brute
from conftest_llm import ODD, SMALL, docs_of, rows_of
from tallyspark.llm import graph, jaccard_join


def near_copies(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(50):
        n = rnd.choice([2, 5, 9, 10, 11, 12, 14, 15, 16, 18, 23, 24, 30, 60, 100])
        base = [rnd.choice("abcdefghij") + str(rnd.randint(0, 40)) for _ in range(n + 2)]
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                i, op = rnd.randrange(len(w)), rnd.random()
                if op < .4:
                    w[i] = f"x{rnd.randint(0, 3)}"
                elif op < .7:
                    w.insert(i, f"y{rnd.randint(0, 3)}")
                elif len(w) > 1:
                    del w[i]
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
            if rnd.random() < .5:
                base = w
    return rows + [(2000 + i, t) for i, t in enumerate([*ODD, "A b", "a B", "z"])]


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_jaccard_query(spark, sf):
    assert rows_of(jaccard_join.op6_jaccard_join(spark, sf)) == sorted(brute.links(docs_of(spark, sf)))


@pytest.mark.parametrize("tile", [jaccard_join.TILE, 300, 60])
def test_jaccard_near_copies_and_tiles(spark, tile):
    rows = near_copies(tile)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(jaccard_join.link(docs, tile=tile)) == sorted(brute.links(rows))


def test_jaccard_of_five_words_and_eighty_percent(spark):
    rows = near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(jaccard_join.link(docs, 5, percent=80)) == sorted(brute.links(rows, 5, 80))
    rows = docs_of(spark, SMALL)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard_join.link(docs, 5, percent=80)) == sorted(brute.links(rows, 5, 80))


@pytest.mark.parametrize("piece", [jaccard_join.PIECE, 64, 7])
def test_word_hashes_tell_words_apart(monkeypatch, piece):
    """Equal words (A-Z as a-z) have equal hashes and others differ, wherever pieces are cut."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abAB01é日\x1c\xa0") for _ in range(rnd.choice([1, 2, 3, 8, 40, 3000])))
             for _ in range(1500)]
    text = "".join(w + rnd.choice(" \t\n\x0b\x0c\r") * rnd.randint(1, 3) for w in words)
    monkeypatch.setattr(jaccard_join, "PIECE", piece)
    got = [jaccard_join.word_hashes(t).tolist() for t in (text, " " + text.rstrip(), *ODD)]
    plain = [(t or "").encode().lower().split() for t in (text, text, *ODD)]
    assert list(map(len, got)) == list(map(len, plain)) and got[0] == got[1]
    pairs = {(h, w) for hs, ws in zip(got, plain) for h, w in zip(hs, ws)}
    assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs}) > 1000


@pytest.mark.parametrize("percent", [90, 80, 55])
def test_prefixes_hold_the_needed_shingles(percent):
    """Prefixes of sets at the edge of the similarity share what is needed, whatever differs."""
    rnd = np.random.default_rng(3)
    for _ in range(2000):
        n = int(rnd.integers(2, 400))
        s = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(rnd.integers(0, n * (100 - percent) // 100 + 1))
        t = np.sort(rnd.permutation(s)[drop:])
        while True:
            more = np.unique(np.append(t, rnd.integers(0, 2**64, 1, dtype=np.uint64)))
            inter = len(np.intersect1d(s, more))
            if 100 * inter < percent * (len(s) + len(more) - inter) or rnd.random() < .05:
                break
            t = more
        inter = len(np.intersect1d(s, t))
        if len(t) and 100 * inter >= percent * (len(s) + len(t) - inter) and not np.array_equal(s, t):
            x, y = (v[:jaccard_join.prefix_size(len(v), percent)] for v in (s, t))
            assert len(np.intersect1d(x, y)) >= max(jaccard_join.needed(len(v), percent) for v in (s, t)) >= 1


def test_jaccard_edges(spark):
    schema = "doc_id long, text string, node long, component_id string"
    rows = [(1, None, 1, ""), (None, "a b c d", 1, ""), (7, "a b c d", 1, ""), (7, "a b c d", 1, ""),
            (3, "", 1, ""), (None, "q r s", 1, ""), (9, "A b C d", 1, "")]
    got = sorted(map(tuple, jaccard_join.link(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (None, 2, 7), (7, 2, 7), (7, 2, 7), (3, 0, 3), (None, 1, None), (9, 2, 7)],
                         key=repr)
    assert jaccard_join.link(spark.createDataFrame([], schema)).count() == 0
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(1, None), (3, ""), (7, "a b c d")] \
        if all(r.text is not None for r in kept if r.doc_id == 3) else False
    assert sum(r.doc_id is None for r in kept) == 2 and kept[0].asDict().keys() == {
        "doc_id", "text", "node", "component_id"}


def test_components(spark):
    rnd = random.Random(1)
    for n in (0, 1, 40, 400):
        edges = [(rnd.randint(-50, 200), rnd.randint(-50, 200)) for _ in range(n)] + [(i, i + 1) for i in range(1000, 1000 + n)]
        df = spark.createDataFrame(edges or [(1, 1)], "a long, b long")
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x
        for a, b in edges:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
        want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
        got = {r.node: r.comp for r in graph.components(df).collect()}
        assert got == want


def test_loser_tree_merges_runs_with_exact_prefixes():
    from tallyspark.llm.suffix_dedup import LoserTree, front_code, front_decode, shared
    rnd = random.Random(6)
    for _ in range(300):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 7)))
                for _ in range(rnd.randint(0, 6))]
        coded = [front_code(r) if r else ([], [], b"") for r in runs]
        out = list(LoserTree([((s, n, None) for s, n in front_decode(*c)) for c in coded]))
        assert [x[0] for x in out] == sorted(s for r in runs for s in r)
        assert [x[1] for x in out[1:]] == [shared(a[0], b[0], 0) for a, b in zip(out, out[1:])]


def test_repeats_query(spark):
    from tallyspark.llm import suffix_dedup
    got = suffix_dedup.op8_suffix_dedup(spark, SMALL)
    assert rows_of(got.drop("n_shared")) == sorted(brute.repeats(docs_of(spark, SMALL)))


def test_shared_passages_too_short_to_remove(spark):
    """A passage of 54 words is reported wherever it stands in a text; texts of other words and
    repeats of few words are not."""
    from tallyspark.llm import suffix_dedup as S
    rnd = random.Random(4)

    def prose(n):
        return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(n))
    passage, line = prose(54), prose(10)
    assert 319 <= len(passage) < 400
    rows = [(i, prose(rnd.randint(0, 300)) + " " + (passage if i < 40 else line) + (" " + prose(i) if i % 3 else ""))
            for i in range(100)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in got if r.n_shared} == set(range(40)) and {r.n_removed for r in got} == {0}


@pytest.mark.parametrize("seed", range(4))
def test_repeats_random(spark, seed, monkeypatch):
    """Small strings and reaches, small runs and buckets, both ways of judging a key."""
    from tallyspark.llm import suffix_dedup as S
    rnd = random.Random(seed)
    monkeypatch.setattr(S, "RUN_ENTRIES", 7)
    monkeypatch.setattr(S, "BUCKET_ENTRIES", 9)
    monkeypatch.setattr(S, "PAIRS_UP_TO", 2 if seed % 2 else 32)
    size, reach = ((20, 8), (24, 16), (40, 16), (33, 2))[seed]
    alphabet = "ab" if seed == 1 else "abcdefgh é"
    pool = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(size // 2, 3 * size))) for _ in range(6)]
    rows = []
    for d in range(60):
        t = "".join(rnd.choice([rnd.choice(pool), "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))])
                    for _ in range(rnd.randint(0, 5)))
        rows.append((d, t))
    rows += [(70, "a" * 200), (71, ""), (72, "ab" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = rows_of(S.remove_repeats(docs, size=size, reach=reach, digest=True).drop("n_shared"))
    assert got == sorted(brute.repeats(rows, size))


def test_repeats_edges(spark):
    from tallyspark.llm import suffix_dedup as S
    schema = "doc_id long, text string, uid string, spans int"
    same = "x" * 100 + "".join(chr(97 + i * i % 23) for i in range(400))
    rows = [(1, None, "", 0), (2, same, "", 0), (2, same, "", 0), (None, "short", "", 0), (3, "A" * 5000, "", 0)]
    got = {r.doc_id: tuple(r)[1:-1] for r in S.remove_repeats(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (0, 0, 0, b"") and got[2] == (500, 500, 1, b"") and got[None] == (5, 0, 0, b"short")
    assert got[3] == (5000, 5000, 1, b"")
    assert S.remove_repeats(spark.createDataFrame([], schema)).count() == 0


def test_both_ways_of_judging_a_key_agree():
    from tallyspark.llm import suffix_dedup as S
    rnd = random.Random(8)
    size, reach = 20, 8
    for _ in range(200):
        entries = {}
        for _ in range(rnd.randint(2, 12)):
            left = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, reach - 1)))
            right = "k" * 13 + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7)))
            entries[right.encode(), left.encode()] = rnd.choice([1, 1, 2])
        keys = sorted(entries)
        rights, lefts = zip(*keys)
        lcps = [0] + [S.shared(a, b, 0) for a, b in zip(rights, rights[1:])]
        many = [entries[k] for k in keys]
        a = S._flags_by_pairs(rights, lcps, lefts, many, size, reach)
        b = S._flags_by_offset(rights, lcps, lefts, many, size, reach)
        assert (a == b).all()
        strings = [[l[len(l) - o:] + r[:size - o] if o <= len(l) and size - o <= len(r) else None
                    for o in range(reach)] for r, l in keys]
        for o in range(reach):
            col = [s[o] for s in strings]
            for i, s in enumerate(col):
                total = sum(m for x, m in zip(col, many) if x == s)
                assert a[i, o] == (s is not None and total > 1)
