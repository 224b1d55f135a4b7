"""Operators that work text by text, against plain versions of their contracts."""

import random

import pytest

import brute
from conftest_llm import ODD, SMALL, docs_of, rows_of, same
from tallyspark.llm import (decontaminate, fragment_bpe, language_kernel, line_quality,
                            secret_ledger, token_files, url_cascade)
from tallyspark.session import shared_dir


def test_variable_length_coding_round_trip():
    import numpy as np
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        r = rnd.integers(0, 2**32, n, dtype=np.uint64) >> rnd.integers(0, 32, n, dtype=np.uint64)
        assert (token_files.unpack(*token_files.pack(r), n) == r.astype(np.uint32)).all()


def test_token_files_query(spark):
    got = rows_of(token_files.op1_token_files(spark, SMALL))
    assert got == brute.tokens(docs_of(spark, SMALL))


def test_token_files_odd_texts_and_small_blocks(spark):
    import public_tokenizers
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = shared_dir(spark, "t")
    tok = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(docs, tok, path, block_ids=50)
    assert rows_of(token_files.read_token_files(spark, path, digest=True)) == brute.tokens(rows)
    ids = {r.doc_id: r.ids for r in token_files.read_token_files(spark, path).collect()}
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tok)
    assert ids == {d: lib.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows}


def test_token_files_empty_repeated_and_null_ids(spark):
    import public_tokenizers
    tok, schema = public_tokenizers.path("byte_bpe_50k.json"), "doc_id long, text string"
    path = shared_dir(spark, "t")
    token_files.write_token_files(spark.createDataFrame([], schema), tok, path)
    assert token_files.read_token_files(spark, path).count() == 0
    path = shared_dir(spark, "t")
    token_files.write_token_files(
        spark.createDataFrame([(5, "a b"), (None, "x"), (5, "a b"), (5, None)], schema), tok, path)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 5]
    assert sorted(r.n_tokens for r in got) == [1, 2, 3, 3]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(4)]


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_secret_query(spark, sf):
    got = rows_of(secret_ledger.op2_secret_ledger(spark, sf))
    want = [(d, *brute.secrets(t)) for d, t in docs_of(spark, sf)]
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert [g[5] for g in got] == [w[5] for w in sorted(want)]


def test_secret_random_texts():
    rnd = random.Random(5)
    bits = ["token", "ToKen", "=", ":", " ", "secret", "api_key", "APIKEY", "'", '"', "abc", "deadbeef",
            "0123456789abcdef", "AKIA", "ABCDEFGH1", "\n", "é", "ſecret", "-", "passwd"]
    for _ in range(3000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        got = sorted((a, secret_ledger.BASE.index(r.kind), r.kind, z) for r, a, z, _ in
                     secret_ledger.scan_text(t, secret_ledger.RULES[:3]))
        assert ",".join(f"{k}:{a}:{z}" for a, _, k, z in got) == brute.secrets(t)[4], t


def test_ledger_scans_only_what_is_new(spark, monkeypatch):
    schema = "doc_id long, text string, blob string, path string"
    ledger = shared_dir(spark, "ledger")
    a = spark.createDataFrame([(1, "token=abcdefgh", "x", "y"), (2, "token=abcdefgh", "x", "y"),
                               (3, None, "x", "y"), (3, None, "x", "y"), (None, "plain", "x", "y")], schema)
    seen = secret_ledger.update(a, ledger)
    assert seen.count() == 5
    assert spark.read.parquet(f"{ledger}/scanned").count() == 3 * len(secret_ledger.RULES)
    assert spark.read.parquet(f"{ledger}/versions").count() == 4
    assert spark.read.parquet(f"{ledger}/findings").count() == 1
    # a second version of path 1: only its blob is scanned, the older version stays on record
    b = spark.createDataFrame([(1, "secret: zzzzzz token=abcdefgh", "x", "y"), (2, "token=abcdefgh", "", "")],
                              schema)
    got = secret_ledger.findings_by_path(secret_ledger.update(b, ledger), ledger)
    assert sorted((r.path, len(r.found)) for r in got.collect()) == [(1, 2), (2, 1)]
    assert spark.read.parquet(f"{ledger}/scanned").count() == 4 * len(secret_ledger.RULES)
    assert spark.read.parquet(f"{ledger}/versions").count() == 5
    # a new rule version scans every blob again for that rule alone
    newer = secret_ledger.RULES[:2] + (secret_ledger.Rule("hex", 2, r"[0-9a-f]{3,}", 0, 3),)
    again = secret_ledger.findings_by_path(secret_ledger.update(b, ledger, newer), ledger, newer)
    assert {r.path: [f.kind for f in r.found] for r in again.collect()}[2] == ["assign", "hex"]
    assert spark.read.parquet(f"{ledger}/scanned").count() == 4 * len(secret_ledger.RULES) + 2


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token=abcdef012345678901234567 b", 9), (2, None, 9), (3, "é ok", 9)],
                                 "doc_id long, text string, spans long")
    out = secret_ledger.redact(docs, shared_dir(spark, "ledger")).collect()
    assert {r.doc_id: r.text for r in out} == {1: "a [secret] b", 2: None, 3: "é ok"}
    assert out[0].asDict().keys() == {"doc_id", "text", "spans"}


def test_language_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language_kernel.op3_language_kernel(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in held)
    assert len(held) > 150 and right / len(held) > 0.95
    assert got.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_kernel_is_the_blended_spectrum(spark):
    m = language_kernel.KernelModel(["the cat sat", "der hund lief", "the dog sat"], ["a", "b", "a"])

    def plain(x, y):
        total = 0
        for n, codes in zip((1, 2, 3), m.codes):
            g = [set(language_kernel.grams(language_kernel.normal(t), n).tolist()) & set(codes.tolist())
                 for t in (x, y)]
            total += len(g[0] & g[1]) / max(1, len(g[0]) * len(g[1])) ** 0.5
        return total / 3
    texts = ["the cat ran", "Ein Hund!", "zzz"]
    p = m.presence([language_kernel.normal(t) for t in texts])
    for i, t in enumerate(texts):
        for j, mark in enumerate(["the cat sat", "the dog sat", "der hund lief"]):
            assert abs(float(p[i] @ m.land[j]) - plain(t, mark)) < 1e-5


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score double"
    docs = spark.createDataFrame([(1, None, "a", 0.0), (2, "", None, 0.0), (3, "12 !", "b", 0.0),
                                  (4, "hello there", "en", 0.0), (4, "hello there", "en", 0.0),
                                  (None, "ünï", None, 0.0)], schema)
    m = language_kernel.KernelModel(["hello you", "hallo du"], ["en", "de"])
    got = sorted(rows_of(language_kernel.identify(docs, m)), key=repr)
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3
    assert [g[1] for g in got if g[0] == 4] == ["en"] * 2 and len(got) == 6
    empty = language_kernel.fit_model(spark.createDataFrame([], schema))
    assert {r.lang_pred for r in language_kernel.identify(docs, empty).collect()} == {"und"}
    big = "hello there " * 60000          # over one lookup piece
    assert (m.presence([language_kernel.normal(big)]) ==
            m.presence([language_kernel.normal("hello there hello there")])).all()


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_quality_query(spark, sf):
    got = rows_of(line_quality.op4_line_quality(spark, sf))
    want = sorted((d, *brute.quality(t)) for d, t in docs_of(spark, sf))
    assert [g[:7] for g in got] == want


def test_quality_random_and_edges(spark):
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choice(["a ", "b ", "c ", "\n", "é\t", "\x1c", "\x85", "| "]) for _ in range(
        rnd.randint(0, 120))) for _ in range(400)]
    for t in texts:
        j = line_quality.judge(t)
        assert tuple(j[k] for k, _ in line_quality.FIELDS[:6]) == brute.quality(t), t
        assert not (j["kept"] and j["base_failed"])
    menu = "Home |\nAbout | Shop | Cart |\n" * 12
    prose = "A clean line of ordinary prose ends here.\n" * 1
    assert line_quality.judge(menu)["clean_text"].strip() == ""
    assert prose.strip() in line_quality.judge(menu + prose)["clean_text"]
    words = " ".join(f"word{i}" for i in range(200)) + "."
    assert line_quality.judge(words + "\n" + "All rights reserved 2020 x.")["kept"]
    lost = "\n".join(f"a{i} b{i} | c{i} | d{i} | e{i}" for i in range(40))
    assert not line_quality.judge(lost + "\nshort end.")["kept"]
    empty = line_quality.clean_lines(spark.createDataFrame([], "doc_id long, text string, kept int"))
    assert empty.count() == 0


def test_bpe_query(spark):
    got = rows_of(fragment_bpe.op5_fragment_bpe(spark, SMALL))
    assert got == sorted((d, *brute.bpe(t)) for d, t in docs_of(spark, SMALL))


def test_bpe_odd_texts_and_cuts(spark):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame(list(enumerate(ODD)) + [(None, "a"), (3, "again")],
                                 "doc_id long, text string").withColumnRenamed("text", "body")
    got = fragment_bpe.encode_decode(docs, path, text="body").collect()
    assert len(got) == len(ODD) + 2
    coder = fragment_bpe.FragmentBpe(path)
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            t = ODD[r.doc_id]
            assert (r.n_tokens, brute.sha(r.ids_text), brute.sha(r.decoded)) == brute.bpe(t), t
            assert coder.decode(r.ids) == r.decoded and len(r.ids) == r.n_tokens
    # fragments really are cut at pairs that no token holds, and nowhere else
    word = "zqxjqzthe"
    parts = coder.cut(word)
    assert "".join(parts) == word and len(parts) > 1
    for a, b in zip(parts, parts[1:]):
        assert not any(a[-1] + b[0] in t for t in coder.vocab)


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_decontaminate_query(spark, sf):
    got = rows_of(decontaminate.op9_decontaminate(spark, sf))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == sorted(brute.contamination(docs_of(spark, sf), items))


def test_decontaminate_random():
    rnd = random.Random(3)
    for case in range(150):
        alphabet = "ab" if case % 2 else "abcde"
        items = [(i, " ".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12)))) for i in range(6)]
        docs = [(d, " ".join(rnd.choice(alphabet + "z") for _ in range(rnd.randint(0, 40)))) for d in range(8)]
        aut = decontaminate.ItemAutomaton([(str(i), t) for i, t in items], 5)
        hit, offsets, found = aut.scan([decontaminate.words_of(t) for _, t in docs])
        got = [(d, int(z - a), int(hit[a:z].sum()), sorted({aut.names[k] for k in f}))
               for (d, _), a, z, f in zip(docs, offsets[:-1], offsets[1:], found)]
        want = brute.contamination(docs, items, 5)
        assert [(g[0], g[1], g[2], len(g[3]), brute.sha(",".join(g[3]))) for g in got] \
            == [w[:5] for w in want]


def test_decontaminate_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x ONE-two three y", 1), (3, "x ONE-two three y", 1),
                                  (None, "one two", 1)], "doc_id long, text string, items long")
    items = spark.createDataFrame([("a", "One two."), ("b", None), (None, "three"), ("c", "...")],
                                  "item_id string, text string")
    got = {(r.doc_id, r.n_hit, tuple(r.items), r.clean_text) for r in
           decontaminate.decontaminate(docs, items).collect()}
    assert got == {(1, 0, (), None), (2, 0, (), ""), (3, 3, ("a",), "x  y"), (None, 2, ("a",), "")}
    none = decontaminate.decontaminate(docs, items.where("false"))
    assert {r.n_hit for r in none.collect()} == {0}
    assert decontaminate.decontaminate(docs.where("false"), items).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, items, max_item_words=2)


def test_decontaminate_parts(spark):
    """Items beyond any one automaton: small parts and blocks give what one part gives."""
    rnd = random.Random(8)
    word = lambda: rnd.choice(["ab", "cd", "é", "f1", "gh", "i", "jk"])
    items = [(str(i % 35), " ".join(word() for _ in range(rnd.choice([2, 5, 14, 40, 300])))) for i in range(40)]
    docs = []
    for d in range(1200):
        t = [word() + rnd.choice(["", "x"]) for _ in range(rnd.randint(0, 30))]
        src = rnd.choice(items)[1].split()
        at = rnd.randrange(len(src))
        docs.append((d, " ".join(t + src[at:at + rnd.randint(0, 60)])))
    want = sorted(brute.contamination(docs, items))
    assert sum(w[2] > 0 for w in want) > 100
    left, right = (spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(items, "item_id string, text string"))
    for bounds in ({}, {"part_words": 30, "block_words": 500}, {"part_words": 1}):
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.contaminated)
               for r in decontaminate.decontaminate(left, right, **bounds).collect()]
        assert sorted(got) == want
        kept = decontaminate.drop_contaminated(left, right, **bounds).collect()
        assert sorted(r.doc_id for r in kept) == [w[0] for w in want if not w[5]]
    # over two million words, where this raised before
    many = spark.range(2_100).selectExpr(
        "cast(id as string) item_id", "repeat(concat('w', id, ' v '), 500) text")
    probe = spark.createDataFrame([(1, "w7 v " * 10), (2, "w7 w8 " * 10)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.decontaminate(probe, many).collect()}
    assert got == {1: (20, ["7"]), 2: (0, [])}


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.NET/x"), (4, "http://a.net"), (5, "x://b.Example.net/en/1?q"),
            (6, "http://example.com/de/"), (7, "http://aexample.com/de/"), (8, "http://q.org/fr/#t"),
            (9, "http://www.spam-farm.example.org?x"), (10, "://"), (11, "http://net/"), (11, "http://net/"),
            (12, "http://k.example.org/fr/2"), (13, "http://É.net/a\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "1 as rule", "2 as key")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.filter_urls(pages).collect()}
    assert got[1] == got[2] == got[10] == ("", "", None, "allow")
    assert got[3] == ("a.net", "/x", "net/", "block") and got[4] == ("a.net", "", None, "allow")
    assert got[5] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == (None, "allow")
    assert got[8] == ("q.org", "/fr/", "org/fr/", "allow")
    assert got[9][2:] == (None, "block") and got[11][2:] == ("net/", "block")
    assert got[12][2:] == ("org/fr/", "allow") and got[13][0] == "É.net"
    assert url_cascade.filter_urls(pages.where("false")).count() == 0
    assert url_cascade.filter_urls(pages).count() == len(rows)


def test_cascade_is_exact_over_its_universe(spark):
    keys = [(f"k{i}",) for i in range(4000)]
    universe = spark.createDataFrame(keys, "key string")
    listed = spark.createDataFrame(keys[::7] + keys[::7] + [("absent",), (None,)], "key string")
    c = url_cascade.build_cascade(universe, listed, 4000)
    got = {r.key for r in universe.where(c.has(universe.key)).collect()}
    assert got == {k for k, in keys[::7]} and len(c.levels) > 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_trie_automaton_matches_plain_distances():
    from tallyspark.llm.toxicity import TrieAutomaton
    rnd = random.Random(4)
    for _ in range(60):
        words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 7))) for _ in range(8)}
        stems = {"".join(rnd.choice("abc") for _ in range(4)) for _ in range(2)}
        terms = {**{(w, False): rnd.random() for w in words}, **{(x, True): rnd.random() for x in stems}}
        aut = TrieAutomaton(terms, 5)
        for _ in range(200):
            w = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 9)))
            exact = [v for (t, st), v in terms.items() if (w.startswith(t) if st else w == t)]
            near = [v for (t, st), v in terms.items()
                    if not st and len(t) >= 5 and edit_distance(t, w) <= 1]
            want = (max(exact), 0) if exact else (max(near), 1) if near else None
            assert aut.match(w) == want, (w, terms)


def test_toxicity_held_out_and_edges(spark):
    from tallyspark.llm import toxicity as X
    sf = "/root/testdata/sf0.1"
    got = X.op7_toxicity(spark, sf).alias("g")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = got.join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in held if r.toxic == 1]
    clean = [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 for r in held)


def test_toxicity_context_and_empty_tables(spark):
    from tallyspark.llm import toxicity as X
    m = X.ToxicModel({("dimwit", False): 5.0, ("blorp", True): 4.0})
    kinds = {t: [h[2] for h in m.hits(t)] for t in
             ("a dimwit came", "you dimwit", "he said dimwit", 'the "dimwit" sign', "a dimwot came", "blorpish x", "clean")}
    assert kinds == {"a dimwit came": ["plain"], "you dimwit": ["address"], "he said dimwit": ["quoted"],
                     'the "dimwit" sign': ["quoted"], "a dimwot came": ["fuzzy"], "blorpish x": ["plain"], "clean": []}
    docs = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (None, "", 2.0), (2, "x " * 200000, 0.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int, text string")
    model = X.fit_model(docs, labels)
    out = X.score_docs(docs, model).collect()
    assert len(out) == 4 and {tuple(r.hits) for r in out} == {()} and all(r.score < 0.7 for r in out)
    assert X.score_docs(docs.where("false"), model).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert X.fit_model(docs, odd).terms == {}


def test_toxicity_quotations_of_any_length_and_known_spellings():
    from tallyspark.llm import toxicity as X
    long = "word " * 300
    text = f'he put it so: "{long}\n\n{long} blockhead" and 5" of rain'
    m = X.ToxicModel({("blockhead", False): 5.0, ("trash", False): 3.0}, known=frozenset({"crash"}))
    assert [h[2] for h in m.hits(text)] == ["quoted"]
    assert X.quotations('a 5" pipe, a "b c" d') == [(13, 18)]
    assert X.quotations('an "open one\n and "a closed" one') == [(18, 28)]
    assert X.quotations("„so“ «la» »hin« “x” ”") == [(0, 4), (5, 9), (10, 15), (16, 19)]
    assert X.quotations("") == [] and X.quotations('"') == []
    many = '"a" ' * 50_000
    assert len(X.quotations(many)) == 50_000
    assert [h[2] for h in m.hits("a trsh, a crash, a trashy thing")] == ["fuzzy", "fuzzy"]


def test_toxicity_covered_words_keep_their_edit():
    from tallyspark.llm import toxicity as X
    counts = [(w[:n], True, 60, 0) for w in ("grumblor",) for n in range(4, 9)]
    counts += [("grumblors", False, 40, 0), ("grumbled", False, 30, 0), ("grum", False, 9, 0)]
    terms = X.choose_terms(counts, 100, 1000, X.Fit())
    assert ("grum", True) in terms and ("grumblors", False) in terms and ("grum", False) not in terms
    m = X.ToxicModel(terms)
    assert [h[2] for h in m.hits("grumblors and gumblors")] == ["plain", "fuzzy"]
