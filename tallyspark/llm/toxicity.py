"""Toxicity scores from a lexicon trie met by Levenshtein automata.

**Lexicon.** Words and word beginnings (stems) whose document frequency in toxic training texts
far exceeds that in the others, learned from a bounded sample of labelled rows.

**Matching.** All terms lie in one trie. A Levenshtein automaton of one edit runs over the whole
trie at once: a state is a set of (trie node, edits used), made deterministic step by step and
kept, so a word is read with one dictionary look-up a character and most words die after a few.
Whole words of ``fuzzy_length`` characters or more are met with one edit, also those that a stem
covers; shorter words and stems exactly. A word that clean training texts use is spelled as it
should be: it is not taken for a misspelling of a term.

**Context.** A hit inside quotation marks (paired in one scan of the whole text, however far apart), or with a reporting word (``said``, ``called``, ...)
in the few words before it, counts as quotation; a hit with a second-person word around it as
address; any other as plain. A logistic regression on the weights of these kinds of hits, learned
from the same sample, gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_crc32, read, slices, stored, subset, task_memory


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the learned parts."""
    per_class: int = 4000        # labelled rows of each class
    max_bytes: int = 1 << 16     # of a text of the sample
    max_terms: int = 2000
    least_docs: int = 4
    least_odds: float = 3.0      # log odds of a term's document frequencies
    evidence: float = 14.0       # nats against chance, for about a million candidate terms
    stem: tuple = (4, 8)
    fuzzy_length: int = 5
    known_docs: int = 2          # clean texts that make a word a spelling of its own
    window: int = 6
    ridge: float = 1e-2


FOLDS, HELD_OUT, CUT = 3, 1, 0.7     # of the contract
MAX_STATES = 50_000
WORD = re.compile(r"[^\W\d_]+")
MARKS = re.compile("[\"“”„«»]")
CLOSERS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«"}
REPORTING = frozenset("said says wrote quoted quote called calling term word shouted dijo dit sagte".split())
ADDRESS = frozenset("you your yours youre tu te vous votre du dich dein sie usted ustedes".split())
KINDS = ("plain", "address", "quoted", "fuzzy")


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of the quotations of a text, in order and apart, found in one scan.

    A mark that can close the open quotation does; else it opens one, and a quotation left open
    by then is none. A straight mark opens only before and closes only after a character that is
    not a space, and neither inside a word nor, to open, right after one (``5"``)."""
    out, opened = [], None
    for m in MARKS.finditer(text):
        mark, a, z = m.group(), m.start(), m.end()
        before, after = text[a - 1:a], text[z:z + 1]
        straight = mark == '"'
        if (opened is not None and mark in CLOSERS[text[opened]]
                and not (straight and (before.isspace() or after.isalnum()))):
            out.append((opened, z))
            opened = None
        elif mark in CLOSERS and not (straight and (before.isalnum() or not after
                                                    or after.isspace())):
            opened = a
    return out


class TrieAutomaton:
    """Terms ``{(text, is_stem): weight}`` in a trie, met by a lazily determinised Levenshtein
    automaton of at most one edit."""

    def __init__(self, terms: dict[tuple[str, bool], float], fuzzy_length: int):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.loose = [False]              # some long whole word lies below
        self.long = [False]               # this node ends a word that may have an edit
        for (text, is_stem), weight in sorted(terms.items()):
            node, path = 0, [0]
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    for part in (self.word, self.stem):
                        part.append(None)
                    self.loose.append(False)
                    self.long.append(False)
                node = self.child[node][c]
                path.append(node)
            if is_stem:
                self.stem[node] = weight
            else:
                self.word[node] = weight
                if len(text) >= fuzzy_length:
                    self.long[node] = True
                    for p in path:
                        self.loose[p] = True
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.begins: list[float | None] = []          # weight of a stem just completed
        self.ends: list[tuple[float, int] | None] = []  # (weight, edits) of a word ending here
        self.start = self._state({(0, 0)})

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("child", "word", "stem", "loose", "long")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def _state(self, pairs: set) -> int:
        """The number of a state; skipped term characters (one edit) are added first."""
        full = set(pairs)
        for node, edits in pairs:
            if not edits and self.loose[node]:
                full.update((n, 1) for n in self.child[node].values() if self.loose[n])
        key = frozenset(p for p in full if not p[1] or (p[0], 0) not in full)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            stems = [self.stem[n] for n, e in key if not e and self.stem[n] is not None]
            self.begins.append(max(stems) if stems else None)
            words = [(-e, self.word[n]) for n, e in key
                     if self.word[n] is not None and (not e or self.long[n])]
            self.ends.append((max(words)[1], -max(words)[0]) if words else None)
        return self.ids[key]

    def _advance(self, state: int, c: str) -> int:
        """The state after reading ``c``; -1 if no term can follow."""
        nxt = set()
        for node, edits in self.sets[state]:
            if c in self.child[node]:
                n = self.child[node][c]
                if not edits or self.loose[n]:
                    nxt.add((n, edits))
            if not edits and self.loose[node]:
                nxt.add((node, 1))                                     # an extra character
                nxt.update((n, 1) for n in self.child[node].values() if self.loose[n])
        got = self._state(nxt) if nxt else -1
        self.step[state][c] = got
        return got

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term of a word: a stem or an exact word before an edit."""
        state, best = self.start, None
        step, begins = self.step, self.begins
        for c in word:
            nxt = step[state].get(c)
            if nxt is None:
                nxt = self._advance(state, c)
            if nxt < 0:
                return None if best is None else (best, 0)
            state = nxt
            if begins[state] is not None:
                best = begins[state] if best is None else max(best, begins[state])
        end = self.ends[state]
        if best is None or end is not None and not end[1] and end[0] > best:
            return end
        return best, 0

    def bound(self) -> None:
        """Forget the determinised states if they have become many."""
        if len(self.sets) > MAX_STATES:
            self._reset()


class ToxicModel:
    def __init__(self, terms: dict, fit: Fit = Fit(), known: frozenset = frozenset()):
        self.fit, self.terms, self.known = fit, terms, known
        self.automaton = TrieAutomaton(terms, fit.fuzzy_length)
        self.coef, self.bias = np.zeros(len(KINDS) + 1), -2.0

    def hits(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, weight) of every hit in a text."""
        low = (text or "").lower()
        aut = self.automaton
        aut.bound()
        found = {w: m for w in set(WORD.findall(low))
                 if (m := aut.match(w)) and not (m[1] and w in self.known)}
        if not found:
            return []
        quoted = quotations(low)
        opens = [a for a, _ in quoted]
        words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
        out, span = [], self.fit.window
        for i, (w, a, z) in enumerate(words):
            if w not in found:
                continue
            weight, edits = found[w]
            before = {x[0] for x in words[max(0, i - span):i]}
            around = before | {x[0] for x in words[i + 1:i + 1 + span]}
            at = bisect_right(opens, a) - 1
            kind = ("quoted" if before & REPORTING or at >= 0 and a < quoted[at][1]
                    else "fuzzy" if edits else "address" if around & ADDRESS else "plain")
            out.append((a, z, kind, weight))
        return out

    def features(self, text: str | None) -> list[float]:
        total = Counter()
        for _, _, kind, weight in self.hits(text):
            total[kind] += weight
        n = len((text or "").split())
        return [math.log1p(total[k]) for k in KINDS] + [math.log1p(sum(total.values())) / math.log(n + 2)]

    def learn(self, rows: np.ndarray, labels: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        x = np.column_stack([rows, np.ones(len(rows))])
        w = np.zeros(x.shape[1])
        ridge = self.fit.ridge * np.eye(len(w)) * max(1, len(rows)) / 100
        ridge[-1, -1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (p - labels) + ridge @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.coef, self.bias = w[:-1], float(w[-1])

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.coef, self.features(text)) + self.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def parts_of(text: str, stem: tuple) -> set[tuple[str, bool]]:
    """The distinct words of a text, and their beginnings as stems."""
    words = set(WORD.findall(text.lower()))
    return {(w, False) for w in words} | {(w[:n], True) for w in words
                                          for n in range(stem[0], min(stem[1], len(w)) + 1)}


def sketch(text: str) -> int:
    """The smallest hash of a text's 3-word shingles: most near copies share it."""
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i:i + 3]).encode("utf-8", "surrogatepass"))
                for i in range(max(1, len(words) - 2))), default=0)


def with_sketch(batches):
    for whole in batches:
        for b in slices(whole):
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text"), b.column("toxic"),
                 pa.array([sketch(t) for t in b.column("text").to_pylist()], pa.int64())],
                names=["id", "text", "toxic", "sketch"])


def choose_terms(counts: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int,
                 fit: Fit) -> dict:
    """Terms of enough log odds (document frequencies smoothed by a half) and evidence: the
    binomial tail bound ``n KL(t / n, share)`` of finding ``t`` of its ``n`` texts toxic by
    chance. A stem is taken at its shortest telling length, if it covers more toxic texts than
    any one word of it; words that a stem covers are left out unless they may have an edit."""
    share = n_toxic / max(1, n_toxic + n_clean)
    odds = {}
    for text, is_stem, t, c in counts:
        lo = (math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1)))
        n = t + c
        kl = sum(x * math.log(x / (n * q)) for x, q in ((t, share), (c, 1 - share)) if x and q)
        if lo >= fit.least_odds and kl >= fit.evidence:
            odds[text, is_stem] = (lo, t)
    best = {}
    for (text, is_stem), (lo, t) in odds.items():
        if not is_stem:
            for n in range(fit.stem[0], len(text) + 1):
                best[text[:n]] = max(best.get(text[:n], 0), t)
    out = {}
    for (text, is_stem), (lo, t) in odds.items():
        if is_stem and ((text[:-1], True) in odds or t <= 1.2 * best.get(text, 0)):
            continue
        out[text, is_stem] = lo
    stems = {text for text, is_stem in out if is_stem}
    out = {k: lo for k, lo in out.items()
           if k[1] or len(k[0]) >= fit.fuzzy_length
           or not any(k[0][:n] in stems for n in range(fit.stem[0], fit.stem[1] + 1))}
    top = sorted(out, key=lambda k: (-odds[k][1], k))[:fit.max_terms]
    return {k: out[k] for k in top}


def known_spellings(counted: DataFrame, terms: dict, fit: Fit) -> frozenset:
    """The words of the clean texts of the sample that lie one edit from a term: the automaton
    picks them where the counts lie, so only they come to the driver."""
    automaton = TrieAutomaton(terms, fit.fuzzy_length)

    def near(batches):
        for b in batches:
            automaton.bound()
            got = [w for w in b.column(0).to_pylist() if (m := automaton.match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["term"])
    if not terms:
        return frozenset()
    words = counted.where(~F.col("stem") & (F.col("c") >= fit.known_docs)).select("term")
    return frozenset(r.term for r in words.mapInArrow(near, "term string").collect())


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), doc_id: str = "doc_id",
              text: str = "text", label: str = "toxic") -> ToxicModel:
    """Learn from labelled rows outside the held-out fold: of each class the ``per_class`` with
    the smallest hash of the id (repeated labels of one id count once, toxic if any is). Of
    texts of a class with one sketch that of the least id is kept, so copies do not pose as evidence
    for their words. The same rows give the same model, however they are dealt out."""
    marks = (subset(labels, id=doc_id, toxic=label).where("id is not null and toxic is not null")
             .where(bucket_crc32("id", FOLDS) != HELD_OUT)
             .groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .withColumn("draw", F.xxhash64(F.col("id").cast("string"), F.lit(11))))
    picked = [marks.where(F.col("toxic") == y).orderBy("draw", "id").limit(fit.per_class)
              for y in (0, 1)]
    chosen = stored(picked[0].unionByName(picked[1]), "toxic-labels")      # <= 2 per_class rows
    rows = (subset(docs, id=doc_id, text=text).where("text is not null")
            .where(F.octet_length("text") <= fit.max_bytes)
            .join(F.broadcast(chosen), "id").select(F.col("id").cast("string"), "text", "toxic"))
    rows = stored(rows.mapInArrow(with_sketch, "id string, text string, toxic int, sketch long")
                  .groupBy("sketch", "toxic").agg(F.min(F.struct("id", "text")).alias("one"))
                  .select("one.text", "toxic"), "toxic-sample")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def split(batches):
        for whole in batches:
            for b in slices(whole):
                got = Counter()
                for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                    got.update((w, s, y) for w, s in parts_of(t, fit.stem))
                cols = list(zip(*[(w, s, y, k) for (w, s, y), k in got.items()])) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.bool_(), pa.int32(),
                                                           pa.int64()))],
                    names=["term", "stem", "toxic", "n"])
    counted = stored(
        rows.select("text", "toxic").mapInArrow(split, "term string, stem boolean, toxic int, n long")
        .groupBy("term", "stem").agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
        .where((F.col("t") >= fit.least_docs) & (F.col("c") <= 0.02 * F.col("t"))
               | ~F.col("stem") & (F.col("c") >= fit.known_docs)), "toxic-terms")
    counts = (counted.where((F.col("t") >= fit.least_docs) & (F.col("c") <= 0.02 * F.col("t")))
              .orderBy(F.desc("t"), "term", "stem").limit(50 * fit.max_terms).collect())
    terms = choose_terms([tuple(r) for r in counts], n.get(1, 0), n.get(0, 0), fit)
    model = ToxicModel(terms, fit, known_spellings(counted, terms, fit))
    if len(n) == 2:
        kinds = ", ".join(f"f{i} double" for i in range(len(KINDS) + 1))

        def measure(batches):
            for b in batches:
                m = np.array([model.features(t) for t in b.column("text").to_pylist()],
                             float).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("toxic"), *[pa.array(m[:, i]) for i in range(len(KINDS) + 1)]],
                    names=["toxic"] + [f"f{i}" for i in range(len(KINDS) + 1)])
        got = np.array(sorted(tuple(r) for r in rows.select("text", "toxic")   # one order, one result
                              .mapInArrow(measure, f"toxic int, {kinds}").collect()), float)
        model.learn(got[:, 1:], got[:, 0])
    return model


def score_docs(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text",
               with_hits: bool = True) -> DataFrame:
    """``doc_id, score`` and, with ``with_hits``, ``hits`` (start, end, kind, weight in code
    points of the lower-cased text), one row per document row. Null and empty texts get the
    score of no hits; without labels of both classes the lexicon is empty and all scores are
    alike. Repeated rows and null ids stay; an empty table gives an empty result."""
    src = subset(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    hit = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()),
                              ("weight", pa.float64())]))

    def run(batches):
        with task_memory():
            for whole in batches:
                for b in slices(whole):
                    texts = b.column("text").to_pylist()
                    cols = [b.column("doc_id"), pa.array([model.score(t) for t in texts], pa.float64())]
                    if with_hits:
                        cols.append(pa.array([[dict(zip(("start", "end", "kind", "weight"), h))
                                               for h in model.hits(t)] for t in texts], hit))
                    yield pa.RecordBatch.from_arrays(
                        cols, names=["doc_id", "score"] + ["hits"] * with_hits)
    tail = ", hits array<struct<start: long, end: long, kind: string, weight: double>>"
    return src.mapInArrow(run, f"doc_id {kind}, score double" + tail * with_hits)


def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = fit_model(docs, read(spark, sf_dir, "labels"))
    held = F.coalesce(bucket_crc32("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score_docs(docs, model, with_hits=False).select(
        "doc_id", held.alias("held_out"), "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
