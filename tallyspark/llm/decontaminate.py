"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words (``A-Z`` lower-cased; runs of digits, letters and non-ASCII
characters) and all go into one word-level suffix automaton. Documents are streamed through it:
the state is the longest suffix of the words read that occurs in some item. Whenever the matched
length reaches the window (13 words), or a whole shorter item has just been read, those words are
hit. Documents are neither joined nor shuffled.

Items are cut into parts of at most ``PART_WORDS`` words (a longer item into pieces that overlap by
a window less one word, so no window is lost), which pass the driver one at a time and reach the
tasks by broadcast. A task holds a block of documents against every part: only the items with a
window (or, if shorter, all their words) in the block enter an automaton, which is built there and
never holds more words than a part; hits and items of all automata are united per row. So memory
does not follow the number of items, and no number of them is refused.

A window can only lie where every pair of neighbouring words is a pair of some item, so the
stretches without such pairs are skipped in bulk before streaming.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ship_package, slices, subset

WINDOW = 13
PART_WORDS = 200_000       # of items in one part, and in one automaton
BLOCK_WORDS = 4_000_000    # of documents held against the parts at a time (at least 512 rows)

# Bytes of words are 0-9, a-z (after lower-casing) and all of 0x80 and above.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122
               else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class ItemAutomaton:
    """Suffix automaton over the word ids of all items, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        rows = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)])
                for i, t in items]
        rows = [(i, ws) for i, ws in rows if ws]
        self.next, self.link, self.length = [{}], [-1], [0]
        for _, ws in rows:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        n = len(self.next)
        holders: list[set] = [set() for _ in range(n)]   # items with the state's strings
        shorts: list[list] = [[] for _ in range(n)]      # whole items under a window long
        for k, (_, ws) in enumerate(rows):
            state = 0
            for w in ws:
                state = self.next[state][w]
                v = state
                while v and k not in holders[v]:
                    holders[v].add(k)
                    v = self.link[v]
            if len(ws) < window:
                shorts[state].append((len(ws), k))
        self.names = [i for i, _ in rows]
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.of_window = [()] * n                         # items of the window ending here
        self.of_short: list[list] = [[] for _ in range(n)]
        for v in order:
            up = self.link[v]
            self.of_short[v] = shorts[v] + self.of_short[up]
            if self.length[v] >= window:
                self.of_window[v] = (self.of_window[up] if self.length[up] >= window
                                     else tuple(holders[v]))
        self.shortest = min([window] + [len(ws) for _, ws in rows])
        base = len(self.vocab) + 1
        self.pairs = np.unique(np.array([a * base + b for _, ws in rows
                                         for a, b in zip(ws, ws[1:])], np.int64))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:                                # an item begun before
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({}); link.append(0); length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q])); link.append(link[q]); length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def stream(self, ids, at: int, hit: np.ndarray, found: set) -> None:
        """Mark in ``hit`` (from position ``at``) the words of ``ids`` inside windows."""
        state, size, w = 0, 0, self.window
        for pos, x in enumerate(ids, at + 1):
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(x, 0)
            size = size + 1 if state else 0
            if size >= w:
                hit[pos - w:pos] = True
                found.update(self.of_window[state])
            for n, k in self.of_short[state]:
                if n <= size:
                    hit[pos - n:pos] = True
                    found.add(k)

    def scan(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set]]:
        """(hit flag of every word, offsets of the documents, items found in each)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for t in texts for w in t), np.int64, int(offsets[-1]))
        hit = np.zeros(len(ids), bool)
        found: list[set] = [set() for _ in texts]
        self.scan_ids(ids, offsets, hit, found)
        return hit, offsets, found

    def scan_ids(self, ids: np.ndarray, offsets: np.ndarray, hit: np.ndarray,
                 found: list[set]) -> None:
        """Mark hit words of the documents in ``hit``, add their items' numbers to ``found``."""
        if not len(ids) or not len(self.names):
            return
        known = np.flatnonzero(ids)
        joined = np.zeros(len(ids) + 1, bool)             # word i and i - 1 may share a window
        if len(self.pairs):
            left = known[np.isin(known + 1, known, assume_unique=True)] if len(known) else known
            keys = ids[left] * (len(self.vocab) + 1) + ids[left + 1]
            spot = np.searchsorted(self.pairs, keys)
            good = self.pairs[np.minimum(spot, len(self.pairs) - 1)] == keys
            joined[left[good] + 1] = True
        joined[offsets] = False
        starts = known[~joined[known]]
        ends = known[~joined[known + 1]] + 1
        long = ends - starts >= self.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            doc = int(np.searchsorted(offsets, a, "right")) - 1
            self.stream(ids[a:b].tolist(), a, hit, found[doc])


def pieces(text: str, window: int, part_words: int) -> Iterator[list[bytes]]:
    """The words of an item, cut where it is over ``part_words`` long."""
    words = words_of(text)
    step = max(part_words - window + 1, 1)
    for at in range(0, max(len(words) - window + 1, 1), step):
        part = words[at:at + step + window - 1]
        if part:
            yield part


def item_parts(items: DataFrame, item_id: str, text: str, window: int = WINDOW,
               part_words: int = PART_WORDS, max_item_words: int | None = None) -> list:
    """Broadcasts of the items, each of at most ``part_words`` words (or one piece of a window).
    The driver holds one part at a time. Only a caller's own ``max_item_words`` refuses items."""
    src = subset(items, item_id=item_id, text=text).where("text is not null")
    out, names, sizes, words, total = [], [], [], [], 0

    def close():
        raw = pickle.dumps((names, sizes, b" ".join(words)))
        out.append(items.sparkSession.sparkContext.broadcast(zlib.compress(raw)))

    for r in src.toLocalIterator():
        name = None if r.item_id is None else str(r.item_id)
        for piece in pieces(r.text, window, part_words):
            total += len(piece)
            if max_item_words is not None and total > max_item_words:
                raise ValueError(f"over {max_item_words} words of test items")
            if words and len(words) + len(piece) > part_words:
                close()
                names, sizes, words = [], [], []
            names.append(name)
            sizes.append(len(piece))
            words += piece
    if words:
        close()
    return out


def _grams(ids: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit number for each run of ``window`` ids; equal runs have equal numbers."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for j in range(window):
        out *= np.uint64(0xD1342543DE82EF95)
        out += mixed[j:j + n]
    return out


class Block:
    """Some rows' texts as numbers of words, to be held against all items."""

    def __init__(self, window: int):
        self.window, self.vocab = window, {}
        self.batches, self.sizes, self.ids, self.n = [], [], [], 0

    def add(self, batch: pa.RecordBatch, column: str) -> None:
        words = [words_of(t) for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        vocab = self.vocab
        n = sum(map(len, words))
        self.ids.append(np.fromiter((vocab.setdefault(w, len(vocab)) for t in words for w in t),
                                    np.int32, n))
        self.sizes.extend(map(len, words))
        self.batches.append(batch)
        self.n += n

    def _likely(self, part: bytes, grams: np.ndarray) -> Iterator[tuple[str | None, str, int]]:
        """The items of a part that can have a hit in the block, with their numbers of words."""
        w = self.window
        names, sizes, text = pickle.loads(zlib.decompress(part))
        words, sizes = text.split(), np.array(sizes, np.int64)
        ends = np.cumsum(sizes)
        flat = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        item = np.repeat(np.arange(len(names)), sizes)
        short = sizes < w
        keep = short & (np.bincount(item[flat < 0], minlength=len(names)) == 0)
        keys = _grams(flat, w)
        if len(keys) and len(grams):
            unknown = np.concatenate([[0], np.cumsum(flat < 0)])
            at = np.flatnonzero((item[:len(keys)] == item[w - 1:])
                                & (unknown[w:] == unknown[:len(keys)]))
            spot = np.minimum(np.searchsorted(grams, keys[at]), len(grams) - 1)
            keep[item[at[grams[spot] == keys[at]]]] = True
        for k in np.flatnonzero(keep).tolist():
            own = words[ends[k] - sizes[k]:ends[k]]
            yield names[k], b" ".join(own).decode("utf-8", "surrogatepass"), len(own)

    def held(self, parts: list, part_words: int) -> tuple[np.ndarray, np.ndarray, list[set]]:
        """(hit flag of every word, offsets of the rows, ids of the items found in each row)."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(np.array(self.sizes, np.int64))]).astype(np.int64)
        hit = np.zeros(len(ids), bool)
        names: list[set] = [set() for _ in self.sizes]
        pool, size = [], 0

        def scan():
            aut = ItemAutomaton(pool, self.window)
            get = aut.vocab.get
            table = np.fromiter((get(w, 0) for w in self.vocab), np.int64, len(self.vocab))
            found: list[set] = [set() for _ in self.sizes]
            aut.scan_ids(table[ids], offsets, hit, found)
            for have, f in zip(names, found):
                have.update(aut.names[k] for k in f)

        if len(ids):
            grams = np.sort(_grams(ids, self.window))
            for p in parts:
                for name, text, n in self._likely(p.value, grams):
                    if pool and size + n > part_words:
                        scan()
                        pool, size = [], 0
                    pool.append((name, text))
                    size += n
            if pool:
                scan()
        return hit, offsets, names


def blocks(batches, column: str, window: int, block_words: int) -> Iterator[Block]:
    block = Block(window)
    for part in (part for whole in batches for part in slices(whole)):
        block.add(part, column)
        if block.n >= block_words:
            yield block
            block = Block(window)
    if block.batches:
        yield block


def clean(text: str, words: list[bytes], hit: np.ndarray) -> str:
    """The text without its hit words and what lies between neighbouring hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(_TABLE)
    out, at, pos, inside = [], 0, 0, False
    for w, h in zip(words, hit.tolist()):
        start = flat.index(w, pos)
        pos = start + len(w)
        if h and not inside:
            out.append(raw[at:start])
        if h:
            at = pos
        inside = h
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  coverage_percent: int = 5, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text",
                  max_item_words: int | None = None, with_text: bool = True,
                  part_words: int = PART_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: ``n_words, n_hit, n_items, items`` (sorted as strings),
    ``contaminated`` (hit words are at least ``coverage_percent`` of all) and, if asked for,
    ``clean_text`` (hit spans removed).

    Null text has no words and is clean (``clean_text`` null). Repeated rows each get a row.
    Items without words match nothing; repeated items count once by id; an item with a null id
    marks words but is not listed. No items, or no documents, give no hits, or no rows.
    """
    parts = item_parts(items, item_id, item_text, window, part_words, max_item_words)
    src = subset(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, "
              "contaminated boolean" + (", clean_text string" if with_text else ""))

    def run(batches):
        for block in blocks(batches, "text", window, block_words):
            hits, ends, found = block.held(parts, part_words)
            total = np.concatenate([[0], np.cumsum(hits)])
            row = 0
            for b in block.batches:
                offsets = ends[row:row + b.num_rows + 1]
                n_words = np.diff(offsets)
                n_hit = total[offsets[1:]] - total[offsets[:-1]]
                names = [sorted(f - {None}) for f in found[row:row + b.num_rows]]
                cols = [b.column("doc_id"), pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array((n_hit > 0) & (100 * n_hit >= coverage_percent * n_words))]
                if with_text:
                    cols.append(pa.array([
                        clean(t, words_of(t), hits[a:z]) if n else t for t, a, z, n in
                        zip(b.column("text").to_pylist(), offsets[:-1], offsets[1:], n_hit)],
                        pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[
                    "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
                    + ["clean_text"] * with_text)
                row += b.num_rows
    return src.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                      coverage_percent: int = 5, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", max_item_words: int | None = None,
                      part_words: int = PART_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (all columns) without the contaminated rows; the others stay as they are."""
    parts = item_parts(items, item_id, item_text, window, part_words, max_item_words)
    ship_package(docs.sparkSession)

    def run(batches):
        for block in blocks(batches, text, window, block_words):
            hits, ends, _ = block.held(parts, part_words)
            total = np.concatenate([[0], np.cumsum(hits)])
            n_hit = total[ends[1:]] - total[ends[:-1]]
            keep = (n_hit == 0) | (100 * n_hit < coverage_percent * np.diff(ends))
            row = 0
            for b in block.batches:
                yield b.filter(pa.array(keep[row:row + b.num_rows]))
                row += b.num_rows
    return docs.mapInArrow(run, docs.schema)


def op9_decontaminate(spark, sf_dir):
    got = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"),
                        with_text=False)
    return got.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      "contaminated")
