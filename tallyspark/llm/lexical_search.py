"""Ranked lexical search by branch and bound over FP-trees of documents.

Every item is a query against all documents. Documents are reduced to *restricted* vectors, the
(term, tf) pairs of terms that some item has, and sorted by their terms in order of corpus
frequency, the most frequent first: documents that begin with the same terms then share a path
of a trie (an FP-tree). A task builds one tree for each block of documents it reads; a node
covers the documents of its path and holds, for every term, the greatest tf below it, and the
least m. As a term's part of a score grows with tf and falls with m, these bound every score
below the node. Per item, the tree is searched depth first, the best bound first; nodes whose
bound is below the item's k-th best score so far are cut off, leaves are scored exactly.

* A path is followed no further than ``LEAF`` documents: smaller neighbours are one leaf.
* A block's dense tf table is bounded by ``CELLS``, whatever the number of terms.
* The best k of a task go on to one last ranking per item: ``tasks x k`` rows an item.
* Items travel in parts of about ``PART_TERMS`` words, one pass over the documents a part, so any
  number of items works in bounded memory; corpus counts cover all documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, slices, stored, subset, task_memory

LEAF = 48                 # documents scored at once
CELLS = 1 << 24           # tf table of a block: documents x terms
PART_TERMS = 1 << 14      # words of items searched in one pass
PIECE = 1 << 20           # bytes of a text split into words at a time

# Bytes of words stay (A-Z as a-z), all others part words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
              for b in range(256))


def words(text: str | None):
    """Lists of the words of a text, piece by piece."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def part_scores(tf, m, weight):
    """Scores by the contract's integers: ``tf`` (rows x terms), ``m`` (rows), ``weight`` (terms)."""
    tf = tf.astype(np.int64)
    return (weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None]))).sum(axis=1)


class DocumentTree:
    """FP-tree of a block. ``flat`` are term ranks (0: most frequent), ascending in each document,
    ``tf`` their counts, ``sizes`` the terms of each document, ``m`` its length term. Documents
    are renumbered in the order of their paths: ``order[i]`` is the block's number of the i-th."""

    def __init__(self, flat, tf, sizes, m, n_terms: int, leaf: int = LEAF):
        ends = np.cumsum(sizes)
        starts = ends - sizes
        path = flat.astype(">u4").tobytes()
        keys = [path[4 * a:4 * z] for a, z in zip(starts.tolist(), ends.tolist())]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        place = np.empty(len(keys), np.int64)
        place[self.order] = np.arange(len(keys))
        self.tf = np.zeros((len(keys), n_terms), np.int32)
        self.tf[np.repeat(place, sizes), flat] = tf
        self.m = m[self.order]
        self._flat, self._starts, self._sizes = flat, starts[self.order], sizes[self.order]
        self.low, self.high, self.children = [], [], []
        self._grow(leaf)
        self._bound()

    def _node(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.low) - 1

    def _grow(self, leaf: int) -> None:
        todo = [self._node(0, len(self.order))]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= leaf:
                continue
            # sorted paths: what the first and the last share, all share
            first, last = (self._flat[self._starts[i]:self._starts[i] + self._sizes[i]]
                           for i in (low, high - 1))
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[:n] != last[:n])
            depth = int(differ[0]) if len(differ) else n
            if depth == len(first) == len(last):
                continue                                   # one path: a leaf of any size
            at = self._starts[low:high] + depth
            has = self._sizes[low:high] > depth
            following = np.full(high - low, -1, np.int64)
            following[has] = self._flat[at[has]]
            cuts = [low, *(low + 1 + np.flatnonzero(np.diff(following))).tolist(), high]
            begin = None                                   # small neighbours share a leaf
            for a, z in zip(cuts, cuts[1:]):
                if z - a > leaf:
                    if begin is not None:
                        self.children[node].append(self._node(begin, a))
                        begin = None
                    self.children[node].append(self._node(a, z))
                    todo.append(self.children[node][-1])
                elif begin is None:
                    begin = a
                elif z - begin > leaf:
                    self.children[node].append(self._node(begin, a))
                    begin = a
            if begin is not None:
                self.children[node].append(self._node(begin, high))

    def _bound(self) -> None:
        """Greatest tf of every term and least m below every node: leaves from their documents,
        inner nodes from their children (which have greater numbers)."""
        self.most = np.zeros((len(self.low), self.tf.shape[1]), np.int32)
        self.least = np.zeros(len(self.low), np.int64)
        for node in range(len(self.low) - 1, -1, -1):
            below = self.children[node]
            if below:
                self.most[node] = self.most[below].max(axis=0)
                self.least[node] = self.least[below].min()
            else:
                a, z = self.low[node], self.high[node]
                self.most[node] = self.tf[a:z].max(axis=0)
                self.least[node] = self.m[a:z].min()

    def search(self, terms, weight, best: Best) -> int:
        """Offers ``best`` every document that can be among its k; the number of leaves scored."""
        bound = part_scores(self.most[:, terms], self.least, weight).tolist()
        stack, scored = [0], 0
        while stack:
            node = stack.pop()
            if bound[node] < best.floor:
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bound.__getitem__)
            else:
                a, z = self.low[node], self.high[node]
                best.offer(part_scores(self.tf[a:z, terms], self.m[a:z], weight), self.order[a:z])
                scored += 1
        return scored


class Best:
    """The k best (score, document) of an item; equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor, self.ids, self.rank = k, [], 1, None, None

    def block(self, ids: list, rank) -> None:
        """The ids of the documents offered next, and their order."""
        self.ids, self.rank = ids, rank

    def offer(self, scores, docs) -> None:
        ok = np.flatnonzero(scores >= self.floor)
        if not len(ok):
            return
        ok = ok[np.lexsort((self.rank[docs[ok]], -scores[ok]))[:self.k]]
        self.rows += [(int(s), self.ids[d]) for s, d in zip(scores[ok], docs[ok])]
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.floor = self.rows[-1][0]


def restricted(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """One row a document with words (kind ``doc``: ``doc_id, n`` and its ``terms`` and ``tf`` of
    the vocabulary) and one a task (kind ``sum``: ``n`` all words, ``n_docs``, and document
    frequencies)."""
    id_type = docs.schema["doc_id"].dataType
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    names = ["kind", "doc_id", "n", "n_docs", "terms", "tf"]

    def run(batches):
        df, n_docs, total = np.zeros(len(vocabulary), np.int64), 0, 0
        kind = None
        with task_memory():
            for whole in batches:
                kind = whole.schema.field("doc_id").type
                for b in slices(whole):
                    keep, n, terms, tf = [], [], [], []
                    for i, text in enumerate(b.column("text").to_pylist()):
                        count, size = Counter(), 0
                        for some in words(text):
                            size += len(some)
                            count.update(map(vocabulary.get, some))
                        if not size:
                            continue
                        count.pop(None, None)
                        total, n_docs = total + size, n_docs + 1
                        keep.append(i)
                        n.append(size)
                        terms.append(list(count))
                        tf.append(list(count.values()))
                        df[terms[-1]] += 1
                    if keep:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(["doc"] * len(keep)), b.column("doc_id").take(pa.array(keep)),
                             pa.array(n, pa.int64()), pa.array([None] * len(keep), pa.int64()),
                             pa.array(terms, ints), pa.array(tf, longs)], names=names)
        if kind is not None:
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["sum"]), pa.nulls(1, kind), pa.array([total], pa.int64()),
                 pa.array([n_docs], pa.int64()), pa.array([some], ints), pa.array([df[some]], longs)],
                names=names)
    return docs.mapInArrow(run, f"kind string, doc_id {id_type.simpleString()}, n long, n_docs long, "
                                "terms array<int>, tf array<long>")


def search_part(docs: DataFrame, part: list, k: int, cells: int = CELLS, leaf: int = LEAF) -> DataFrame | None:
    """The best k documents a task of every (uid, words) of ``part``."""
    vocabulary: dict = {}
    for _, terms in part:
        for t in terms:
            vocabulary.setdefault(t, len(vocabulary))
    vectors = stored(restricted(docs, vocabulary), "restricted-vectors", ["kind"])
    sums = vectors.where("kind = 'sum'")
    whole = sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")).first()
    if not whole.n_docs:
        return None
    n_docs, n_words = whole.n_docs, whole.n
    df = np.zeros(len(vocabulary), np.int64)
    for r in (sums.select(F.explode(F.arrays_zip("terms", "tf")).alias("x"))     # <= the vocabulary
              .groupBy("x.terms").agg(F.sum("x.tf").alias("df")).collect()):
        df[r.terms] = r.df
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    queries = []
    for uid, terms in part:
        ids = np.array([vocabulary[t] for t in terms], np.int64)
        ids = ids[(df[ids] > 0) & (weight[ids] > 0)]
        if len(ids):
            queries.append((uid, rank[ids], weight[ids]))
    n_terms = len(df)
    block = max(leaf, cells // max(1, n_terms))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        found = [Best(k) for _ in queries]
        kind = None
        with task_memory():
            held: list = []

            def search(held):
                b = pa.Table.from_batches(held).combine_chunks()
                terms = b.column("terms").combine_chunks()
                sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
                flat = rank[terms.flatten().to_numpy()]
                tf = b.column("tf").combine_chunks().flatten().to_numpy()
                # ranks ascending within each document
                by = np.argsort(np.repeat(np.arange(len(sizes)), sizes) * n_terms + flat)
                m = 10 + (90 * b.column("n").to_numpy() * n_docs) // n_words
                tree = DocumentTree(flat[by], tf[by], sizes, m, n_terms, leaf)
                ids = b.column("doc_id").to_pylist()
                place = np.empty(len(ids), np.int64)
                place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))] = \
                    np.arange(len(ids))
                for (_, q, w), best in zip(queries, found):
                    best.block(ids, place)
                    tree.search(q, w, best)
            size = 0
            for whole in batches:
                kind = whole.schema.field("doc_id").type
                for b in slices(whole, block):
                    if size + b.num_rows > block:
                        search(held)
                        held, size = [], 0
                    held.append(b)
                    size += b.num_rows
            if held:
                search(held)
            rows = [(uid, d, s) for (uid, _, _), best in zip(queries, found) for s, d in best.rows]
            if rows:
                u, d, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(d, kind),
                                                  pa.array(s, pa.int64())], names=["uid", "doc_id", "score"])
    return vectors.where("kind = 'doc'").select("doc_id", "n", "terms", "tf").mapInArrow(
        run, f"uid long, doc_id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", part_terms: int = PART_TERMS,
           cells: int = CELLS, leaf: int = LEAF) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of the highest score above 0 of every row
    of ``items``, equal scores by ascending ``doc_id`` (null ids last).

    Null and empty texts have no words: such items get no rows, such documents are in no count
    and no result. Repeated rows of items are each ranked on their own; repeated documents are
    each a document. An empty table on either side gives an empty result. Texts of any length are
    split piece by piece; other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    src = subset(docs, doc_id=doc_id, text=text)
    # Stored, so that every reading of an item's number is the same.
    asked = stored(subset(items, item_id=item_id, text=item_text)
                   .withColumn("uid", F.monotonically_increasing_id()), "asked-items")
    # a word has at least one byte and its separator one
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (4 * part_terms)))
    found = None
    for k_part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("uid"), F.lit(parts)) == k_part).select("uid", "text").collect()
        part = [(r.uid, sorted({w for some in words(r.text) for w in some})) for r in rows]
        part = [(u, t) for u, t in part if t]
        got = search_part(src, part, k, cells, leaf) if part else None
        if got is not None:
            # stored part by part, so that no plan grows with the number of parts
            got = stored(got, "search-part")
            found = got if found is None else found.unionByName(got)
    kind, ids = (x.schema[c].dataType.simpleString() for x, c in ((src, "doc_id"), (asked, "item_id")))
    if found is None:
        return spark.createDataFrame([], f"item_id {ids}, rank int, doc_id {kind}, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(asked.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score"))


def op11_ranked_search(spark, sf_dir):
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
c AS (SELECT count(*) AS nd, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
q AS (SELECT item, item_id, unnest(terms) AS term FROM b),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY row, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
m AS (SELECT row, doc_id, 10 + (90 * len(terms) * nd) // l AS m FROM d, c WHERE len(terms) > 0),
s AS (SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY item, item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
