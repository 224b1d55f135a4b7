"""N-gram Jaccard self-join by T-occurrence search, with connected components.

Two documents link when the Jaccard similarity of their sets of word shingles is at least
``percent`` / 100.

1. **Sets.** One pass turns every text into its set of 64-bit shingle hashes. Documents with one
   set are one *node* (its hash), so exact copies are met once.
2. **Blocks.** Linked sets share at least T of their shingles, so under any one order of all
   shingles their first few common ones lie among the first ``n - T + l`` of each set
   (``prefix_size``). By hash order, which needs no count, these prefixes are met: each shingle
   gets its number of holders. Two linked sets have ``needed`` of these in common, so a set of c
   that others hold too has one of the common ones among its c - needed + 1 rarest; sets that
   share one of those are candidates, and a set with fewer than ``needed`` meets nobody.
   Prefixes are first met within a batch of documents, and only one row a shingle and batch is
   shuffled. Components of candidates are blocks: no link crosses a block.
3. **T-occurrence search** inside each block (``DivideSkip``): a set must share at least T
   shingles with the query, so its L longest inverted lists are set aside, the short ones are
   merged, sets found at least T - L times are probed in the long lists by binary search, and
   those that reach the exact overlap are linked. Sets already in the query's component are
   passed over.
4. A block over ``TILE`` shingles is cut into tiles: tiles are searched alone, then the
   representatives of their components against each other, and then, only where a block is still
   in several components, every pair of tiles.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, read, slices, stored, subset, task_memory
from .graph import components

SIZE, PERCENT = 3, 90       # of the contract; in general five words and 80 are usual
TILE = 2_000_000            # shingles searched in one task
PIECE = 1 << 18             # bytes hashed at once
BATCH = 2048                # documents whose prefixes are met before the shuffle
MERGE_BY_HEAP = 2048

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _K[0])          # of a byte; capitals as small letters
_VALUE[ord("A"):ord("Z") + 1] = _VALUE[ord("a"):ord("z") + 1]
_BASE = 0x2545F4914F6CDD1D                                        # odd, so it has an inverse


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE ** i`` and its inverse modulo 2 ** 64 for i < n."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _words_of_piece(x: np.ndarray) -> np.ndarray:
    """Hashes of the words of some bytes: differences of running polynomial sums."""
    power, inverse = _powers(max(PIECE, 1 << (len(x) - 1).bit_length()))
    gap = np.concatenate([[True], _SPACE[x], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    value = _VALUE[x]
    value *= power[:len(x)]
    total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of every word, A-Z as a-z. Long texts go in pieces that end behind a space."""
    x = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(x):
        end = at + PIECE
        while end < len(x):
            gaps = np.flatnonzero(_SPACE[x[end - PIECE:end]])
            if len(gaps):
                end += int(gaps[-1]) + 1 - PIECE
                break
            end += PIECE                                  # one word fills the piece: read on
        out.append(_words_of_piece(x[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(size, len(h))
    many = len(h) - width + 1
    out = np.full(many, width, np.uint64)
    for k in range(width):
        out *= _K[k % 3]
        out += h[k:many + k]
    out = np.sort(mix(out))
    return out[np.append(True, out[1:] != out[:-1])]


def set_hash(s: np.ndarray) -> int:
    """The node of a set: a 63-bit hash of its members and size."""
    total = np.append(mix(s + _K[0]), np.array([len(s)], np.uint64) * _K[1]).sum(dtype=np.uint64)
    return int(mix(np.array([total]))[0] >> np.uint64(1))


def least_common(n: int, percent: int) -> int:
    """T: the fewest shingles that a set of ``n`` shares with a linked one, and the least size of
    that one."""
    return (percent * n + 99) // 100


def spare(n: int, percent: int) -> int:
    """l: common shingles kept within the prefixes of linked sets of at least ``n``."""
    return max(1, min(least_common(n, percent), (100 - percent) * n // 100))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many of a set's least shingles meet other sets: n - T leave the first common one in,
    and each more another."""
    return n - least_common(n, percent) + spare(n, percent)


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that the prefixes of a set of ``n`` and of any linked one have in common: the
    spare ones of the smallest partner."""
    return spare(least_common(n, percent), percent)


def _nodes(ids, texts: list, size: int):
    """``doc_id, node, n`` of a batch; a text without words has no node."""
    sets = [shingles(t, size) for t in texts]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
         pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "node", "n"])


def _prefixes(texts: list, size: int, percent: int):
    """Rows ``token, nodes`` of one batch: one row a prefix shingle, with the ascending nodes
    that hold it; rows of one first node lie together, which packs well."""
    token, owner, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], set()
    for t in texts:
        s = shingles(t, size)
        node = set_hash(s) if len(s) else None
        if node is not None and node not in seen:
            seen.add(node)
            token.append(s[:prefix_size(len(s), percent)])
            owner.append(np.full(len(token[-1]), node, np.int64))
    token, owner = np.concatenate(token).view(np.int64), np.concatenate(owner)
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    at = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    nodes = pa.ListArray.from_arrays(pa.array(np.append(at, len(token)), pa.int32()), pa.array(owner))
    whole = pa.RecordBatch.from_arrays([pa.array(token[at]), nodes], names=["token", "nodes"])
    return whole.take(pa.array(np.argsort(owner[at], kind="stable")))


class Links:
    """Union-find over the sets of one search."""

    def __init__(self, n: int, start=None):
        self.up = list(range(n)) if start is None else list(start)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def search(sets: list[np.ndarray], start=None, side=None, percent: int = PERCENT) -> list[int]:
    """The component (least index) of every set. ``start`` holds components already known;
    with ``side``, only sets of different sides are compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    token_of, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(size)])
    tokens = [inverse[bounds[i]:bounds[i + 1]] for i in range(n)]      # ascending, as the sets
    by = np.argsort(inverse, kind="stable")
    members = rank[np.repeat(np.arange(n), size)[by]]
    begin = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(token_of)))])
    # inverted lists: sizes ascend with the rank, so a list cut to ranks is cut to sizes
    key = np.lexsort((members, inverse[by]))
    members = members[key]
    sizes = size[order]
    links = Links(n, start)
    for r in range(1, n):
        q = int(order[r])
        s = int(size[q])
        least = -(-percent * s // 100)                # T, and the smallest partner
        low = int(np.searchsorted(sizes, least))
        if low >= r:
            continue
        mine = tokens[q]
        a, z = begin[mine], begin[mine + 1]
        length = z - a
        longest = int(length.max())
        skip = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
        far = np.argsort(length, kind="stable")
        short, long = far[:s - skip], far[s - skip:]
        lists = [members[x:y] for x, y in zip(a[short].tolist(), z[short].tolist())]
        if int(length[short].sum()) <= MERGE_BY_HEAP:
            count: dict[int, int] = {}
            for j in heapq.merge(*[x.tolist() for x in lists]):
                count[j] = count.get(j, 0) + 1
            near = [(j, c) for j, c in count.items() if low <= j < r and c >= least - skip]
        else:
            got = np.concatenate(lists)
            got = np.bincount(got[(got >= low) & (got < r)] - low, minlength=1)
            near = [(int(j) + low, int(got[j])) for j in np.flatnonzero(got >= least - skip)]
        probe = mine[long]
        probe = np.sort(probe)
        own = links.find(q)
        for j, c in near:
            p = int(order[j])
            if side is not None and side[p] == side[q] or links.find(p) == own:
                continue
            spot = np.searchsorted(tokens[p], probe)
            hits = int((tokens[p][np.minimum(spot, len(tokens[p]) - 1)] == probe).sum())
            if (100 + percent) * (c + hits) >= percent * (s + int(size[p])):
                links.join(p, q)
                own = links.find(q)
    return [links.find(i) for i in range(n)]


def _by_group(batches, keys: int):
    """Rows of a sorted stream, group by group of the first ``keys`` columns."""
    held, current = [], None
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[:keys] != current:
                if held:
                    yield held
                held, current = [], row[:keys]
            held.append(row)
    if held:
        yield held


def _search_groups(rows: DataFrame, keys: list[str], percent: int,
                   crossing: bool = False) -> DataFrame:
    """Links ``a, b`` (star by star) found in each group of ``keys`` of ``rows`` (node, sets and,
    with ``crossing``, tile and comp)."""
    cols = [*keys, "node", "shingles"] + (["tile", "comp"] if crossing else [])
    k = len(keys)

    def run(batches):
        with task_memory():
            for group in _by_group(batches, k):
                if len(group) < 2:
                    continue
                group.sort(key=lambda r: r[k])
                sets = [np.frombuffer(r[k + 1], np.uint64) for r in group]
                start = side = None
                if crossing:
                    first: dict = {}
                    start = [first.setdefault(r[k + 3], i) for i, r in enumerate(group)]
                    side = [r[k + 2] for r in group]
                top = search(sets, start, side, percent)
                pairs = [(group[t][k], group[i][k]) for i, t in enumerate(top) if t != i]
                if pairs:
                    a, b = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                     names=["a", "b"])
    return (rows.select(*cols).repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a long, b long"))


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """``members`` (block, node, n) with ``tiles`` and ``tile``: about ``tile`` shingles each."""
    blocks = members.groupBy("block").agg(F.ceil(F.sum("n") / tile).cast("long").alias("tiles"))
    return members.join(blocks, "block").withColumn(
        "tile", F.pmod(F.xxhash64("node"), F.col("tiles")))


def _meet(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Candidate links ``a, b`` (star by star) from ``rows`` (token, nodes) of all batches and
    ``reps`` (node, n). The rows go straight into their shuffle and are kept nowhere else."""
    token = Window.partitionBy("token")
    shared = (rows.select("token", "nodes", F.sum(F.size("nodes")).over(token).alias("holders"),
                          F.min(F.element_at("nodes", 1)).over(token).alias("low"),
                          F.max(F.element_at("nodes", -1)).over(token).alias("high"))
              .where("low != high")
              # exact copies of other batches have the same node; still one task a token
              .select("token", "holders", F.explode("nodes").alias("node")).distinct())
    least = F.expr(f"({percent} * n + 99) div 100")
    sizes = (reps.withColumn("t", least).select("node", F.expr(       # as needed()
        f"greatest(1, least(({percent} * t + 99) div 100, {100 - percent} * t div 100))").alias("need"))
        .hint("merge"))                                               # the same join at every size
    rare = Window.partitionBy("node").orderBy("holders", "token")
    first = stored(shared.join(sizes, "node").select(
        "token", "node", "need", F.row_number().over(rare).alias("rank"),
        F.count("*").over(Window.partitionBy("node")).alias("c"))
        .where(F.col("rank") <= F.col("c") - F.col("need") + 1).select("token", "node"), "rare-shared")
    hubs = (first.groupBy("token").agg(F.min("node").alias("b"), F.max("node").alias("high"))
            .where("b != high").select("token", "b"))
    return first.join(hubs.hint("merge"), "token").where("node != b").select(F.col("node").alias("a"), "b")


def link(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text",
         percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per document row.

    ``component_id`` is the least ``doc_id`` reachable over links, the document's own included.
    Null and empty texts have no shingles and their own id; fewer than ``size`` words are one
    shingle. Rows with null ids take part; a component of null ids alone has a null id. Repeated
    rows link like copies; an empty table gives an empty result. Sets are known by 63-bit hashes
    of 64-bit shingle hashes.
    """
    src = subset(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()

    def nodes(batches):
        with task_memory():
            for whole in batches:
                for b in slices(whole, BATCH):
                    yield _nodes(b.column("doc_id"), b.column("text").to_pylist(), size)

    def prefixes(batches):
        with task_memory():
            for whole in batches:
                for b in slices(whole, BATCH):
                    yield _prefixes(b.column("text").to_pylist(), size, percent)
    per_doc = stored(src.mapInArrow(nodes, f"doc_id {kind}, node long, n long"), "set-nodes")
    reps = per_doc.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    met = _meet(src.select("text").mapInArrow(prefixes, "token long, nodes array<long>"), reps, percent)
    blocks = stored(components(met).withColumnRenamed("comp", "block"), "blocks")

    members = stored(_tiled(blocks.join(reps, "node"), tile), "block-members")

    def sets_of(batches):
        with task_memory():
            for whole in batches:
                for b in slices(whole):
                    sets = [shingles(t, size) for t in b.column("text").to_pylist()]
                    node = b.column("node").to_pylist()
                    same = [i for i, s in enumerate(sets) if len(s) and set_hash(s) == node[i]]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(c).take(pa.array(same, pa.int64())) for c in ("block", "tiles", "tile", "node")]
                        + [pa.array([sets[i].tobytes() for i in same], pa.binary())],
                        names=["block", "tiles", "tile", "node", "shingles"])
    # The same sort-merge join at every size: members grow with the documents.
    texts = src.join(members.select("block", "tiles", "tile", "node", "rep").hint("merge"),
                     F.col("doc_id").eqNullSafe(F.col("rep"))).select("block", "tiles", "tile", "node", "text")
    sets = stored(texts.mapInArrow(sets_of, "block long, tiles long, tile long, node long, shingles binary"),
                  "block-sets")
    found = stored(_search_groups(sets, ["block", "tile"], percent), "found-links")
    tiled = sets.where("tiles > 1")
    if not tiled.isEmpty():
        found = _search_tiles(tiled, found, tile, percent)
    comp = components(found)
    low = (reps.select("node", "rep").join(comp, "node", "left")
           .select("node", "rep", F.coalesce("comp", "node").alias("comp")))
    least = low.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = low.join(least, "comp").select("node", "component_id")
    linked = per_doc.where("node is not null").join(of_node, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(per_doc.where("node is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _search_tiles(sets: DataFrame, found: DataFrame, tile: int, percent: int) -> DataFrame:
    """All links of blocks of several tiles, given those inside tiles: representatives first,
    then pairs of tiles where a block is not yet one component."""
    def labelled(links):
        got = components(links)
        return (sets.join(got, "node", "left")
                .withColumn("comp", F.coalesce("comp", "node")))
    reps = labelled(found).where("node = comp").withColumn("n", F.length("shingles") / 8).select(
        "block", "node", "n", "shingles")
    found = stored(found.unionByName(_search_groups(_tiled(reps, tile), ["block", "tile"], percent)), "found-links")
    now = labelled(found)
    open_blocks = (now.groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
                   .where("x != y").select("block"))
    pairs = (now.join(open_blocks, "block")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .where("other != tile")
             .withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other")))
    return stored(found.unionByName(_search_groups(pairs, ["block", "t1", "t2"], percent, True)), "found-links")


def keep_one(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text",
             percent: int = PERCENT) -> DataFrame:
    """``docs`` without all but one document of each component, the one of the least id.

    Documents without shingles, and rows without an id, all stay. Of rows that share both id and
    text one stays; rows that share an id but not the text stay or go together."""
    groups = stored(link(docs, size, doc_id, text, percent), "groups")
    own = free_name(docs, "own_id")
    gone = (groups.where("component_id is not null and doc_id is not null and doc_id != component_id")
            .select(F.col("doc_id").alias(own)).distinct())
    gone = gone.hint("merge")       # the same join at every size, as above
    kept = docs.join(gone, F.col(f"`{doc_id}`") == F.col(own), "left_anti")
    again = (groups.where("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias(own))
             .count().where("count > 1").select(own))
    if again.isEmpty():
        return kept
    on = F.col(f"`{doc_id}`") == F.col(own)
    return kept.join(again, on, "left_anti").unionByName(
        kept.join(again, on, "left_semi").dropDuplicates([doc_id, text]))


def op6_jaccard_join(spark, sf_dir):
    return link(read(spark, sf_dir, "documents"))
