"""Exact removal of repeated byte strings by a distributed, common-prefix-aware merge sort of
suffixes.

A byte goes if a string of ``size`` (400) bytes covering it also starts anywhere else. Sorting the
suffixes brings equal strings together; three things keep that in bounds:

* **Sampled suffixes.** Only suffixes at content-defined *anchors* are sorted: the leftmost
  least 8-byte hash of every ``REACH`` (256) neighbouring positions. Equal strings of 400 bytes
  have an anchor at one and the same offset below 256, so each pair of them is met at suffixes
  that share at least 145 bytes; ``left`` holds the bytes before the anchor, ``right`` the 400
  from it on. Anchors whose first 64 bytes occur only once in the corpus cannot take part and are
  dropped after a count of hashes. (64 of the 145, so that shorter passages of many words are met
  as well; they are reported, not removed.)
* **Front-coded runs.** Every task sorts its suffixes and sends, for each bucket of the
  64-byte key, one run: lengths of common prefixes and what follows them. Occurrences with equal
  left and right are one entry of a run, whatever their number.
* **Loser trees.** A bucket merges its runs in a loser tree that carries common-prefix lengths:
  the entry sharing more with the last output wins unseen, and ties are compared only beyond the
  known prefix. The output's neighbour prefixes give R, the lefts give L, and a pair of entries
  proves every string that starts o bytes before the anchor with ``400 - R <= o <= L``.

Verdicts go back to the occurrences of each run, and the spans to the documents. Documents are
kept in a table bucketed by row, so both joins with their text move only the other side.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import shared_dir

from .common import read, slices, stored, subset, task_memory
from .jaccard_join import mix

SIZE = 400
REACH = 256                 # neighbouring positions that choose one anchor; a power of two
KEY = 64                    # bytes from an anchor on by which repeats are looked up
PASSAGE = 51                # words of a shared passage that is reported, whatever its bytes
RUN_ENTRIES = 20_000        # suffixes sorted at a time
BUCKET_ENTRIES = 20_000     # aimed at in a merge
PAIRS_UP_TO = 32            # entries of one key compared pair by pair


def key_length(size: int, reach: int) -> int:
    """Equal strings of ``size`` bytes share ``size - reach + 1`` bytes from an anchor on; a shorter
    key finds shorter passages too."""
    return min(KEY, size - reach + 1)


def anchors(raw: np.ndarray, size: int = SIZE, reach: int = REACH) -> np.ndarray:
    """Positions of the anchors of all strings of ``size`` bytes of a document."""
    last = len(raw) - size                      # last start of a string
    if last < 0:
        return np.zeros(0, np.int64)
    out = []
    step = 1 << 20
    for a in range(0, last + 1, step):          # starts a .. z - 1
        z = min(last + 1, a + step)
        part = raw[a:z + reach - 1 + 7].astype(np.uint64)
        for shift, width in ((8, 1), (16, 2), (32, 4)):
            part = part[:-width] | (part[width:] << np.uint64(shift))
        key = (mix(part) & np.uint64(~((1 << 22) - 1) & (1 << 64) - 1)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width < reach:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        spot = (key & np.uint64((1 << 22) - 1)).astype(np.int64) + a
        out.append(spot[np.concatenate([[True], spot[1:] != spot[:-1]])])
    return np.unique(np.concatenate(out))


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings, of which ``known`` bytes are known."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class LoserTree:
    """Merges sorted runs of ``(string, prefix shared with its forerunner, payload)``; yields
    ``(string, prefix shared with the last output, payload)``. A node's loser keeps the prefix
    it shares with the winner that passed it, so known prefixes are never compared again."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.n = 1
        while self.n < max(1, len(runs)):
            self.n *= 2
        self.head = [next(r, None) for r in self.runs] + [None] * (self.n - len(runs))
        # every first string shares 0 bytes with the empty string before all output
        self.lcp = [0] * self.n
        self.loser = [0] * self.n
        self.top = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of two streams; the other stays at the node."""
        x, y = self.head[a], self.head[b]
        if y is None or x is None:
            win, lose = (a, b) if y is None else (b, a)
        elif self.lcp[a] != self.lcp[b]:
            win, lose = (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        else:
            common = shared(x[0], y[0], self.lcp[a])
            win, lose = (a, b) if x[0][common:common + 1] <= y[0][common:common + 1] else (b, a)
            self.lcp[lose] = common
        self.loser[node] = lose
        return win

    def __iter__(self):
        while self.head[self.top] is not None:
            i = self.top
            string, _, payload = self.head[i]
            yield string, self.lcp[i], payload
            self.head[i] = following = next(self.runs[i], None)
            if following is not None:
                self.lcp[i] = following[1]
            node = (i + self.n) // 2
            while node:
                i = self._play(node, i, self.loser[node])
                node //= 2
            self.top = i


def front_code(strings: list[bytes]) -> tuple[list[int], list[int], bytes]:
    """(shared prefixes, lengths of the rests, rests) of sorted strings."""
    same = [0] + [shared(a, b, 0) for a, b in zip(strings, strings[1:])]
    rest = [s[n:] for s, n in zip(strings, same)]
    return same, [len(r) for r in rest], b"".join(rest)


def front_decode(same: list[int], sizes: list[int], rest: bytes):
    """(string, prefix shared with the one before), one by one."""
    last, at = b"", 0
    for n, size in zip(same, sizes):
        last = last[:n] + rest[at:at + size]
        at += size
        yield last, n


def _flags_by_pairs(rights, lcps, lefts, many, size, reach) -> np.ndarray:
    m = len(rights)
    flag = np.zeros((m, reach), bool)
    o = np.arange(reach)
    back = [x[::-1] for x in lefts]
    for i in range(m):
        if many[i] > 1:
            flag[i] |= (o >= size - len(rights[i])) & (o <= len(lefts[i]))
        r = size
        for j in range(i + 1, m):
            r = min(r, lcps[j])
            if size - r >= reach:
                break
            left = shared(back[i], back[j], 0)
            if size - r <= left:
                a, z = max(0, size - r), min(left, reach - 1) + 1
                flag[i, a:z] = flag[j, a:z] = True
    return flag


def _flags_by_offset(rights, lcps, lefts, many, size, reach) -> np.ndarray:
    """The same for very many entries: at each offset, entries are named by their run of equal
    rights and a 64-bit hash of their lefts."""
    m = len(rights)
    table = np.zeros((m, reach), np.uint64)
    for i, x in enumerate(lefts):
        table[i, :len(x)] = np.frombuffer(x[::-1], np.uint8)
    lengths = np.array([len(x) for x in lefts])
    right = np.array([len(x) for x in rights])
    lcp, many = np.array(lcps), np.array(many)
    flag = np.zeros((m, reach), bool)
    h = np.zeros(m, np.uint64)
    for o in range(reach):
        if o:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + table[:, o - 1] + np.uint64(1))
        ok = np.flatnonzero((lengths >= o) & (right >= size - o))
        if not len(ok):
            continue
        cut = lcp < size - o
        cut[0] = True
        name = mix(h[ok] ^ mix(np.cumsum(cut)[ok].astype(np.uint64)))
        _, inverse = np.unique(name, return_inverse=True)
        total = np.bincount(inverse, weights=many[ok])
        flag[ok, o] = total[inverse] > 1
    return flag


def intervals(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return [(int(a), int(z) - 1) for a, z in zip(edge[::2], edge[1::2])]


def is_passage(text: bytes) -> bool:
    """Whether a text has ``PASSAGE`` words, parted by spaces or line ends."""
    return text.count(b" ") + text.count(b"\n") >= PASSAGE - 1


def shares_passage(a, b, same: int) -> bool:
    """Whether two neighbours of a merge, whose rights share ``same`` bytes, share a passage."""
    left = b[2][0]
    if len(left) + same < 2 * PASSAGE - 1:
        return False
    n = len(left) if left == a[2][0] else shared(a[2][0][::-1], left[::-1], 0)
    return n + same >= 2 * PASSAGE - 1 and is_passage(left[len(left) - n:] + b[0][:same])


def judge(merged, size: int, reach: int):
    """``(payload, offsets, passage)`` for every entry of a merged bucket with repeated strings; the
    payload is (left, occurrences, ...), ``offsets`` are inclusive intervals, ``passage`` tells
    whether a neighbour shares a passage of many words or the entry occurs more than once with as
    many around its anchor. Strings need groups that share ``size - reach + 1`` bytes; passages are
    looked for at shorter keys too, there only between neighbours."""
    least, strong = key_length(size, reach), size - reach + 1
    group: list = []

    def decide(before: bool, after: bool):
        """``before``, ``after``: the first entry shares a passage with the one before the group, the
        last with the one after it."""
        if len(group) == 1 and group[0][2][1] == 1:
            if before or after:
                yield group[0][2], [], True
            return
        rights, lcps, loads = zip(*group)
        lefts, many = [p[0] for p in loads], [p[1] for p in loads]
        known = [k > 1 and is_passage(left + right) for k, left, right in zip(many, lefts, rights)]
        known[0], known[-1] = known[0] or before, known[-1] or after
        for i in range(1, len(group)):
            if not (known[i - 1] and known[i]) and shares_passage(group[i - 1], group[i], lcps[i]):
                known[i - 1] = known[i] = True
        make = _flags_by_pairs if len(group) <= PAIRS_UP_TO else _flags_by_offset
        flag = make(rights, lcps, lefts, many, size, reach)
        for row, some, p, passage in zip(flag, flag.any(axis=1).tolist(), loads, known):
            if some or passage:
                yield p, intervals(row) if some else [], passage
    before = False
    for entry in merged:
        if group and entry[1] < strong:
            link = entry[1] >= least and shares_passage(group[-1], entry, entry[1])
            yield from decide(before, link)
            group, before = [], link
        group.append(entry)
    if group:
        yield from decide(before, False)


def bucketed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` stored with one bucket a shuffle partition of ``uid``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (docs.repartition(n, "uid").write.bucketBy(n, "uid").format("parquet")
     .option("compression", "zstd").option("path", shared_dir(spark, name) + "/table").saveAsTable(table))
    return spark.table(table)


def _raw(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.cast(pa.binary()).to_pylist()]


def find_repeats(rows: DataFrame, size: int = SIZE, reach: int = REACH) -> DataFrame:
    """``uid, spans`` (array of start, stop; may overlap) and ``n_shared`` (anchors in shared passages of
    many words) of every row of ``rows`` (uid long, text string, not null) that has any."""
    least = key_length(size, reach)
    short = reach + least - 1                              # shortest string that has an anchor
    width = reach - 1                                      # bytes kept left of an anchor

    def list_anchors(batches):
        with task_memory():
            for whole in batches:
                for b in slices(whole):
                    uid, at, key = [], [], []
                    for u, raw in zip(b.column("uid").to_pylist(), _raw(b.column("text"))):
                        spots = anchors(raw, short, reach)
                        if len(spots):
                            data = raw.tobytes()
                            at.append(spots)
                            uid.append(np.full(len(spots), u, np.int64))
                            key += [xxhash.xxh3_64_intdigest(data[p:p + least]) for p in spots.tolist()]
                    if at:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.array(key, np.uint64).view(np.int64)),
                             pa.array(np.concatenate(uid)), pa.array(np.concatenate(at))],
                            names=["key", "uid", "at"])
    spots = stored(rows.mapInArrow(list_anchors, "key long, uid long, at long"), "anchors")
    # Stored, so that both sides of the join below are plain shuffles, of which the skew join
    # splits a key that very many texts share.
    again = stored(spots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"),
                   "repeated-keys")
    # The same sort-merge joins at every size: all sides grow with the documents.
    met = stored(spots.join(again.hint("merge"), "key").groupBy("uid").agg(F.collect_list("at").alias("at")),
                 "met-anchors")
    n = met.agg(F.sum(F.size("at"))).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_ENTRIES))

    def make_runs(batches):
        part = TaskContext.get().partitionId() << 32
        entries: dict = {}
        places: list = []
        serial = 0

        def flush():
            by: dict = {}
            for (left, right), i in entries.items():
                by.setdefault(xxhash.xxh3_64_intdigest(right[:least]) % buckets, []).append((right, left, i))
            many = np.bincount([i for _, _, i in places], minlength=len(entries))
            for bucket, items in by.items():
                items.sort()
                same, sizes, rest = front_code([x[0] for x in items])
                yield ("run", part + serial, bucket, same, sizes, rest, [len(x[1]) for x in items],
                       b"".join([x[1] for x in items]), [x[2] for x in items],
                       [int(many[x[2]]) for x in items], None, None)
            yield ("occ", part + serial, None, None, None, None, None, None,
                   [i for _, _, i in places], None, [u for u, _, _ in places], [p for _, p, _ in places])

        def batch(rows_):
            cols = list(zip(*rows_))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        with task_memory():
            for whole in batches:
                for b in slices(whole, 64):
                    for u, raw, at in zip(b.column("uid").to_pylist(), _raw(b.column("text")),
                                          b.column("at").to_pylist()):
                        data = raw.tobytes()
                        for p in at:
                            entry = (data[max(0, p - width):p], data[p:p + size])
                            places.append((u, p, entries.setdefault(entry, len(entries))))
                            if len(entries) >= RUN_ENTRIES or len(places) >= 20 * RUN_ENTRIES:
                                yield batch(list(flush()))
                                entries, places, serial = {}, [], serial + 1
            if places:
                yield batch(list(flush()))
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    names = ["kind", "run", "bucket", "same", "sizes", "rest", "left_sizes", "lefts", "entry", "many", "uid", "at"]
    types = [pa.string(), pa.int64(), pa.int64(), ints, ints, pa.binary(), ints, pa.binary(), ints, longs, longs, longs]
    schema = ("kind string, run long, bucket long, same array<int>, sizes array<int>, rest binary, "
              "left_sizes array<int>, lefts binary, entry array<int>, many array<long>, uid array<long>, at array<long>")
    runs = stored(rows.join(met.hint("merge"), "uid").select("uid", "text", "at").mapInArrow(make_runs, schema),
                  "suffix-runs", ["kind"])

    def open_run(row):
        at = 0
        for (string, same), size_, i, k in zip(front_decode(row["same"], row["sizes"], row["rest"]),
                                               row["left_sizes"], row["entry"], row["many"]):
            yield string, same, (row["lefts"][at:at + size_], k, row["run"], i)
            at += size_

    def merge(batches):
        def finish(held):
            out = [(p[2], p[3], [a for a, _ in offs], [z for _, z in offs], passage)
                   for p, offs, passage in judge(LoserTree([open_run(r) for r in held]), size, reach)]
            cols = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), ints, ints, pa.bool_()))],
                names=["run", "entry", "low", "high", "passage"])
        with task_memory():
            held, bucket = [], None
            for b in batches:
                for one in slices(b, 1):
                    row = one.to_pylist()[0]
                    if row["bucket"] != bucket and held:
                        yield finish(held)
                        held = []
                    bucket = row["bucket"]
                    held.append(row)
            if held:
                yield finish(held)
    fields = ["bucket", "run", "same", "sizes", "rest", "left_sizes", "lefts", "entry", "many"]
    verdict = (runs.where("kind = 'run'").select(*fields).repartition("bucket")
               .sortWithinPartitions("bucket", "run")
               .mapInArrow(merge, "run long, entry int, low array<int>, high array<int>, passage boolean"))
    places = runs.where("kind = 'occ'").select("run", F.explode(F.arrays_zip("entry", "uid", "at")).alias("o")) \
        .select("run", "o.entry", "o.uid", "o.at")
    spans = F.transform(F.arrays_zip("low", "high"), lambda x: F.struct(
        (F.col("at") - x["high"]).alias("start"), (F.col("at") - x["low"] + size).alias("stop")))
    return stored(places.join(verdict.hint("merge"), ["run", "entry"]).select("uid", spans.alias("s"), "passage")
                  .groupBy("uid").agg(F.flatten(F.collect_list("s")).alias("spans"),
                                      F.count_if("passage").alias("n_shared")), "repeat-spans")


def union_of(spans) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def remove_repeats(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text",
                   reach: int = REACH, digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and ``kept`` (binary: the remaining bytes; they
    need not be whole characters), or with ``digest`` their ``kept_sha256``, and ``n_shared``; one
    row per document row. ``n_shared`` is above 0 where the text has a passage of ``PASSAGE`` words
    or more that another place has too, also one too short to be removed: always if the passage has
    ``reach + KEY - 1`` bytes or more, mostly if it has fewer.

    Null text counts as empty; texts under ``size`` bytes keep all. Every row is a text of its
    own, so repeated rows are copies of one another, whatever their ids. An empty table gives an
    empty result.
    """
    src = subset(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = bucketed(src.withColumn("uid", F.monotonically_increasing_id()), "repeat_rows")
    found = find_repeats(rows.select("uid", "text"), size, reach)
    kind = src.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for whole in batches:
            for b in slices(whole):
                n, gone, parts, kept = [], [], [], []
                for t, s in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                    spans = union_of([(x["start"], x["stop"]) for x in s or []])
                    left, at = [], 0
                    for a, z in spans:
                        left.append(t[at:a])
                        at = z
                    left.append(t[at:])
                    left = b"".join(left)
                    n.append(len(t))
                    gone.append(len(t) - len(left))
                    parts.append(len(spans))
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(parts, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary()),
                     pc.fill_null(b.column("n_shared"), 0)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept",
                           "n_shared"])
    last = "kept_sha256 string" if digest else "kept binary"
    return (rows.join(found.hint("merge"), "uid", "left").select("doc_id", "text", "spans", "n_shared")
            .mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {last}, n_shared long"))


def op8_suffix_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"), digest=True)
