"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Every id is replaced by its frequency rank over the whole corpus, so common ids need one byte.
A *block* holds the ids of consecutive documents in two byte strings: ``control`` (2 bits an
id, four ids a byte: its length less one) and ``data`` (1 to 4 little-endian bytes an id).
Decoding looks the control bytes up in a 256 x 4 table of lengths and gathers the data bytes
with numpy; no id is branched on.

The file format is a folder of two Parquet tables: ``blocks`` (one file a shard; ``shard,
block, skip, n_ids, doc_ids, sizes, control, data``; ``skip`` = ids of the shard before the
block) and ``ranks`` (``rank, id, n``; bounded by the vocabulary). Shards are key ranges of the
document id, so shard and block order is document order.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import shared_dir

from .common import read, slices, stored, subset, task_memory
from .pretokens import BYTE_LEVEL, UNCOMMON, byte_chars

BLOCK_IDS = 1 << 18
CACHE_WORDS = 500_000

LENGTHS = np.array([[(c >> (2 * j) & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of ranks below 2**32."""
    r = np.ascontiguousarray(ranks, "<u4")
    size = (1 + (r > 0xFF) + (r > 0xFFFF) + (r > 0xFFFFFF)).astype(np.uint8)
    code = np.zeros(-len(r) % 4 + len(r), np.uint8)
    code[:len(r)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class WordCache(dict):
    """Encodes texts with the tokenizers library. A text is cut into the tokenizer's own
    pre-tokens; each distinct one is encoded once by the library's model and kept in this
    bounded dictionary. When it is full, its words become the older half, of which those that
    are met again come back. Texts with rare characters or special tokens are encoded whole."""

    def __init__(self, path: str, dtype: str, max_words: int = CACHE_WORDS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.to_char = "".join(c for _, c in sorted(byte_chars().items()))
        self.pack = struct.Struct("<" + {"<u2": "H", "<u4": "I"}[dtype]).pack
        self.dtype, self.max_words, self.older = dtype, max_words, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            chars = (word if word.isascii() else word.encode().decode("latin-1")).translate(self.to_char)
            got = b"".join([self.pack(t.id) for t in self.model.tokenize(chars)])
        self[word] = got
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if len(self) > self.max_words:
                self.older = dict(self)
                self.clear()
            if not t.isascii() and UNCOMMON.search(t) or any(s in t for s in self.specials):
                ids = self.tok.encode(t, add_special_tokens=False).ids
                out.append(np.array(ids, self.dtype).tobytes())
            else:
                out.append(b"".join(map(self.__getitem__, BYTE_LEVEL.findall(t))))
        return out


@lru_cache(maxsize=2)
def word_cache(path: str, dtype: str) -> WordCache:
    """One cache a worker process, kept from task to task."""
    return WordCache(path, dtype)


def id_dtype(path: str) -> str:
    """Two bytes an id where the vocabulary fits, else four."""
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_file(path).get_vocab_size(True) <= 1 << 16 else "<u4"


def encode_ids(docs: DataFrame, path: str, end_id: int | None, doc_id: str, text: str) -> DataFrame:
    """Rows of kind ``doc``: ``doc_id, ids`` (little-endian integers of ``id_dtype``), the end id
    included; and for each task one of kind ``sum``, whose ``ids`` are the 64-bit counts of its ids."""
    src = subset(docs, doc_id=doc_id, text=text)
    dtype = id_dtype(path)
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()

    def run(batches):
        coder, total, kind = word_cache(path, dtype), np.zeros(0, np.int64), None
        with task_memory():
            for whole in batches:
                kind = whole.schema.field("doc_id").type
                for b in slices(whole):
                    ids = [i + end for i in coder.encode([t or "" for t in b.column("text").to_pylist()])]
                    column = pa.array(ids, pa.binary())
                    total = added(total, np.bincount(joined(column, dtype)[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(["doc"] * len(ids)), b.column("doc_id"), column],
                                                     names=["kind", "doc_id", "ids"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["sum"]), pa.nulls(1, kind), pa.array([total.tobytes()])],
                                             names=["kind", "doc_id", "ids"])
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"kind string, doc_id {kind}, ids binary")


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts, of which the shorter ends in zeros."""
    if len(a) < len(b):
        a, b = b, a
    out = a.astype(np.int64)
    out[:len(b)] += b
    return out


def joined(column, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column in one array, and the ids in each row."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:][:len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    raw = column.buffers()[2]
    data = b"" if raw is None else raw.slice(ends[0], ends[-1] - ends[0])
    return np.frombuffer(data, dtype), np.diff(ends).astype(np.int64) // np.dtype(dtype).itemsize


def id_counts(encoded: DataFrame) -> DataFrame:
    """``id, n``, from the counts of the encoding tasks."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for counts in b.column("ids").to_pylist():
                total = added(total, np.frombuffer(counts, np.int64))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])],
                                         names=["id", "n"])
    return (encoded.where("kind = 'sum'").select("ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 0,
                      doc_id: str = "doc_id", text: str = "text",
                      block_ids: int = BLOCK_IDS) -> None:
    """Tokenise ``docs`` and write the folder ``path``.

    Documents lie in ascending ``doc_id`` order (nulls first; rows with one id by a hash of
    their ids, then by these). Null text counts as empty, so such a document is its end id alone; repeated rows are
    all written; an empty table writes a folder without blocks. A document is never split.
    """
    dtype = id_dtype(tokenizer)
    encoded = stored(encode_ids(docs, tokenizer, end_id, doc_id, text), "token-ids", ["kind"])
    order = id_counts(encoded).orderBy(F.desc("n"), "id").collect()   # <= vocabulary
    spark = docs.sparkSession
    spark.createDataFrame([(k, int(r.id), int(r.n)) for k, r in enumerate(order)],
                          "rank long, id long, n long").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/ranks")
    rank_of = np.zeros(max([r.id for r in order], default=0) + 1, np.uint32)
    rank_of[[r.id for r in order]] = np.arange(len(order), dtype=np.uint32)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shard, block, skip = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            ids, sizes = joined(b.column("ids"), dtype)
            ids, after = rank_of[ids], np.cumsum(sizes)
            # a block: the documents that begin in the same stretch of block_ids ids
            cuts = np.flatnonzero(np.diff((after - sizes) // block_ids)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(sizes)]):
                if i == j:
                    continue
                part = ids[after[i] - sizes[i]:after[j - 1]]
                control, data = pack(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int64()), pa.array([block], pa.int64()),
                    pa.array([skip], pa.int64()), pa.array([len(part)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()),
                                             b.column("doc_id").slice(i, j - i)),
                    pa.array([sizes[i:j]], pa.list_(pa.int64())),
                    pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                    names=["shard", "block", "skip", "n_ids", "doc_ids", "sizes", "control", "data"])
                block, skip = block + 1, skip + len(part)
    # Ranges are cut on a hash of the ids, not on the ids, whose samples would go to the driver.
    tie = F.xxhash64("ids")
    encoded = encoded.where("kind = 'doc'").select("doc_id", "ids")
    (encoded.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "ids")
     .mapInArrow(run, "shard long, block long, skip long, n_ids long, "
                 f"doc_ids array<{kind}>, sizes array<long>, control binary, data binary")
     .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks"))


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (array<int>), or with ``digest`` their
    ``ids_crc32``, of every document of a folder. ``start`` counts the ids of all documents
    before it: a running sum over the shards (one row a file) plus the block's own offset."""
    ranks = spark.read.parquet(f"{path}/ranks").select("rank", "id").collect()
    id_of = np.zeros(len(ranks), np.uint32)
    id_of[[r["rank"] for r in ranks]] = [r.id for r in ranks]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    total = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    first = total.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
                         .alias("first"))
    placed = blocks.join(F.broadcast(first), "shard").select(   # one row a file
        (F.col("first") + F.col("skip")).alias("at"), "n_ids", "doc_ids", "sizes", "control", "data")

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                row = b.to_pylist()[0]
                ids = id_of[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4")
                ends = np.cumsum(row["sizes"])
                parts = np.split(ids, ends[:-1])
                out = (pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else
                       pa.array(parts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids").flatten(),
                     pa.array(row["at"] + ends - row["sizes"], pa.int64()),
                     pa.array(row["sizes"], pa.int64()), out],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    last = "ids_crc32 long" if digest else "ids array<int>"
    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, {last}")


def op1_token_files(spark, sf_dir):
    import public_tokenizers
    path = shared_dir(spark, "token-files")
    write_token_files(read(spark, sf_dir, "documents"),
                      public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path, digest=True)
