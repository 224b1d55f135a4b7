"""Language identification by a string kernel.

The kernel is the blended-spectrum n-gram presence kernel: for n = 1, 2, 3 the share of byte
n-grams two texts have in common, ``|G(x) & G(y)| / sqrt(|G(x)| |G(y)|)``, averaged over n.
Nystroem landmarks (texts of the sample) give each text a finite feature vector, and one ridge
regression per language (one against the rest) is solved on those features. A batch of texts
becomes a presence matrix P; its scores are two matrix products, ``(P L^T) B + b``.

Only the model is learned from a bounded sample: at most ``per_language`` texts of every language,
of at most ``max_bytes`` bytes each, chosen by a hash of the id. Counts of languages and all predictions cover every document and its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_crc32, read, ship_package, slices, subset


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the learned model."""
    per_language: int = 300        # texts, fewer where they would exceed sample_bytes
    sample_bytes: int = 1 << 26
    max_bytes: int = 1 << 16       # of a text of the sample
    landmarks_per_language: int = 32
    max_landmarks: int = 1024
    features: int = 8192
    ridge: float = 1e-3
    sharpness: float = 4.0


FOLDS, HELD_OUT = 4, 2     # of the contract
PIECE = 1 << 18            # bytes of text looked up at a time

# Bytes are lower-cased (A-Z); every byte that is no ASCII letter and below 0x80 counts as space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
               for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Code of every byte n-gram."""
    code = raw.astype(np.int32)
    for k in range(1, n):
        code = (code[:-1] << 8) | raw[k:]
    return code


def normal(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    return np.frombuffer(b" " + b" ".join(raw.split()) + b" ", np.uint8)


class KernelModel:
    """Landmarks, ridge coefficients and the n-gram index of a fitted model."""

    def __init__(self, texts: list[str], langs: list[str], fit: Fit = Fit()):
        self.langs = sorted(set(langs))
        self.sharpness = fit.sharpness
        each = max(1, min(fit.landmarks_per_language,
                          fit.max_landmarks // max(1, len(self.langs))))
        marks = [i for lang in self.langs
                 for i in [j for j, x in enumerate(langs) if x == lang][:each]]
        raws = [normal(t) for t in texts]
        self.codes = []                               # per n: sorted codes that are features
        left = fit.features
        for n, share in ((1, 8), (2, 3), (3, 1)):     # n = 3 takes all that is left
            per = [np.unique(grams(raws[i], n)) for i in marks]
            code, held = np.unique(np.concatenate(per or [np.zeros(0, np.int32)]),
                                   return_counts=True)
            top = np.lexsort((code, -held))[:left // share]
            self.codes.append(np.sort(code[top]))
            left -= len(top)
        self._index()
        p = self.presence(raws)
        self.land = p[marks]
        if not self.langs:
            return
        mm = self.land @ self.land.T
        value, vector = np.linalg.eigh(mm.astype(np.float64))
        good = value > 1e-6 * value[-1]
        project = vector[:, good] / np.sqrt(value[good])
        z = (p @ self.land.T).astype(np.float64) @ project
        y = np.array([[1.0 if x == lang else -1.0 for lang in self.langs] for x in langs])
        weight = np.zeros(len(langs))                  # languages weigh alike
        for lang in self.langs:
            at = [i for i, x in enumerate(langs) if x == lang]
            weight[at] = 1 / len(at)
        weight /= weight.sum()
        zm, ym = weight @ z, weight @ y
        zc, yc = z - zm, y - ym
        w = np.linalg.solve((zc.T * weight) @ zc + fit.ridge * np.eye(z.shape[1]),
                            (zc.T * weight) @ yc)
        self.coef = (project @ w).astype(np.float32)
        self.bias = (ym - zm @ w).astype(np.float32)

    def _index(self) -> None:
        size = sum(map(len, self.codes))
        self.size, self.tables, at = size, [], 0
        for n, code in enumerate(self.codes, 1):
            table = np.full(1 << (8 * n), size, np.int16)     # ``size``: no feature
            table[code] = np.arange(at, at + len(code), dtype=np.int16)
            self.tables.append(table)
            at += len(code)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    def presence(self, raws: list[np.ndarray]) -> np.ndarray:
        """Normalised presence rows: the dot product of two rows is the blended kernel."""
        width = self.size + 1
        flat = np.zeros(len(raws) * width, bool)
        for row, raw in enumerate(raws):
            base = row * width
            for at in range(0, max(1, len(raw)), PIECE):
                piece = raw[at:at + PIECE + 2]
                for n, table in enumerate(self.tables, 1):
                    if len(piece) >= n:
                        flat[table[grams(piece, n)].astype(np.int64) + base] = True
        p = flat.reshape(len(raws), width)[:, :self.size].astype(np.float32)
        at = 0
        for code in self.codes:
            part = p[:, at:at + len(code)]
            part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(self.codes))
            at += len(code)
        return p

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; the score is the softmax of the ridge outputs."""
        p = self.presence([normal(t) for t in texts])
        out = (p @ self.land.T) @ self.coef + self.bias
        e = np.exp(self.sharpness * (out - out.max(1, keepdims=True)))
        best = out.argmax(1)
        score = (e / e.sum(1, keepdims=True))[np.arange(len(texts)), best]
        return [self.langs[i] for i in best], score.astype(np.float64)

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of any texts: ``und`` and 0 without a letter or a model."""
        can = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if can:
            for i, x, s in zip(can, *self.predict([texts[i] for i in can])):
                lang[i], score[i] = x, float(s)
        return lang, score


def fit_model(docs: DataFrame, fit: Fit = Fit(), doc_id: str = "doc_id", text: str = "text",
              lang: str = "lang") -> KernelModel:
    """Learn from the rows outside the held-out fold that have a language and a letter.

    Every language is learned. The sample holds texts of at most ``max_bytes``; a language that
    gives none gives the beginning of its shortest text. Many languages share ``sample_bytes``, the bound of
    what comes to the driver: then each gives fewer texts, one at least."""
    rows = (subset(docs, id=doc_id, text=text, lang=lang)
            .withColumn("lang", F.col("lang").cast("string"))
            .where("lang is not null and text is not null")
            .where(bucket_crc32("id", FOLDS) != HELD_OUT)
            .where(F.col("text").rlike(r"\p{L}")))
    size = F.octet_length("text")
    small = size <= fit.max_bytes
    seen = rows.groupBy("lang").agg(F.count_if(small).alias("n"), F.avg(F.when(small, size)).alias("bytes")).collect()
    if not seen:
        return KernelModel([], [], fit)
    count = {r.lang: r.n for r in seen if r.n}
    per_language = max(1, min(fit.per_language, int(fit.sample_bytes / max(1.0, sum(r.bytes or 0 for r in seen)))))
    share = F.create_map(*[x for lang_, n in sorted(count.items())
                           for x in (F.lit(lang_), F.lit((1.5 * per_language + 12) / n))]) if count else None
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bound = (2 * per_language + 24) * len(count)
    got = [] if share is None else (
        rows.where(small & (draw < share[F.col("lang")]))
        .select("lang", "text", draw.alias("draw")).orderBy("draw", "lang", "text")
        .limit(bound).collect())
    kept: dict[str, int] = {}
    sample = []
    for r in got:
        kept[r.lang] = kept.get(r.lang, 0) + 1
        if kept[r.lang] <= per_language:
            sample.append(r)
    rest = [r.lang for r in seen if r.lang not in kept]        # only long texts, or none drawn
    if rest:
        few = rows.where(F.col("lang").isin(rest)).withColumn("size", size)
        sample += (few.groupBy("lang").agg(F.min("size").alias("size")).join(few, ["lang", "size"])
                   .groupBy("lang").agg(F.min(F.substring("text", 1, fit.max_bytes // 4)).alias("text"))
                   .orderBy("lang").collect())
    return KernelModel([r.text for r in sample], [r.lang for r in sample], fit)


def identify(docs: DataFrame, model: KernelModel, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``, one row per document row. A text that is null or has no
    letter is ``und`` with score 0, and so is every text if the model knows no language.
    Repeated rows and null ids stay; an empty table gives an empty result."""
    src = subset(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)   # bounded by Fit

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in slices(whole, 128):
                lang, score = m.judge(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "lang_pred", "score"])
    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def reject_unknown(docs: DataFrame, model: KernelModel, text: str = "text",
                   min_score: float = 0.0) -> DataFrame:
    """``docs`` (all columns) without the rows whose text is ``und`` or scores under
    ``min_score``. A prediction depends on the text alone, so rows are judged where they lie.
    A model that knows no language rejects only texts without a letter."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in slices(whole, 128):
                texts = b.column(b.schema.get_field_index(text)).to_pylist()
                keep = ([x != "und" and s >= min_score for x, s in zip(*m.judge(texts))]
                        if m.langs else [has_letter(t) for t in texts])
                yield b.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def op3_language_kernel(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    got = identify(docs, fit_model(docs))
    held = F.coalesce(bucket_crc32("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")
