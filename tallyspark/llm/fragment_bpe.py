"""BPE by forced boundaries.

A merge only ever builds a vocabulary token, so two neighbouring bytes that stand together in no
vocabulary token can never end up in one token. Each such byte pair marks a certain cut: the word
falls apart into fragments that are encoded on their own and concatenated. Fragments repeat far
more often than words, and a cut bounds the work on any word of foreign bytes.

Words come from the tokenizer's own normalizer and splitter (spelt out in ``pretokens`` for
common Latin text, taken from the library for other texts); the merging is done here.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, slices, subset, task_memory
from .pretokens import UNCOMMON, WORD_LEVEL, byte_chars

CACHE_WORDS = 200_000


class _Words(dict):
    """word -> (ids text, tokens text), filled by ``make`` on a miss."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> tuple[str, str]:
        got = self[word] = self.make(word)
        return got


class FragmentBpe:
    """Encoder and decoder of a byte-level BPE with word ends, from its tokenizer file."""

    def __init__(self, path: str, max_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.lib = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.joined = self._inner_pairs()
        # A fragment inside a word has no word end; the last one has.
        self.inner = models.BPE(vocab=self.vocab, merges=merges)
        self.final = self.lib.model if self.suffix else self.inner
        self.to_char = "".join(c for _, c in sorted(byte_chars().items()))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(
            re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.token_of = {i: t for t, i in self.vocab.items()}
        self.token_of.update({i: t for t, i in self.special.items()})
        self.max_words = max_words
        self.words = _Words(lambda w: self.entry(
            w.encode().decode("latin-1").translate(self.to_char)))
        self.raw_words = _Words(self.entry)      # words already in byte characters
        self.fragments: dict[str, list] = {}     # of fragments inside words

    def _inner_pairs(self) -> set[str]:
        """Neighbouring byte characters inside any vocabulary token."""
        out = set()
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            out.update(body[i:i + 2] for i in range(len(body) - 1))
        return out

    def cut(self, word: str) -> list[str]:
        """The fragments of a word of byte characters."""
        joined = self.joined
        at = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in joined]
        if not at:
            return [word]
        at = [0, *at, len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def tokens(self, word: str) -> list[tuple[int, str]]:
        """(id, token) of a word of byte characters: its fragments' tokens, concatenated."""
        out: list = []
        *inner, last = self.cut(word)
        for p in inner:
            got = self.fragments.get(p)
            if got is None:
                got = self.fragments[p] = [(t.id, t.value) for t in self.inner.tokenize(p)]
            out += got
        out += [(t.id, t.value) for t in self.final.tokenize(last)]
        return out

    def entry(self, word: str) -> tuple[str, str]:
        toks = self.tokens(word)
        return " ".join([str(i) for i, _ in toks]), " ".join([t for _, t in toks])

    def encode(self, text: str) -> list[tuple[str, str]]:
        """(ids, tokens) of every word of a text, each joined by spaces."""
        for cache in (self.words, self.raw_words, self.fragments):
            if len(cache) > self.max_words:
                cache.clear()
        parts = self.special_re.split(text) if self.special and "<|" in text else [text]
        out: list[tuple[str, str]] = []
        for part in parts:
            if part in self.special:
                out.append((str(self.special[part]), part))
            elif UNCOMMON.search(part):
                norm = self.lib.normalizer.normalize_str(part)
                known = self.raw_words
                out += [known[w] for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm)]
            else:
                out += map(self.words.__getitem__, WORD_LEVEL.findall(part.lower()))
        return out

    def decode(self, ids) -> str:
        """The tokens of the ids joined by a space, as the library does without a decoder."""
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)


@lru_cache(maxsize=2)
def coder_of(path: str) -> FragmentBpe:
    """One coder a worker process, kept from task to task."""
    return FragmentBpe(path)


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                  with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_text`` (decimal ids joined by a space), ``decoded`` and, with
    ``with_ids``, ``ids`` (array<int>), one row per document row.

    Null text counts as empty: no tokens and empty texts. Special tokens' strings become their
    ids, as in the library. Repeated rows stay; an empty table gives an empty result.
    """
    src = subset(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_text string, decoded string"

    def run(batches):
        coder = coder_of(path)
        with task_memory(coder.words, coder.raw_words, coder.fragments):
            for whole in batches:
                for b in slices(whole, 256):
                    got = [coder.encode(t or "") for t in b.column("text").to_pylist()]
                    ids = [" ".join([e[0] for e in g]) for g in got]
                    cols = [b.column("doc_id"),
                            pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()),
                            pa.array(ids, pa.string()),
                            pa.array([" ".join([e[1] for e in g]) for g in got], pa.string())]
                    if with_ids:
                        cols.append(pa.array([np.array(i.split(), np.int32) for i in ids],
                                             pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, names=[
                        "doc_id", "n_tokens", "ids_text", "decoded"] + ["ids"] * with_ids)
    return src.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def op5_fragment_bpe(spark, sf_dir):
    import public_tokenizers
    got = encode_decode(read(spark, sf_dir, "documents"),
                        public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return got.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
