"""Line-first cleaning: judge every line, drop the failing ones, then reject documents that
lost too much of their text.

A line with a word fails by one of three rules:

* **navigation**: at least ``nav_separators`` of ``| > » ·`` standing alone as words, or a line
  of at most three words that ends in a separator;
* **boilerplate**: it contains a phrase of ``PHRASES``;
* **punctuation**: it has at least ``long_line`` words and no sentence mark at all, or more
  symbols of ``# * $ % & | < >`` than words.

Lines without a word never fail. A document is rejected if its base rules fail (fewer than
``min_words`` words, or over ``max_repeat_percent`` of its words inside repeated 8-word windows),
or if the failing lines hold more than ``max_lost`` of its word characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, slices, subset

# Words are separated by these six characters; symbols as in the contract.
SPACES, SYMBOLS, WINDOW = b"\x20\t\n\x0b\x0c\r", b"#*$%&|<>", 8
PHRASES = (b"all rights reserved", b"cookie policy", b"privacy policy", b"terms of use",
           b"terms of service", b"subscribe to our", b"sign up for our", b"enable javascript",
           b"click here", b"share this", b"powered by", b"lorem ipsum")
_PHRASE = re.compile(b"|".join(map(re.escape, PHRASES)), re.IGNORECASE)
_MARKS = re.compile(r"[.!?:;,\u2026\u3002\uff01\uff1f]")
SEPARATORS = {b"|", b">", "»".encode(), "·".encode(), b"||", b">>"}


@dataclass(frozen=True)
class Rules:
    nav_separators: int = 2
    long_line: int = 12
    min_words: int = 20
    max_repeat_percent: int = 30
    max_lost: float = 0.5


def line_fails(line: bytes, words: list[bytes], rules: Rules) -> str | None:
    """The rule that a line with words fails, or None."""
    alone = sum(w in SEPARATORS for w in words)
    if alone >= rules.nav_separators or len(words) <= 3 and words[-1] in SEPARATORS:
        return "navigation"
    if _PHRASE.search(line):
        return "boilerplate"
    n_symbols = len(line) - len(line.translate(None, SYMBOLS))
    if n_symbols > len(words):
        return "punctuation"
    if len(words) >= rules.long_line and not _MARKS.search(line.decode()):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, all occurrences counted."""
    n = len(words) - WINDOW + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    first: dict[bytes, int] = {}
    rank = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    width = 1
    while width < WINDOW:           # exact names of the windows of 2, 4 and 8 words
        pair = rank[:-width] * (len(words) + 1) + rank[width:]
        names, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(names) == len(pair):
            return 0
        width *= 2
    hit = np.flatnonzero(counts[rank] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def judge(text: str | None, rules: Rules = Rules()) -> dict:
    """Measures, verdict and cleaned text of one document (null counts as empty)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    seen: set[bytes] = set()
    kept, dup, lost, failed = [], 0, 0, 0
    for line in raw.split(b"\n"):
        parts = line.split()
        if not parts:
            kept.append(line)
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, parts, rules):
            failed += 1
            lost += sum(map(len, parts))
        else:
            kept.append(line)
    repeat = repeated_words(words)
    base_failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    return {"n_words": len(words), "word_chars": len(joined.decode("utf-8", "surrogatepass")),
            "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)), "n_dup_lines": dup,
            "n_repeat_words": repeat, "base_failed": base_failed,
            "kept": not base_failed and lost <= rules.max_lost * len(joined),
            "n_failed_lines": failed, "clean_text": b"\n".join(kept).decode("utf-8", "surrogatepass")}


FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"),
          ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"),
          ("kept", "boolean"), ("n_failed_lines", "long"), ("clean_text", "string")]


def clean_lines(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id",
                text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document row: ``doc_id``, the measures, ``kept`` and ``clean_text`` (left out
    with ``with_text=False``). Null text counts as empty; repeated rows and null ids stay."""
    src = subset(docs, doc_id=doc_id, text=text)
    fields = FIELDS if with_text else FIELDS[:-1]
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in fields)

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            out = [judge(t, rules) for t in b.column("text").to_pylist()]
            cols = [pa.array([o[n] for o in out], {"long": pa.int64(), "boolean": pa.bool_(),
                                                   "string": pa.string()}[t]) for n, t in fields]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols],
                                             names=["doc_id"] + [n for n, _ in fields])
    return src.mapInArrow(run, schema)


def op4_line_quality(spark, sf_dir):
    got = clean_lines(read(spark, sf_dir, "documents"), with_text=False)
    return got.select("doc_id", *[F.col(n) for n, _ in FIELDS[:-1]])
