"""Quality rules as a short-circuit cascade.

Each rule rejects a text. A bounded sample gives every rule's cost (seconds a
text) and selectivity (share rejected); rules then run in the order of rejection
per cost, each only on the texts that all earlier ones have let through. The
verdict is a conjunction, so the order decides the time taken and never the
result; which rule was the first to reject depends on the order and isn't told.

Defined cases: null and empty texts have no words, so base_failed is true and
kept false. Repeated rows and null ids are judged row by row. Other columns of
the input, whatever their names, take no part.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import column, enter, hash_words, map_arrow, windows

_SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"
_NOT_CODE_POINT = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_OTHER = bytes(set(range(256)) - set(_UPPER) - set(_LOWER))
_DIGITS = b"0123456789"


class Text:
    """One text with its words and base measures."""

    __slots__ = ("raw", "words", "hashes", "n", "chars", "symbols", "lines", "dup_lines", "repeat_words")

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""
        self.words = self.raw.split()
        self.n = len(self.words)
        self.hashes = hash_words(self.words)
        self.chars = len(self.raw.translate(None, _NOT_CODE_POINT))
        self.symbols = len(self.raw) - len(self.raw.translate(None, _SYMBOLS))
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        self.lines = len(lines)
        self.dup_lines = len(lines) - len(set(lines))
        self.repeat_words = repeat_words(self.hashes)

    @property
    def base_failed(self) -> bool:
        return self.n < 10 or 100 * self.repeat_words > 20 * self.n


def repeat_words(hashes: np.ndarray, size: int = 5) -> int:
    """Words inside windows of `size` words that occur twice or more in the text."""
    n = len(hashes)
    if n <= size:
        return 0
    w = windows(hashes, size)
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


#: Texts by which rules are ordered: the sample's bound, whatever the input.
SAMPLE_ROWS = 4000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _upper_share(t: Text) -> bool:
    up = len(t.raw.translate(None, _OTHER + _LOWER))
    low = len(t.raw.translate(None, _OTHER + _UPPER))
    return up + low >= 20 and up > 0.6 * (up + low)


def _word_runs(t: Text) -> bool:
    return 100 * int((t.hashes[1:] == t.hashes[:-1]).sum()) > 20 * t.n


def _letters(t: Text) -> bool:
    """Under 60 % of the words hold a letter (ASCII or any character beyond)."""
    return 100 * len(re.findall(rb"[^\x20\x09-\x0D]*[A-Za-z\x80-\xFF][^\x20\x09-\x0D]*", t.raw)) < 60 * t.n


def _compresses(t: Text) -> bool:
    return len(t.raw) >= 2000 and len(zlib.compress(t.raw, 1)) < 0.08 * len(t.raw)


def _bullets(t: Text) -> bool:
    return t.lines >= 10 and 10 * len(re.findall(rb"(?m)^[ \t]*(?:[-*]|\xe2\x80\xa2)[ \t]", t.raw)) > 9 * t.lines


def _word_length(t: Text) -> bool:
    return not 2 * t.n <= t.chars <= 15 * t.n


RULES = (
    Rule("word_length", _word_length),
    Rule("symbols", lambda t: 100 * t.symbols > 30 * t.n),
    Rule("dup_lines", lambda t: t.lines >= 5 and 10 * t.dup_lines > 4 * t.lines),
    Rule("upper_case", _upper_share),
    Rule("word_runs", _word_runs),
    Rule("exclaimed", lambda t: 100 * len(re.findall(rb"!(?=[\s!]|$)", t.raw)) > 40 * t.n),
    Rule("few_letters", _letters),
    Rule("digits", lambda t: 2 * (len(t.raw) - len(t.raw.translate(None, _DIGITS))) > t.chars),
    Rule("bullet_lines", _bullets),
    Rule("compresses", _compresses),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, seed: int = 7) -> list[dict]:
    """Cost and selectivity of each rule on about so many sampled texts, measured where they lie.

    The share sampled comes from the number of rows, which needs no column. Only a
    few sums per rule reach the driver, and the sample decides only the order of the
    rules. An empty sample keeps the given order.
    """

    def measure(batches):
        enter(__name__)
        seconds, hits, n = [0.0] * len(rules), [0] * len(rules), 0
        for b in batches:
            texts = [t for t in map(Text, column(b, "text")) if not t.base_failed]
            n += len(texts)
            for k, r in enumerate(rules):
                began = time.process_time()
                hits[k] += sum(r.rejects(t) for t in texts)
                seconds[k] += time.process_time() - began
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((range(len(rules)), seconds, hits, [n] * len(rules)), kinds, strict=True)], ["k", "seconds", "hits", "n"])

    share = min(1.0, rows / max(1, docs.count()))
    sample = docs.select(F.col("text").cast("binary").alias("text")).sample(share, seed)
    sums = sample.mapInArrow(measure, "k int, seconds double, hits long, n long").groupBy("k").agg(F.sum("seconds").alias("seconds"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return [{"k": r.k, "rule": rules[r.k].name, "cost": r.seconds / max(1, r.n), "selectivity": r.hits / max(1, r.n), "n": r.n} for r in sums.collect()]


def ordered(rules: tuple[Rule, ...], stats: list[dict]) -> tuple[Rule, ...]:
    """Highest rejection per cost first; ties and unseen rules keep the given order."""
    gain = {s["k"]: s["selectivity"] / max(s["cost"], 1e-9) for s in stats}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base measures, base_failed, kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    order = ordered(rules, estimate(docs, rules, sample_rows))

    def run(b):
        texts = [Text(x) for x in column(b, "text")]
        return {
            "doc_id": b.column(0),
            "n_words": [t.n for t in texts],
            "word_chars": [t.chars for t in texts],
            "n_symbols": [t.symbols for t in texts],
            "n_dup_lines": [t.dup_lines for t in texts],
            "n_repeat_words": [t.repeat_words for t in texts],
            "base_failed": [t.base_failed for t in texts],
            "kept": [passes(t, order) for t in texts],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def passes(t: Text, order: tuple[Rule, ...]) -> bool:
    return not t.base_failed and not any(r.rejects(t) for r in order)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns, in one pass over the texts.

    Python is sent the texts alone and gives back a boolean; the rows stay in the JVM.
    """
    order = ordered(rules, estimate(docs.select(F.col(text_col).alias("text")), rules, sample_rows))

    @F.arrow_udf("boolean")
    def good(raw: pa.Array) -> pa.Array:
        enter(__name__)
        return pa.array([passes(Text(x.as_py()), order) for x in raw], pa.bool_())

    return docs.where(good(F.col(text_col).cast("binary")))
