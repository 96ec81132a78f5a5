"""License scan by ordered signature rules.

A text becomes its words (lower-cased A-Z; runs of letters, digits and characters
beyond ASCII), joined by single spaces. A rule's regex runs only if its keyword is
among the words. Of detections the one of higher priority stays and those inside
its interval go; then the longer, then the earlier. Detections that overlap in part
both stay. Three base phrases are counted at every place and keep their labels.
Work grows with the text and with n log n of its detections.

Defined cases: null and empty texts have no words, labels or positions and score
0. Rows are scanned one by one, so repeated rows repeat their results; null ids stay,
other columns take no part.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import column, map_arrow
from heddle.llm.license_rules import signatures

BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Rules:
    def __init__(self):
        self.rules: dict[bytes, list] = defaultdict(list)
        for s in signatures():
            self.rules[s.keyword].append((s, re.compile(s.pattern)))
        self.keywords = frozenset(self.rules)

    def detect(self, words: list[bytes], text: bytes, starts: np.ndarray) -> list[tuple[int, int, str, float]]:
        """Kept detections (first word, word after the last, label, confidence) in text order."""
        hit = self.keywords.intersection(words)
        found = []
        for keyword in hit:
            for s, pattern in self.rules[keyword]:
                ends = [(m.start(), m.end(), m.group().count(b" ") + 1) for m in pattern.finditer(text)]
                for first, (a, b, n) in zip(np.searchsorted(starts, [a for a, _, _ in ends]).tolist(), ends, strict=True):
                    found.append((s.priority, a - b, first, first + n, s.label, s.confidence))
        return uncontained(sorted(found))


def uncontained(found: list[tuple]) -> list[tuple[int, int, str, float]]:
    """Of detections in order of precedence those that lie in no earlier one, in text order.

    A binary indexed tree over the starts holds the furthest end of what is kept.
    """
    starts = sorted({x[2] for x in found})
    place = {a: k + 1 for k, a in enumerate(starts)}
    furthest = [-1] * (len(starts) + 1)
    kept = []
    for _, _, a, b, label, confidence in found:
        k, reach = place[a], -1
        while k:
            reach = max(reach, furthest[k])
            k &= k - 1
        if reach >= b:
            continue
        kept.append((a, b, label, confidence))
        k = place[a]
        while k < len(furthest):
            furthest[k] = max(furthest[k], b)
            k += k & -k
    return sorted(kept)


_rules: list[Rules] = []


def _compiled() -> Rules:
    if not _rules:
        _rules.append(Rules())
    return _rules[0]


def places(text: bytes, phrase: bytes, starts: np.ndarray) -> list[int]:
    """Word positions at which the phrase stands in a text of words between single spaces."""
    out, at, needle = [], -1, b" " + phrase + b" "
    while (at := text.find(needle, at + 1)) >= 0:
        out.append(at + 1)
    return np.searchsorted(starts, out).tolist()


def scan_text(raw: bytes | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Number of words, base places (position, label), kept detections."""
    words = (raw or b"").translate(_WORD).split()
    text = b" " + b" ".join(words) + b" "
    phrases = [p for p in BASE if p in text]
    if not phrases and _compiled().keywords.isdisjoint(words):
        return len(words), [], []
    starts = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)[:-1] + 1
    base = sorted((p, BASE[phrase]) for phrase in phrases for p in places(text, phrase, starts))
    return len(words), base, _compiled().detect(words, text, starts)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: n_words, base places and labels, all labels, score, detections."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(b):
        got = [scan_text(x) for x in column(b, "text")]
        join = lambda x: ",".join(sorted(set(x)))
        return {
            "doc_id": b.column(0),
            "n_words": [n for n, _, _ in got],
            "n_base": [len(base) for _, base, _ in got],
            "first_word": pa.array([base[0][0] if base else None for _, base, _ in got], pa.int64()),
            "last_word": pa.array([base[-1][0] if base else None for _, base, _ in got], pa.int64()),
            "base_labels": [join(x for _, x in base) for _, base, _ in got],
            "labels": [join([x for _, x in base] + [x[2] for x in more]) for _, base, more in got],
            "score": [max([0.5 * bool(base)] + [x[3] for x in more]) for _, base, more in got],
            "detections": [[f"{a}-{e}:{label}" for a, e, label, _ in more] for _, _, more in got],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<string>")
