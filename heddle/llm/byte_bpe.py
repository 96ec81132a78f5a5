"""Byte-level BPE encoding and decoding with a queue of merges.

A text is cut at the special tokens that it contains, then into units, each of which
is encoded once for as long as it is kept. Texts of Latin-1 characters and common
marks are cut into pre-tokens at once, as the file's own pattern cuts them; of other
texts a unit is a run of white space, or what stands between two runs with the one
space before it, which no pre-token crosses, and the library's pre-tokenizer cuts the
units further. Pre-tokens are merged here: symbols form a doubly linked list, a
priority queue holds (rank, place) of every pair that may merge, and an entry whose
pair has changed since is skipped when it comes up. Decoding joins the vocabulary's
strings and turns their characters back into bytes.

Defined cases: null is the empty text, with no ids. Repeated rows and null ids are
encoded row by row; bytes that aren't UTF-8 become U+FFFD; a very long text is read
in steps of units (only a unit is held whole); other columns take no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import column, map_arrow, register_cache
from heddle.llm.word_tokens import _byte_characters

#: Fixed value: the characters that the pre-tokenizer takes for white space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: The letters and numbers of Latin-1, and the pre-tokenizer's pattern over them.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_TOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{SPACES}{_L}{_N}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Latin-1, dashes, quotation marks, the ellipsis and two signs.
_PLAIN = re.compile("[\\x00-\\xff\\u2010-\\u2026\\u20ac\\u2122]*")
#: Characters of a unit beyond which it isn't kept; units taken at a time; bits of an id and of a place.
_LONG, _STEP, _ID, _PLACE = 64, 200_000, 20, 40
#: Units kept in a worker, at least; twice as many at most.
KEPT = 500_000


class Known(dict):
    """What each unit encodes to: decimal ids joined by commas, and the bytes of their vocabulary strings.

    Of the units seen, the last ones are kept, between KEPT and twice as many: those of
    the generation before move on when they are met again.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.before = codec, {}

    def __missing__(self, unit: str) -> tuple[bytes, bytes]:
        value = self.before.get(unit)
        if value is None:
            ids = self.codec.unit(unit)
            value = b",".join([b"%d" % i for i in ids]), b"".join([self.codec.surface[i] for i in ids])
        if len(unit) <= _LONG:
            if len(self) >= KEPT:
                self.before = dict(self)
                self.clear()
            self[unit] = value
        return value


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or cut.get("type") != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"] or spec["decoder"]["type"] != "ByteLevel":
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take more than their own text aren't supported")
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        vocab = model["vocab"]
        self.start = [vocab.get(c, -1) for _, c in sorted(_byte_characters().items())]
        if min(self.start) < 0:
            raise ValueError("not every byte has a symbol")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = {c: b for b, c in _byte_characters().items()}
        self.to_byte = to_byte
        self.surface = {i: bytes(map(to_byte.__getitem__, t)) for t, i in (vocab | self.special).items()}
        #: pair of ids -> rank and new id
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << _ID | vocab[b]] = rank << _ID | vocab[a + b]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known = Known(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a list of symbols: always the lowest rank, the leftmost of equals."""
        n, get = len(ids), self.merges.get
        if n < 2:
            return ids
        queue = [found >> _ID << _PLACE | k for k, found in enumerate([get(a << _ID | b) for a, b in zip(ids, ids[1:], strict=False)]) if found is not None]
        if not queue:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            at, rank = top & (1 << _PLACE) - 1, top >> _PLACE
            right = after[at]
            if ids[at] < 0 or right == n:
                continue
            found = get(ids[at] << _ID | ids[right])
            if found is None or found >> _ID != rank:
                continue  # stale: one of the two has merged meanwhile
            ids[at], ids[right] = found & (1 << _ID) - 1, -1
            follows = after[at] = after[right]
            if follows < n:
                before[follows] = at
                found = get(ids[at] << _ID | ids[follows])
                if found is not None:
                    heapq.heappush(queue, found >> _ID << _PLACE | at)
            left = before[at]
            if left >= 0:
                found = get(ids[left] << _ID | ids[at])
                if found is not None:
                    heapq.heappush(queue, found >> _ID << _PLACE | left)
        return [x for x in ids if x >= 0]

    def unit(self, unit: str) -> list[int]:
        """Ids of a unit: each of its pre-tokens is merged by itself."""
        parts = _TOKEN.findall(unit) if _PLAIN.fullmatch(unit) else [bytes(map(self.to_byte.__getitem__, part)).decode() for part, _ in self.split(unit)]
        start = self.start.__getitem__
        return [i for part in parts for i in self.merge(list(map(start, part.encode())))]

    def units(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Units in turn, many at a time, and the special token that follows them."""
        at = 0
        for hit in self.cut.finditer(text) if self.cut else ():
            yield from self._steps(text[at : hit.start()])
            yield [], self.special[hit.group()]
            at = hit.end()
        yield from self._steps(text[at:] if at else text)

    @staticmethod
    def _steps(text: str) -> Iterator[tuple[list[str], None]]:
        cut = _TOKEN if _PLAIN.fullmatch(text) else _UNIT
        if len(text) <= _STEP:
            yield cut.findall(text), None
            return
        found = cut.finditer(text)
        while step := [m.group() for m in islice(found, _STEP)]:
            yield step, None

    def pieces(self, text: str) -> Iterator[list[tuple[bytes, bytes]]]:
        """(decimal ids joined by commas, bytes of their vocabulary strings) of the units in turn."""
        for units, special in self.units(text):
            if special is not None:
                yield [(b"%d" % special, self.surface[special])]
                continue
            if units:
                yield list(map(self.known.__getitem__, units))

    def encode(self, text: str) -> list[int]:
        return [int(i) for step in self.pieces(text) for ids, _ in step for i in ids.split(b",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids joined by commas, sha256 of the decoded text."""
        n, own, back = 0, hashlib.sha256(), []
        for step in self.pieces(text):
            ids = b",".join([x[0] for x in step])
            own.update(b"," + ids if n else ids)
            n += ids.count(b",") + 1
            back.append(b"".join([x[1] for x in step]))
        return n, own.hexdigest(), hashlib.sha256(b"".join(back).decode("utf-8", "replace").encode()).hexdigest()


_codecs: dict[str, Codec] = {}
register_cache(__name__, _codecs.clear)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _texts(b) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column(b, "text")]


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids."""
    docs, head = _rows(docs)

    return map_arrow(docs, lambda b: {"doc_id": b.column(0), "ids": [codec(path).encode(x) for x in _texts(b)]}, f"{head}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of the ids of encode(), special tokens included; null ids give null."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        encoded.select("doc_id", "ids"),
        lambda b: {"doc_id": b.column(0), "text": [None if x is None else codec(path).decode(x) for x in column(b, "ids")]},
        f"doc_id {kind}, text string",
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode without keeping the ids."""
    docs, head = _rows(docs)

    def run(b):
        got = [codec(path).digest(x) for x in _texts(b)]
        return {"doc_id": b.column(0), "n_tokens": [g[0] for g in got], "ids_sha256": [g[1] for g in got], "decoded_sha256": [g[2] for g in got]}

    return map_arrow(docs, run, f"{head}, n_tokens long, ids_sha256 string, decoded_sha256 string")
