"""Token ids of a tokenizers file, with bounded caches of words and their parts.

The pre-tokenizer of the file never joins characters across ASCII white space, so
a text's ids are the ids of its words in turn. Words of letters (ASCII and
Latin-1), digits and ASCII marks are cut as the file's own pattern cuts them; the
new parts of a batch then go to the file's model in one call, told apart by their
end-of-word tokens. All other words go through the whole tokenizer one by one.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from heddle.llm.common import CACHE_ENTRIES, register_cache

_LONG = 64  # bytes of a word beyond which it isn't kept
_STEP = 4 << 20  # bytes of text encoded at a time

#: Fixed value: the pattern of the pre-tokenizer that the direct way reproduces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
_PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.model = None
        if suffix and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": PATTERN}:
            self.model = Tokenizer.from_file(path)
            self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
            self.characters = _byte_characters()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        at = size = 0
        for k, x in enumerate(texts):
            size += len(x or b"")
            if size >= _STEP or k == len(texts) - 1:
                out += self._encode(texts[at : k + 1])
                at, size = k + 1, 0
        return out

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        words = [(x or b"").split() for x in texts]
        seen = set().union(*words)
        new = seen - self.known.keys()
        known = self.known
        if len(known) + len(new) > CACHE_ENTRIES:  # what this step needs stays
            known = self.known = {w: known[w] for w in seen - new}
        known |= self._learn(new)
        out = [b"".join(map(known.__getitem__, x)) for x in words]
        for w in new:
            if len(w) > _LONG:
                del known[w]
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        hard, cut = [], {}
        for w in words:
            s = w.decode("utf-8", "replace")
            if self.model is not None and _PLAIN.fullmatch(s) and "<|" not in s:
                cut[w] = _PART.findall(s.lower())
            else:
                hard.append((w, s))
        found = {}
        for at in range(0, len(hard), 2000):
            step = hard[at : at + 2000]
            for (w, _), e in zip(step, self.tokenizer.encode_batch([s for _, s in step], add_special_tokens=False), strict=True):
                found[w] = np.array(e.ids, "<u4").tobytes()
        if cut:
            seen = set().union(*cut.values())
            parts = self.parts
            new = list(seen - parts.keys())
            if len(parts) + len(new) > CACHE_ENTRIES:
                parts = self.parts = {p: parts[p] for p in seen.difference(new)}
            for at in range(0, len(new), 20_000):
                parts |= self._model_ids(new[at : at + 20_000])
            for w, own in cut.items():
                found[w] = b"".join([parts[p] for p in own])
        return found

    def _model_ids(self, parts: list[str]) -> dict[str, bytes]:
        text = " ".join(parts).encode().decode("latin-1").translate(self.characters | {32: " "})
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        to = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(to) != len(parts):
            raise ValueError("each part must end with one end-of-word token")
        raw = ids.tobytes()
        return {p: raw[a:b] for p, a, b in zip(parts, [0, *to], to, strict=False)}


_encoders: dict[str, Encoder] = {}
register_cache("heddle.llm.packing", _encoders.clear)


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
