"""SentencePiece encoding that keeps byte offsets, and decoding.

Normalisation walks the text through the model's compiled character map (a
double-array trie of source strings and their replacements), always taking the
longest prefix, and records for every normalised byte the source byte it came
from. Encoding cuts the normalised text where no merge can cross (before a run
of spaces or a line feed) and encodes each distinct stretch once through the
sentencepiece library. Every piece is then projected through the alignment to the
bytes of the original text that it covers.

Defined cases: null is the empty text; it encodes to the end id alone, decodes to
the empty text and has no bytes to cover. Repeated rows and null ids are encoded
row by row; a very long text is a step of its own; other columns take no part.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import CACHE_ENTRIES, column, map_arrow, register_cache

SPACE = "▁"
_LONG = 64
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}\\n]*|\\n[^{SPACE}\\n]*|[^{SPACE}\\n]+")


class CharMap:
    """Longest-prefix lookup in a compiled character map; an empty map is the identity."""

    def __init__(self, blob: bytes):
        self.units: np.ndarray = np.zeros(0, np.uint32)
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and its replacement."""
        units = self.units
        node = self._step(int(units[0]))
        best = None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            u = int(units[node])
            if u & 0x800000FF != data[k]:
                break
            node ^= self._step(u)
            if u >> 8 & 1:
                value = int(units[node]) & 0x7FFFFFFF
                best = (k + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)])
        return best

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each byte edge of them (one more than bytes), the source edge."""
        if not len(self.units):
            return data, np.arange(len(data) + 1)
        out, edges, at = bytearray(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                lead = data[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                piece = data[at : at + size]
                edges += range(at, at + len(piece))
            else:
                size, piece = hit
                edges += [at] * len(piece)
            out += piece
            at += size
        return bytes(out), np.array([*edges, len(data)])


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        spec, proto = self._model(path)
        self.map, self.dummy, self.squeeze = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        # texts are normalised here, with their alignment; the library gets them as they are then
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.known: dict[str, tuple[bytes, str, bytes]] = {}
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}|\\n", p) for p in pieces):
            raise ValueError("this model has pieces across spaces or lines")
        self.size = [1 if self.lib.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)]

    @staticmethod
    def _model(path: str):
        """The file's normaliser, and the model without it."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = type(m.normalizer_spec)()
        spec.CopyFrom(m.normalizer_spec)
        if not spec.escape_whitespaces:
            raise ValueError("models that don't mark spaces aren't supported")
        m.normalizer_spec.precompiled_charsmap = b""
        m.normalizer_spec.remove_extra_whitespaces = False
        return spec, m.SerializeToString()

    def normalize(self, text: bytes | None) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each byte edge of them, the source edge.

        Where the model drops white space, the first space of a run stays, and none at
        the text's ends.
        """
        data, edges = self.map.normalize(text or b"")
        if self.squeeze and data:
            raw = np.frombuffer(data, np.uint8)
            space = raw == 0x20
            at = np.flatnonzero(~space | ~np.insert(space[:-1], 0, True))
            if len(at) and space[at[-1]]:
                at = at[:-1]
            data, edges = raw[at].tobytes(), np.append(edges[:-1][at], edges[-1])
        return data, edges

    def _learn(self, stretches: list[str]) -> dict[str, tuple[bytes, str, bytes]]:
        """Ids, surface and piece sizes (bytes of the normalised text, 16 bits each) of each stretch."""
        lead = 1 if self.dummy else 0
        inner = [s.startswith(SPACE) and self.dummy for s in stretches]
        texts = [(s[1:] if i else s).replace(SPACE, " ") for s, i in zip(stretches, inner, strict=True)]
        out = {}
        for s, i, ids in zip(stretches, inner, self.lib.encode(texts, num_threads=1), strict=True):
            if s == SPACE and i:
                ids = [self.lib.piece_to_id(SPACE)]  # of an empty text the library makes no piece
            elif not i and lead:
                ids = ids[1:]  # the prefix stands alone here: no piece joins it to what isn't a space
            text = self.lib.decode(ids)
            if s.startswith(SPACE) and self.dummy:
                text = " " + text
            out[s] = (b"".join(b"%d " % x for x in ids), text, np.array([self.size[x] for x in ids], np.uint16).tobytes())
        return out

    def stretches(self, normalized: str) -> list[str]:
        """Stretches of a normalised text; each starts with a run of spaces, a line feed, or the text."""
        s = normalized.replace(" ", SPACE)
        return _STRETCH.findall(SPACE + s if self.dummy and s else s)

    def encode(self, texts: list[bytes | None]) -> list[tuple[bytes, np.ndarray, list[tuple[bytes, str, bytes]]]]:
        """Normalised bytes, source edges and stretches of each text."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        normal = [self.normalize(x) for x in texts]
        cut = [self.stretches(data.decode("utf-8", "replace")) for data, _ in normal]
        known = self.known
        new = list(set().union(*cut) - known.keys())
        long: dict = {}
        for at in range(0, len(new), 20_000):
            found = self._learn(new[at : at + 20_000])
            for s, v in found.items():
                (known if len(s) <= _LONG else long)[s] = v
        parts = [[known[s] if s in known else long[s] for s in x] if long else list(map(known.__getitem__, x)) for x in cut]
        return [(data, edges, p) for (data, edges), p in zip(normal, parts, strict=True)]

    def digest(self, parts: list[tuple[bytes, str, bytes]], end_id: int) -> tuple[int, bytes, bytes]:
        """Number of ids with the end id, sha256 of the ids, sha256 of the decoded text."""
        ids = b"".join([p[0] for p in parts]) + b"%d" % end_id
        text = "".join([p[1] for p in parts])
        if self.dummy:
            text = text[1:]
        return ids.count(b" ") + 1, hashlib.sha256(ids).digest(), hashlib.sha256(text.encode()).digest()

    def spans(self, data: bytes, edges: np.ndarray, parts: list[tuple[bytes, str, bytes]]) -> np.ndarray:
        """The byte edges in the original text between which the pieces lie, one more than pieces."""
        # bytes of the escaped text before each normalised byte: a space mark takes three
        width = np.where(np.frombuffer(data, np.uint8) == 0x20, 3, 1)
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        if self.dummy and len(data):
            at += 3
        sizes = np.frombuffer(b"".join([p[2] for p in parts]), np.uint16)
        ends = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        return edges[np.minimum(np.searchsorted(at, ends), len(data))]


_codecs: dict[str, Codec] = {}
register_cache(__name__, _codecs.clear)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, ids (with the end id), and the byte span of each piece (the end id's is empty)."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(b):
        c, ids, starts, ends = codec(model_path), [], [], []
        for data, edges, parts in c.encode(column(b, "text")):
            e = c.spans(data, edges, parts)
            ids.append([int(x) for p in parts for x in p[0].split()] + [end_id])
            starts.append(e)
            ends.append(np.append(e[1:], e[-1]))
        return {"doc_id": b.column(0), "ids": ids, "starts": starts, "ends": ends}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of the ids of encode()."""

    def run(b):
        return {"doc_id": b.column(0), "text": codec(model_path).lib.decode(column(b, "ids"))}

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, model_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, spans_crc32: encode and decode without keeping the ids.

    n_bytes: bytes of the original text that the pieces cover; spans_crc32: of the byte
    edges between the pieces, as little-endian unsigned 32-bit numbers.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(b):
        c = codec(model_path)
        got, covered, spans = [], [], []
        for data, edges, parts in c.encode(column(b, "text")):
            got.append(c.digest(parts, end_id))
            e = c.spans(data, edges, parts)
            covered.append(e[-1] - e[0])
            spans.append(zlib.crc32(e.astype("<u4").tobytes()))
        return {"doc_id": b.column(0), "n_tokens": [g[0] for g in got], "ids_sha256": [g[1].hex() for g in got], "decoded_sha256": [g[2].hex() for g in got], "n_bytes": covered, "spans_crc32": spans}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_crc32 long")
