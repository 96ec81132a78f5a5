"""Packing by power-of-two decomposition.

A document of n ids is cut where the binary digits of n say: 1,000 ids become
pieces of 512, 256, 128, 64, 32 and 8. Each piece is a whole sequence of its own
bucket (pieces of equal length), so no sequence crosses documents and none needs
padding. Documents longer than the largest sequence give several pieces of that
length first.

Defined cases: a null or empty text is the end id alone, one piece of length 1.
Rows with repeated or null ids are packed row by row; ids may be of any type that can
be ordered, and other columns are not read, whatever their names. A very long text is
encoded whole, alone in its step. Sequence ids run through the buckets in turn, gapless
over the whole table.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import column, map_arrow, materialize
from heddle.llm.word_tokens import encoder

#: Pieces of a group in which they are numbered.
GROUP_ROWS = 20_000


def cuts(n: int, limit: int) -> list[int]:
    """Piece lengths of n ids, longest first: whole limits, then the binary digits of the rest."""
    out = [limit] * (n // limit)
    rest = n % limit
    return out + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limit: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids, as bytes, if asked for)."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    end = end_id.to_bytes(4, "little")
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(b):
        which, start, length, crc, total, ids = [], [], [], [], [], []
        for k, x in enumerate(encoder(tokenizer_path).encode(column(b, "text"))):
            x += end
            n, at, view = len(x) // 4, 0, memoryview(x)
            for size in cuts(n, limit):
                part = view[4 * at : 4 * (at + size)]
                which.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(part))
                total.append(n)
                if with_ids:
                    ids.append(bytes(part))
                at += size
        out = {"doc_id": b.column(0).take(pa.array(which, pa.int64())), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}
        return out | ({"ids": ids} if with_ids else {})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limit: int = 4096, with_ids: bool = False) -> DataFrame:
    """pieces() plus sequence_id and offset (always 0).

    Numbering takes no global sort: buckets (13 for 4,096) are counted and dealt into
    groups of about GROUP_ROWS pieces, and pieces are numbered inside their group.
    """
    cut = materialize(pieces(docs, tokenizer_path, end_id, limit, with_ids), "pieces")
    before = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    buckets = buckets.select("length", F.ceil(F.col("n") / GROUP_ROWS).alias("parts"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    cut = cut.join(F.broadcast(buckets), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "parts"))
    counts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"), F.first("first").alias("first"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", (F.col("first") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    return (
        cut.withColumn("rank", F.row_number().over(inside) - 1)
        .join(base, ["length", "salt"])
        .withColumn("sequence_id", (F.col("base") + F.col("rank")).cast("long"))
        .withColumn("offset", F.lit(0).cast("long"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
    )
