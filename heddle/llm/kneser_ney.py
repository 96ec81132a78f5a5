"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model's trigrams are counted on trusted text: documents labelled good and not
toxic, at most max_docs of them and max_words words in all (a bounded training
sample of labelled rows, drawn by a hash of the id). Counts, continuation counts and context
totals are joined by n-gram hash in Spark. The finished model, of at most five
entries a training word, is cut into shards by hash; each task joins the n-grams
of its documents with one shard after another, so no n-gram of the corpus is
shuffled. A document is kept if its perplexity isn't above its language's limit:
a high quantile over all trusted documents that the model wasn't trained on, and a
margin. All documents are scored whole.

Defined cases: null and empty texts are the end token alone. Documents of a
language without held-out trusted text, or of no language, are held to the limit
of all languages together; without any trusted text everything is kept. Repeated
rows and null ids are scored row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import column, discard, fresh, local_rows, map_arrow, materialize, mix, text_words
from heddle.llm.hash_table import Table, shard_of

_BEGIN, _END = np.uint64(0x51ED270B7A1F3C55), np.uint64(0x3C6EF372FE94F82B)
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Rows up to which a table of a few numbers a row is broadcast; its rows are counted first.
BROADCAST_ROWS = 500_000
#: Kinds of table entries, mixed into the hashes so that all share one table.
_KINDS = {"p1": np.uint64(11), "g1": np.uint64(22), "a2": np.uint64(33), "g2": np.uint64(44), "a3": np.uint64(55)}


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Hashes (w, v, vw, uv, uvw) of every token's n-grams in turn, and the number of tokens of each text.

    Tokens are the words, A-Z lower-cased, and an end; two begin marks stand before the first.
    """
    flat, counts = text_words(texts)
    sizes = counts + 1
    ends = np.cumsum(sizes) - 1
    w = np.empty(int(sizes.sum()), np.uint64)
    at_end = np.zeros(len(w), bool)
    at_end[ends] = True
    w[at_end], w[~at_end] = _END, flat
    starts = ends - sizes + 1
    v, u = np.roll(w, 1), np.roll(w, 2)
    v[starts] = u[starts] = _BEGIN
    second = starts[sizes > 1] + 1
    u[second] = _BEGIN
    vw = mix(v * _M[0] ^ w * _M[1])
    uv = mix(u * _M[0] ^ v * _M[1])
    uvw = mix(uv * _M[2] ^ w * _M[1])
    return w, v, vw, uv, uvw, sizes


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """uvw, uv, vw, v, w, c: the counts of all trigrams."""

    def run(b):
        w, v, vw, uv, uvw, _ = grams(column(b, "text"))
        _, first, c = np.unique(uvw, return_index=True, return_counts=True)
        return {k: _signed(x[first]) for k, x in (("uvw", uvw), ("uv", uv), ("vw", vw), ("v", v), ("w", w))} | {"c": c}

    found = map_arrow(docs.select(F.col("text").cast("binary").alias("text")), run, "uvw long, uv long, vw long, v long, w long, c long", 500)
    return found.groupBy("uvw", "uv", "vw", "v", "w").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of one order from its counts of counts."""
    n = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _order(counts: DataFrame, context: str, gram: str, d: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(gram, alpha) and (context, gamma) of one order, from its counts."""
    mass = counts.groupBy(context).agg(F.sum("c").alias("total"), F.sum(_discount(F.col("c"), d)).alias("freed"))
    alpha = counts.join(mass, context).select(F.col(gram).alias("h"), ((F.col("c") - _discount(F.col("c"), d)) / F.col("total")).alias("x"))
    return alpha, mass.select(F.col(context).alias("h"), (F.col("freed") / F.col("total")).alias("x"))


def train(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables (h, x) of the model: a3, g2 (by uv), a2, g1 (by v), p1; p1 has the unknown word's share under h = 0."""
    tri = materialize(trigram_counts(docs), "trigrams")
    begin = int(np.array([_BEGIN]).view(np.int64)[0])
    # how many words come before a bigram; one that begins a text has its count instead
    bi = tri.groupBy("vw", "v", "w").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")).withColumn("c", F.when(F.col("v") == begin, F.col("s")).otherwise(F.col("n"))).drop("n", "s")
    bi = materialize(bi, "bigrams")
    uni = bi.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    a3, g2 = _order(tri, "uv", "uvw", discounts(tri))
    a2, g1 = _order(bi, "v", "vw", discounts(bi))
    d1 = discounts(uni)
    s = uni.agg(F.sum("c").alias("total"), F.sum(_discount(F.col("c"), d1)).alias("freed"), F.count(F.lit(1)).alias("words")).first()
    unknown = (s.freed or 0.0) / (s.total or 1) / (s.words + 1) if s.total else 1.0
    p1 = uni.select(F.col("w").alias("h"), ((F.col("c") - _discount(F.col("c"), d1)) / F.lit(s.total or 1) + unknown).alias("x"))
    p1 = p1.union(docs.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(float(unknown))))
    return {"a3": a3, "g2": g2, "a2": a2, "g1": g1, "p1": p1}


def load(spark: SparkSession, tables: dict[str, DataFrame], shards: int = 16) -> tuple[Table, float]:
    """The model's shards and the unknown word's probability; the driver holds one shard at a time."""
    unknown = tables["p1"].where("h = 0").select("x").first()[0]
    kinds = list(_KINDS)

    def keyed(b):
        h = b.column(0).to_numpy().view(np.uint64)
        key = mix(h + np.array(list(_KINDS.values()))[b.column(2).to_numpy()])
        return {"key": _signed(key), "x": b.column(1).to_numpy().astype(np.float32), "shard": shard_of(key, shards).astype(np.int32)}

    every = None
    for k, kind in enumerate(kinds):
        t = tables[kind].select("h", "x", F.lit(k).alias("kind"))
        every = t if every is None else every.union(t)
    parts = materialize(map_arrow(every, keyed, "key long, x float, shard int", 1 << 20).repartition("shard"), "model", "shard")

    def part(s: int) -> tuple[np.ndarray, np.ndarray]:
        got = parts.where(F.col("shard") == s).select("key", "x").toArrow()
        return got.column("key").to_numpy().view(np.uint64), got.column("x").to_numpy()

    return Table(spark.sparkContext, map(part, range(shards))), float(unknown)


def token_logs(table: Table, unknown: float, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every token, and the number of tokens of each text."""
    w, v, vw, uv, uvw, sizes = grams(texts)
    look = lambda kind, h, default: table.get(mix(h + _KINDS[kind]), default).astype(np.float64)
    p = look("p1", w, unknown)
    seen = np.flatnonzero((g := look("g1", v, 2.0)) < 2.0)
    p[seen] = look("a2", vw[seen], 0.0) + g[seen] * p[seen]
    seen = np.flatnonzero((g := look("g2", uv, 2.0)) < 2.0)
    p[seen] = look("a3", uvw[seen], 0.0) + g[seen] * p[seen]
    return np.log10(p), sizes


def score(docs: DataFrame, table: Table, unknown: float, text_col: str = "text") -> DataFrame:
    """One row per row of docs: all columns but the text, n_tokens and log10_p."""
    others = [c for c in docs.columns if c != text_col]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)

    def run(b):
        logs, sizes = token_logs(table, unknown, b.column(len(others)).to_pylist())
        return {c: b.column(k) for k, c in enumerate(others)} | {"n_tokens": sizes, "log10_p": np.add.reduceat(logs, np.cumsum(sizes) - sizes)}

    return map_arrow(docs.select(*others, F.col(text_col).cast("binary")), run, f"{kinds}n_tokens long, log10_p double", 300)


@dataclass(frozen=True)
class Classifier:
    #: Trusted documents to train on, and words in all: the bound of the training sample, and of nothing else.
    max_docs: int = 4000
    max_words: int = 2_000_000
    quantile: float = 0.995
    margin: float = 1.1
    #: Tokens of average difficulty added to each document, so that short ones aren't judged by a few words.
    prior_tokens: int = 20

    def samples(self, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The documents to train on, of bounded size, and the ids of all other trusted documents.

        Half of the trusted ids may train. Of these the first max_docs by hash are looked
        at; one that would go beyond a bound is passed over.
        """
        good = materialize(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct(), "trusted")
        half = good.where(F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0)
        first = half.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("r", F.xxhash64("doc_id", F.lit("trusted"))).orderBy("r", "doc_id").limit(self.max_docs)
        n_words = F.coalesce(F.size(F.split("text", r"[\x20\x09-\x0D]+")), F.lit(0))
        sizes = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").groupBy("r", "doc_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(n_words).alias("words"))
        chosen, n_docs, total = [], 0, 0
        for x in sorted(sizes.collect()):
            if n_docs + x.docs <= self.max_docs and total + x.words <= self.max_words:
                chosen.append((x.doc_id,))
                n_docs, total = n_docs + x.docs, total + x.words
        own = F.broadcast(local_rows(docs.sparkSession, chosen, good.schema))
        return docs.join(own, "doc_id", "left_semi"), good.join(own, "doc_id", "left_anti")

    def _level(self, mean: Column) -> Column:
        """log10 perplexity drawn towards mean by prior_tokens."""
        return (-F.col("log10_p") + self.prior_tokens * mean) / (F.col("n_tokens") + self.prior_tokens)

    def _scored(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """doc_id, lang, text_key (a hash of the text), n_tokens, log10_p, level, limit: one row per row of docs.

        All documents are scored once and their numbers written; the limits are then
        taken from the scores of all trusted documents that the model wasn't trained
        on. Only ids and scores are joined with the labels, never texts. The limits are
        one row a language.
        """
        train_docs, held = self.samples(docs, labels)
        table, unknown = load(docs.sparkSession, train(train_docs))
        scored = materialize(score(docs.select("doc_id", "lang", F.xxhash64("text").alias("text_key"), "text"), table, unknown), "scored")
        known = materialize(scored.select("doc_id", "lang", "n_tokens", "log10_p").join(held, "doc_id", "left_semi"), "held")
        mean = known.groupBy("lang").agg((-F.sum("log10_p") / F.sum("n_tokens")).alias("mean"))
        every = known.agg((-F.sum("log10_p") / F.sum("n_tokens")).alias("mean")).first()["mean"] or 0.0
        limits = known.join(F.broadcast(mean), "lang").withColumn("level", self._level(F.col("mean"))).groupBy("lang").agg(F.percentile_approx("level", self.quantile, 10_000).alias("limit"), F.first("mean").alias("mean"))
        limits = materialize(limits.where("lang is not null"), "limits")
        top = known.withColumn("level", self._level(F.lit(every))).agg(F.percentile_approx("level", self.quantile, 10_000).alias("x")).first()["x"]
        discard(known)
        joined = scored.join(F.broadcast(limits), "lang", "left")
        joined = joined.withColumn("limit", F.coalesce("limit", F.lit(top).cast("double"), F.lit(float("inf"))) + float(np.log10(self.margin)))
        return joined.withColumn("level", self._level(F.coalesce("mean", F.lit(float(every))))).drop("mean")

    def judge(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """doc_id, lang, n_tokens, perplexity, level (perplexity with the prior), limit, kept."""
        ten = F.lit(10.0)
        scored = self._scored(docs, labels)
        return scored.select("doc_id", "lang", "n_tokens", F.pow(ten, -F.col("log10_p") / F.col("n_tokens")).alias("perplexity"), F.pow(ten, F.col("level")).alias("level"), F.pow(ten, F.col("limit")).alias("limit"), (F.col("level") <= F.col("limit")).alias("kept"))

    def keep(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of docs that judge() keeps, with all their columns.

        Rows of the same id, language and text share a verdict, so the rejected ones are
        told by these three; texts are neither written nor shuffled, unless more than
        BROADCAST_ROWS go.
        """
        gone = self._scored(docs, labels).where("not coalesce(level <= limit, false)").select("doc_id", "lang", "text_key").distinct()
        names = [fresh(docs, f"_gone_{k}") for k in range(3)]
        gone = materialize(gone.toDF(*names), "gone")
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
        same = docs["doc_id"].eqNullSafe(gone[names[0]]) & docs["lang"].eqNullSafe(gone[names[1]]) & (F.xxhash64(docs["text"]) == gone[names[2]])
        return docs.join(gone, same, "left_anti")
