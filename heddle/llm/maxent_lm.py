"""Language-model scoring with a hashed, class-factored maximum-entropy model.

P(word | history) = P(class | history) P(group | class, history) P(word | group).
Classes go by frequency: the most frequent words, in order, have a group of their
own in one of the first classes; all others share the groups of the remaining
classes by a hash. The first two factors are softmaxes. Their features are hashes
of the previous words themselves: the word before (n-gram), the word before that
(skip) and both together (n-gram), for the second factor each with the class. A
feature is a row of weights, one for every outcome. The number of rows grows with
the distinct words of the training documents, up to MOST_BITS (32 MB of weights).

Training deals the training documents, all of them, into as many parts as there
are steps. Each step is one distributed gradient update: tasks sum what their part
shows and what the weights expect, sparse by blocks of rows; the sums are added
where they are shuffled to, and the weights of each row move by its own ratio.

Word counts cover all training tokens. Counts of the head (a bounded number of
frequent words) are broadcast; the remaining tokens of each batch of documents are
sent, packed, to the shards of the count table and their counts come back to the
batch. A shard is sent as often as its requests need, so that no task's share of
them grows with the corpus. Scoring works on sparse batches: only the rows of the
histories that occur are read.

Words are told apart by 64 bits.

Defined cases: null and empty texts are the end token alone. Documents without an
id count as training documents. Repeated rows are counted and scored row by row.
Without training tokens every word is unknown: base_score is 0 and groups are
equally likely. A text of any length is a step of its own. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from heddle.llm.common import WHOLE, column, enter, map_arrow, materialize, mix, register_cache, slices, text_words
from heddle.llm.hash_table import Shard

#: Outcomes of each of the two softmaxes.
CLASSES = GROUPS = 32
#: Groups of a single word; the first is the end token's. The others take half the classes.
OWN = CLASSES // 2 * GROUPS
#: Distinct training words per row of weights, and the bounds of the rows' number as powers of two.
WORDS_A_ROW, LEAST_BITS, MOST_BITS = 64, 8, 17
#: Rows of weights that are summed together.
BLOCK = 64
#: How far an update goes, the counts that hold it back, and the bound of a weight.
RATE, PRIOR, MOST_WEIGHT = 0.5, 4.0, 12.0
#: Input splits of a training task at most, where there are more than cores.
SPLITS = 32
#: Tokens that a step of numpy works on.
STEP = 1 << 13
#: Frequent words whose counts are broadcast (16 bytes each).
HEAD = 1 << 17
#: Words of a shard of the count table, and requests that one copy of it answers.
SHARD_WORDS, ASKED = 500_000, 2_000_000
_END = np.uint64(0x3C6EF372FE94F800)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


register_cache(__name__, lambda: _seen.clear())


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in turn (each text's words and an end), and the texts' sizes."""
    words, counts = text_words(texts)
    sizes = counts + 1
    out = np.full(int(sizes.sum()), _END, np.uint64)
    at_end = np.zeros(len(out), bool)
    at_end[np.cumsum(sizes) - 1] = True
    out[~at_end] = words
    return out, sizes


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c of every distinct token of docs."""

    def run(b):
        found = [np.unique(tokens(column(x, "text"))[0], return_counts=True) for x in slices(b)]
        h, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        c = np.bincount(at, np.concatenate([x[1] for x in found]), len(h))
        return {"h": h.view(np.int64), "c": c.astype(np.int64)}

    return map_arrow(docs.select("text"), run, "h long, c long", WHOLE).groupBy("h").agg(F.sum("c").alias("c"))


def shared_group(h: np.ndarray) -> np.ndarray:
    """Group of a word that has none of its own."""
    return (OWN + (h & np.uint64(CLASSES * GROUPS - OWN - 1)).astype(np.int64)).astype(np.int32)


class Groups:
    """Group of each token: one of the frequent words' own, or a shared one. A group's class is group // GROUPS."""

    def __init__(self, frequent: np.ndarray):
        own = np.concatenate([[_END], frequent[frequent != _END][: OWN - 1]]).astype(np.uint64)
        order = np.argsort(own)
        self.keys, self.ids = own[order], order.astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], shared_group(h))


def features(h: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's three features; before a text's first word stands the end token."""
    starts = np.cumsum(sizes) - sizes
    one, two = np.roll(h, 1), np.roll(h, 2)
    one[starts] = two[starts] = _END
    two[starts[sizes > 1] + 1] = _END
    return [mix(one * _MIX[0]), mix(two * _MIX[1]), mix(one * _MIX[2] + two * _MIX[3])]


def rows_of(x: np.ndarray, bits: int, classes: np.ndarray | None = None) -> np.ndarray:
    """Rows of hashed features among 2 ** bits, in the second factor with the class."""
    if classes is not None:
        x = (x ^ (classes.astype(np.uint64) + np.uint64(1)) * _MIX[1]) * _MIX[0]
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], room: np.ndarray) -> np.ndarray:
    """Softmax of the bias and the rows' weights, tokens x outcomes, in the first half of room (2 x tokens x outcomes)."""
    n = len(rows[0])
    s, more = room[0, :n], room[1, :n]
    # rows lie within the weights; only other modes than "raise" write to room without a copy
    weights.take(rows[0], axis=0, out=s, mode="clip")
    for r in rows[1:]:
        s += weights.take(r, axis=0, out=more, mode="clip")
    s += bias
    np.exp(s, out=s)  # weights are held within MOST_WEIGHT, so this stays finite
    s *= (1 / (s @ np.ones(s.shape[1], s.dtype)))[:, None]
    return s


def factors(weights: np.ndarray, bias: tuple[np.ndarray, np.ndarray], h: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
    """(tokens, rows, outcomes, probabilities) of both factors, in steps of STEP tokens; the next step overwrites the probabilities."""
    bits = weights.shape[1].bit_length() - 1
    x, classes, own = features(h, sizes), groups // GROUPS, groups % GROUPS
    room = np.empty((2, min(STEP, len(h)), weights.shape[2]), np.float32)
    for at in range(0, len(h), STEP):
        part = slice(at, at + STEP)
        k = classes[part]
        rows = [rows_of(f[part], bits) for f in x]
        yield part, 0, rows, k, probabilities(weights[0], bias[0], rows, room)
        rows = [rows_of(f[part], bits, k) for f in x]
        yield part, 1, rows, own[part], probabilities(weights[1], bias[1].take(k, axis=0), rows, room)


def log_probabilities(weights: np.ndarray, bias: tuple[np.ndarray, np.ndarray], h: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """log10 P(group | history) of each token."""
    out = np.zeros(len(h))
    for part, _, _, outcome, p in factors(weights, bias, h, sizes, groups):
        out[part] += np.log10(p[np.arange(len(p)), outcome])
    return out


def add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """total[rows] += values, where rows may repeat; numbers go in pairs, as complex ones."""
    pairs = total.shape[1] // 2
    places = (rows * pairs)[:, None] + np.arange(pairs)
    np.add.at(total.view(np.complex64).reshape(-1), places.reshape(-1), values.view(np.complex64).reshape(-1))


def expectations(weights: np.ndarray, bias: tuple[np.ndarray, np.ndarray], h: np.ndarray, sizes: np.ndarray, groups: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> None:
    """Add each row's outcomes, and those that the weights expect, to seen and expected (shaped like weights)."""
    for _, level, rows, outcome, p in factors(weights, bias, h, sizes, groups):
        flat = seen[level].reshape(-1)
        for r in rows:
            np.add.at(flat, r * p.shape[1] + outcome, np.float32(1))
            add_rows(expected[level], r, p)


def moved(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray, prior: float) -> np.ndarray:
    """Weights after an update: each follows the ratio of its counts, held back by the prior."""
    return np.clip(weights + RATE * np.log((seen + prior) / (expected + prior)), -MOST_WEIGHT, MOST_WEIGHT).astype(np.float32)


def _step(docs: DataFrame, groups: Groups, weights: np.ndarray, bias: tuple[np.ndarray, np.ndarray], prior: float) -> np.ndarray:
    """The next weights, from the texts of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((weights, bias, groups))
    schema = "block long, seen binary, expected binary"
    sums, found = to_arrow_schema(StructType.fromDDL(schema)), to_arrow_schema(StructType.fromDDL("block long, w binary"))
    blocked = lambda x: x.reshape(-1, BLOCK * x.shape[-1])

    def gradient(batches):
        enter(__name__)
        w, base, known = shared.value
        seen, expected = np.zeros_like(w), np.zeros_like(w)
        for b in (x for whole in batches for x in slices(whole)):
            h, sizes = tokens(column(b, "text"))
            expectations(w, base, h, sizes, known.of(h), seen, expected)
        seen, expected = blocked(seen), blocked(expected)
        some = np.flatnonzero(expected.any(axis=1))
        for at in range(0, len(some), 64):
            k = some[at : at + 64]
            yield pa.RecordBatch.from_pydict({"block": k, "seen": [x.tobytes() for x in seen[k]], "expected": [x.tobytes() for x in expected[k]]}, schema=sums)

    def update(batches):
        w = blocked(shared.value[0])
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, *x in zip(*(column(b, f) for f in sums.names), strict=True):
                x = np.stack([np.frombuffer(y, np.float32) for y in x])
                total[k] = total[k] + x if k in total else x.astype(np.float64)
        yield pa.RecordBatch.from_pydict({"block": list(total), "w": [moved(w[k], *x, prior).tobytes() for k, x in total.items()]}, schema=found)

    # a task sends sums as large as the weights at most: few tasks, but none of more than SPLITS splits
    cores = spark.sparkContext.defaultParallelism
    texts = docs.select("text")
    parts = texts.coalesce(max(cores, -(-texts.rdd.getNumPartitions() // SPLITS))).mapInArrow(gradient, schema)
    new = parts.repartition(cores, "block").mapInArrow(update, "block long, w binary").toPandas()
    out = weights.copy()
    for k, x in zip(new["block"], new["w"], strict=True):
        blocked(out)[k] = np.frombuffer(x, np.float32)
    shared.unpersist()
    return out


def train(docs: DataFrame, groups: Groups, bias: tuple[np.ndarray, np.ndarray], bits: int, steps: int = 4, prior: float = PRIOR) -> np.ndarray:
    """Weights (factor x row x outcome) after one update from each of so many parts of docs."""
    weights = np.zeros((2, 1 << bits, CLASSES), np.float32)
    for k in range(steps):
        weights = _step(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) == k), groups, weights, bias, prior)
    return weights


@dataclass(frozen=True)
class Model:
    """What scoring needs besides the count table; all of bounded size."""

    total: int
    distinct: int
    head: tuple[np.ndarray, np.ndarray]
    group_total: np.ndarray
    group_words: np.ndarray
    weights: np.ndarray
    bias: tuple[np.ndarray, np.ndarray]

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def within(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 P(word | group) for words with count c in group k."""
        return np.log10((c + 0.5) / (self.group_total[k] + 0.5 * (self.group_words[k] + 1)))

    @property
    def groups(self) -> Groups:
        return Groups(self.head[0][:OWN])


def fit(docs: DataFrame, counts: DataFrame, steps: int = 4) -> Model:
    """docs: the training documents (doc_id, text); counts: their word_counts(), materialised."""
    head = counts.orderBy(F.desc("c"), "h").limit(HEAD).toPandas()
    h, c = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    groups = Groups(h[:OWN])
    own = docs.sparkSession.createDataFrame([(k, i) for k, i in zip(groups.keys.view(np.int64).tolist(), groups.ids.tolist(), strict=True)], "h long, k int")
    rest = F.col("h").bitwiseAND(F.lit(CLASSES * GROUPS - OWN - 1).cast("long")).cast("int") + OWN
    by = counts.join(F.broadcast(own), "h", "left").groupBy(F.coalesce("k", rest).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
    total, words = np.zeros(CLASSES * GROUPS, np.int64), np.zeros(CLASSES * GROUPS, np.int64)
    for r in by.collect():
        total[r.k], words[r.k] = r.c, r.n
    part = total.reshape(CLASSES, GROUPS)
    share = lambda x: np.log((x + 0.5) / (x.sum(axis=-1, keepdims=True) + 0.5 * x.shape[-1])).astype(np.float32)
    bias = share(part.sum(axis=1)), share(part)
    bits = min(max((int(words.sum()) // WORDS_A_ROW).bit_length(), LEAST_BITS), MOST_BITS)
    return Model(int(total.sum()), int(words.sum()), (h, c), total, words, train(docs, groups, bias, bits, steps), bias)


_seen: dict[str, tuple[Shard, Groups]] = {}


def _opened(name: str, model: Model) -> tuple[Shard, Groups]:
    """Head table and groups, once in each worker."""
    if name not in _seen:
        _seen.clear()
        _seen[name] = (Shard(model.head[0], model.head[1]), model.groups)
    return _seen[name]


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, held, text): sizes and scores."""
    spark = docs.sparkSession
    shared, name = spark.sparkContext.broadcast(model), f"{id(model)}-{model.total}-{zlib.crc32(model.weights.tobytes())}"
    shards = 1 + model.distinct // SHARD_WORDS
    # held-out documents ask as well: a quarter more
    copies = 1 + (model.total - int(model.head[1].sum())) * 5 // 4 // (shards * ASKED)
    shard_of = lambda h: ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"batch long, shard int, doc_id {kind}, held boolean, idx int, n_tokens long, n_known long, base double, model double, at binary, h binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def first(batches):
        enter(__name__)
        m = shared.value
        head, groups = _opened(name, m)
        sent = 0
        for whole in batches:
            for b in slices(whole):
                batch = (TaskContext.get().partitionId() << 32) + sent
                sent += 1
                h, sizes = tokens(column(b, "text"))
                k = groups.of(h)
                model_log = log_probabilities(m.weights, m.bias, h, sizes, k)
                c = head.get(h, -1)
                found = c >= 0
                base = np.zeros(len(h))
                base[found] = m.base(c[found])
                model_log[found] += m.within(c[found], k[found])
                cut = np.cumsum(sizes) - sizes
                rows = b.num_rows
                add = lambda x: np.add.reduceat(x, cut)
                none = [None] * rows
                yield pa.RecordBatch.from_pydict({"batch": [batch] * rows, "shard": none, "doc_id": b.column(0), "held": b.column(1), "idx": np.arange(rows), "n_tokens": sizes, "n_known": add(found.astype(np.int64)), "base": add(base), "model": add(model_log), "at": none, "h": none}, schema=arrow)
                at = np.repeat(np.arange(rows, dtype=np.int32), sizes)[~found]
                rare = h[~found]
                own = shard_of(rare)
                order = np.argsort(own, kind="stable")
                edge = np.searchsorted(own[order], np.arange(shards + 1))
                full = [s for s in range(shards) if edge[s] < edge[s + 1]]
                none = [None] * len(full)
                part = lambda x: [x[order[edge[s] : edge[s + 1]]].tobytes() for s in full]
                if full:
                    yield pa.RecordBatch.from_pydict({"batch": [batch] * len(full), "shard": full} | {f: none for f in ("doc_id", "held", "idx", "n_tokens", "n_known", "base", "model")} | {"at": part(at), "h": part(rare)}, schema=arrow)

    done = materialize(docs.select("doc_id", "held", "text").mapInArrow(first, schema), "scores")

    def pack(b):
        h, c = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
        own = shard_of(h)
        order = np.argsort(own, kind="stable")
        edge = np.searchsorted(own[order], np.arange(shards + 1))
        full = [s for s in range(shards) if edge[s] < edge[s + 1]]
        part = lambda x: [x[order[edge[s] : edge[s + 1]]].tobytes() for s in full]
        return {"shard": full, "h": part(h), "c": part(c)}

    def look(sent: pa.Table, known: pa.Table) -> pa.Table:
        join = lambda f, kind: np.frombuffer(b"".join(known.column(f).to_pylist()), kind)
        table = Shard(join("h", np.uint64), join("c", np.int64))
        c, k = [], []
        for x in sent.column("h").to_pylist():
            h = np.frombuffer(x, np.uint64)
            c.append(table.get(h, 0).astype(np.int64).tobytes())
            k.append(shared_group(h).tobytes())
        return pa.table({"batch": sent.column("batch"), "at": sent.column("at"), "c": pa.array(c, pa.binary()), "k": pa.array(k, pa.binary())})

    # words of the head never come here, so no shard holds a hot word
    packed = map_arrow(counts.select("h", "c"), pack, "shard int, h binary, c binary", WHOLE)
    packed = packed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select("shard", "copy", "h", "c")
    asked = done.where("shard is not null").select("shard", F.pmod(F.xxhash64("batch"), F.lit(copies)).cast("int").alias("copy"), "batch", "at", "h")
    answers = asked.groupBy("shard", "copy").cogroup(packed.groupBy("shard", "copy")).applyInArrow(look, "batch long, at binary, c binary, k binary")

    def total(rows: pa.Table, got: pa.Table) -> pa.Table:
        m, n = shared.value, rows.num_rows
        if not n:
            return rows.select(["doc_id", "held", "n_tokens", "n_known", "base", "model"])
        base, log, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for at, c, k in zip(*(got.column(f).to_pylist() for f in ("at", "c", "k")), strict=True):
            at, c, k = np.frombuffer(at, np.int32), np.frombuffer(c, np.int64), np.frombuffer(k, np.int32)
            base += np.bincount(at, m.base(c), n)
            log += np.bincount(at, m.within(c, k), n)
            known += np.bincount(at[c > 0], minlength=n)
        idx = rows.column("idx").to_numpy()
        sum_ = lambda f, x: rows.column(f).to_numpy() + x[idx]
        return pa.table({"doc_id": rows.column("doc_id"), "held": rows.column("held"), "n_tokens": rows.column("n_tokens"), "n_known": sum_("n_known", known), "base": sum_("base", base), "model": sum_("model", log)})

    rows = done.where("shard is null").select("batch", "doc_id", "held", "idx", "n_tokens", "n_known", "base", "model")
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(total, f"doc_id {kind}, held boolean, n_tokens long, n_known long, base double, model double")


def score_documents(docs: DataFrame, steps: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), F.col("text").cast("binary").alias("text"))
    own = docs.where("not held")
    counts = materialize(word_counts(own), "counts")
    model = fit(own, counts, steps)
    found = score(docs, counts, model)
    return found.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))
