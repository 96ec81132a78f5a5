"""The assistant's fusion network: encoded sequences and tabular features meet in a transformer.

Rows stay distributed. In each epoch every part of the rows takes its own steps in numpy
inside a task, from the same weights; the parts' weights are averaged and stored in the
shared folder. Neither rows nor weights pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.sequences import ASSIST, Modality, _tensor
from heddle.operators.splits import dev_holdout
from heddle.sources.store import remove, scratch, stored


@dataclass(frozen=True)
class Network:
    """The reference's sizes."""

    token: int = 160
    heads: int = 4
    layers: int = 2
    branch: int = 96
    tabular: int = 256
    kernel: int = 5
    dropout: float = 0.15
    modality_dropout: float = 0.05
    batch: int = 128
    epochs: int = 28
    patience: int = 6
    rate: float = 9e-4
    decay: float = 2e-4
    clip: float = 1.0
    share: float = 0.1
    seed: int = 7


@dataclass(frozen=True)
class Layout:
    """Times and channels of each modality, and the number of tabular features: how a packed row is cut."""

    modalities: tuple[tuple[int, int], ...]
    tabular: int

    @property
    def width(self) -> int:
        return sum(t * c + t for t, c in self.modalities) + self.tabular

    def cut(self, x: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """[(values: rows x times x channels, mask: rows x times x 1)], tabular."""
        at, out = 0, []
        for t, c in self.modalities:
            out.append((x[:, at : at + t * c].reshape(-1, t, c), x[:, at + t * c : at + t * c + t, None]))
            at += t * c + t
        return out, x[:, at:]

    def channels(self) -> np.ndarray:
        """The channel each place belongs to, for means and deviations; -1 in masks, which stay as they are."""
        out, k = [], 0
        for t, c in self.modalities:
            out += [np.tile(np.arange(k, k + c), t), np.full(t, -1)]
            k += c
        return np.concatenate([*out, np.arange(k, k + self.tabular)])


def layout(df: DataFrame, modalities: tuple[Modality, ...] = ASSIST, tabular: str = "features") -> Layout | None:
    """The layout of the first row's sequences; None without rows."""
    wide = lambda m: F.size(F.col(m.values)[0]) if "array<array" in df.schema[m.values].dataType.simpleString() else F.lit(1)
    r = df.select(*[x for m in modalities for x in (F.size(m.values), wide(m))], F.size(tabular)).first()
    return None if r is None else Layout(tuple(zip(r[:-1:2], r[1:-1:2], strict=True)), r[-1])


def packed(df: DataFrame, modalities: tuple[Modality, ...] = ASSIST, tabular: str = "features") -> DataFrame:
    """row_id, label, features: each row's sequences, masks (averaged over their channels) and tabular features in one array."""
    kept = ["row_id", "label"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                at = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
                blocks = [x.reshape(b.num_rows, -1) for m in modalities for x in (_tensor(at(m.values), m.values), _tensor(at(m.mask), m.mask).mean(axis=2))]
                x = np.concatenate([*blocks, _tensor(at(tabular), tabular)[:, :, 0]], axis=1)
                offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*map(at, kept), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], [*kept, "features"])

    columns = [*kept, *[c for m in modalities for c in (m.values, m.mask)], tabular]
    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*columns).mapInArrow(run, f"{types}, features array<double>")


# the network: values and, for each operation, how gradients go back


class Node:
    __slots__ = ("grad", "value")

    def __init__(self, value: np.ndarray):
        self.value, self.grad = value, None

    def add(self, g: np.ndarray) -> None:
        self.grad = g if self.grad is None else self.grad + g


def _erf(z: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, right to 1.5e-7; in place, since it takes a good part of a step."""
    e = np.abs(z)
    t = e * 0.3275911
    t += 1
    np.reciprocal(t, out=t)
    y = t * 1.061405429
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        y += c
        y *= t
    e *= e
    np.negative(e, out=e)
    y *= np.exp(e, out=e)
    np.subtract(1, y, out=y)
    return np.copysign(y, z, out=y)


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def _fit_shape(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which its input was repeated."""
    g = g.sum(axis=tuple(range(g.ndim - len(shape)))) if g.ndim > len(shape) else g
    repeated = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] > 1)
    return g.sum(axis=repeated, keepdims=True) if repeated else g


class Tape:
    """Operations on nodes, and their way back; without a generator nothing is dropped out."""

    def __init__(self, rng: np.random.Generator | None = None):
        self.rng, self.steps = rng, []

    def out(self, value: np.ndarray, back: Callable[[np.ndarray], None]) -> Node:
        y = Node(value)
        self.steps.append((y, back))
        return y

    def backward(self) -> None:
        for y, back in reversed(self.steps):
            if y.grad is not None:
                back(y.grad)

    def kept(self, shape: tuple[int, ...], p: float):
        return 1.0 if self.rng is None or p <= 0 else (self.rng.random(shape, np.float32) >= p).astype(np.float32) / np.float32(1 - p)

    def linear(self, x: Node, w: Node, b: Node) -> Node:
        rows = x.value.reshape(-1, x.value.shape[-1])  # one product of two matrices

        def back(g):
            flat = g.reshape(-1, g.shape[-1])
            w.add(flat.T @ rows)
            b.add(flat.sum(axis=0))
            x.add((flat @ w.value).reshape(x.value.shape))

        return self.out((rows @ w.value.T + b.value).reshape(*x.value.shape[:-1], -1), back)

    def windows(self, x: Node, k: int) -> Node:
        """rows x times x channels -> rows x times x (k channels): each time with its neighbours, zero beyond the ends."""
        n, t, c = x.value.shape
        wide = np.pad(x.value, ((0, 0), (k // 2, k // 2), (0, 0)))

        def back(g):
            d = np.zeros((n, t + 2 * (k // 2), c), g.dtype)
            for i in range(k):
                d[:, i : i + t] += g[:, :, i * c : (i + 1) * c]
            x.add(d[:, k // 2 : k // 2 + t])

        return self.out(np.concatenate([wide[:, i : i + t] for i in range(k)], axis=2), back)

    def gelu(self, x: Node) -> Node:
        v = x.value
        share = 0.5 * (1 + _erf(v * v.dtype.type(0.5**0.5)))
        return self.out(v * share, lambda g: x.add(g * (share + v * np.exp(-0.5 * v * v) * v.dtype.type((2 * np.pi) ** -0.5))))

    def norm(self, x: Node, scale: Node, shift: Node) -> Node:
        away = x.value - x.value.mean(axis=-1, keepdims=True)
        inverse = 1 / np.sqrt((away * away).mean(axis=-1, keepdims=True) + 1e-5)
        y = away * inverse

        def back(g):
            scale.add(_fit_shape(g * y, scale.value.shape))
            shift.add(_fit_shape(g, shift.value.shape))
            d = g * scale.value
            x.add(inverse * (d - d.mean(axis=-1, keepdims=True) - y * (d * y).mean(axis=-1, keepdims=True)))

        return self.out(y * scale.value + shift.value, back)

    def times(self, x: Node, factor) -> Node:
        return self.out(x.value * factor, lambda g: x.add(_fit_shape(g * factor, x.value.shape)))

    def dropout(self, x: Node, p: float) -> Node:
        return x if self.rng is None or p <= 0 else self.times(x, self.kept(x.value.shape, p))

    def add(self, *xs: Node) -> Node:
        def back(g):
            for x in xs:
                x.add(_fit_shape(g, x.value.shape))

        return self.out(sum(x.value for x in xs[1:]) + xs[0].value, back)

    def pooled(self, x: Node, weights: np.ndarray) -> Node:
        return self.out((x.value * weights).sum(axis=1), lambda g: x.add(g[:, None, :] * weights))

    def stacked(self, *xs: Node) -> Node:
        """rows x width each -> rows x tokens x width."""

        def back(g):
            for i, x in enumerate(xs):
                x.add(g[:, i])

        return self.out(np.stack([x.value for x in xs], axis=1), back)

    def token(self, x: Node, i) -> Node:
        def back(g):
            d = np.zeros_like(x.value)
            d[:, i] = g.reshape(d[:, i].shape)
            x.add(d)

        return self.out(x.value[:, i].reshape(len(x.value), -1) if isinstance(i, slice) else x.value[:, i], back)

    def attention(self, x: Node, heads: int, p: float) -> Node:
        """rows x tokens x (3 width: queries, keys, values) -> rows x tokens x width."""
        n, s, w = x.value.shape
        d = w // 3 // heads
        q, k, v = x.value.reshape(n, s, 3, heads, d).transpose(2, 0, 3, 1, 4)
        a = _softmax(q @ k.swapaxes(-1, -2) * np.float32(d**-0.5), -1)
        kept = self.kept(a.shape, p)

        def back(g):
            g = g.reshape(n, s, heads, d).transpose(0, 2, 1, 3)
            da = g @ v.swapaxes(-1, -2) * kept
            ds = a * (da - (da * a).sum(axis=-1, keepdims=True)) * np.float32(d**-0.5)
            x.add(np.stack([ds @ k, ds.swapaxes(-1, -2) @ q, (a * kept).swapaxes(-1, -2) @ g]).transpose(1, 3, 0, 2, 4).reshape(n, s, w))

        return self.out(((a * kept) @ v).transpose(0, 2, 1, 3).reshape(n, s, w // 3), back)

    def gate(self, logits: Node, x: Node, open_: np.ndarray) -> tuple[Node, Node]:
        """Tokens of x added up by the softmax of their logits where open, and these weights (rows x tokens x 1)."""
        w = _softmax(np.where(open_, logits.value, np.float32(-1e4)), 1)

        def back(g):
            logits.add(np.where(open_, w * (g - (g * w).sum(axis=1, keepdims=True)), np.float32(0)))

        weights = self.out(w, back)

        def spread(g):
            x.add(g[:, None, :] * w)
            weights.add((g[:, None, :] * x.value).sum(axis=2, keepdims=True))

        return self.out((x.value * w).sum(axis=1), spread), weights


def shapes(net: Network, of: Layout, classes: int) -> dict[str, tuple[tuple[int, ...], str]]:
    """Each parameter's shape and how it begins: uniform by its inputs, glorot, normal, one or zero."""
    d, out = net.token, {}

    def linear(name, i, o, kind="uniform"):
        out[f"{name}.w"], out[f"{name}.b"] = ((o, i), kind), ((o,), f"uniform {i}" if kind == "uniform" else "zero")

    def norm(name, n):
        out[f"{name}.scale"], out[f"{name}.shift"] = ((n,), "one"), ((n,), "zero")

    for m, (_, c) in enumerate(of.modalities):
        linear(f"near{m}", c * net.kernel, net.branch)
        linear(f"far{m}", net.branch * net.kernel, net.branch)
        norm(f"branch{m}", net.branch)
        linear(f"project{m}", net.branch, d)
        norm(f"projected{m}", d)
    linear("tabular", of.tabular, net.tabular)
    norm("tabular", net.tabular)
    linear("tabular2", net.tabular, d)
    norm("tabular2", d)
    linear("gate", d, d)
    linear("gate2", d, 1)
    out["places"] = ((len(of.modalities) + 3, d), "normal")
    for name in ("available", "missing", "first"):
        out[name] = ((1, d), "normal")
    for k in range(net.layers):
        norm(f"before{k}", d)
        linear(f"attend{k}", d, 3 * d, "glorot")
        linear(f"attended{k}", d, d)
        out[f"attended{k}.b"] = ((d,), "zero")
        norm(f"between{k}", d)
        linear(f"wide{k}", d, 4 * d)
        linear(f"narrow{k}", 4 * d, d)
    norm("head", 3 * d)
    linear("head", 3 * d, 2 * d)
    linear("head2", 2 * d, classes)
    linear("tabular_skip", d, classes)
    linear("sequence_skip", d, classes)
    return out


def begin(spec: dict, seed: int) -> np.ndarray:
    rng, out = np.random.default_rng(seed), []
    for shape, kind in spec.values():
        if kind.startswith("uniform"):
            bound = (int(kind[8:]) if kind[8:] else shape[1]) ** -0.5
            x = rng.uniform(-bound, bound, shape)
        elif kind == "glorot":
            x = rng.uniform(-1, 1, shape) * (6 / sum(shape)) ** 0.5
        else:
            x = rng.normal(0, 0.02, shape) if kind == "normal" else np.full(shape, float(kind == "one"))
        out.append(x.ravel())
    return np.concatenate(out).astype(np.float32)


def named(flat: np.ndarray, spec: dict) -> dict[str, Node]:
    out, at = {}, 0
    for name, (shape, _) in spec.items():
        n = int(np.prod(shape))
        out[name] = Node(flat[at : at + n].reshape(shape))
        at += n
    return out


def forward(p: dict[str, Node], net: Network, of: Layout, x: np.ndarray, tape: Tape) -> tuple[Node, Node]:
    """Logits (rows x classes) and the gate's weights of normalised packed rows."""
    t, drop = tape, net.dropout
    linear = lambda h, name: t.linear(h, p[f"{name}.w"], p[f"{name}.b"])
    norm = lambda h, name: t.norm(h, p[f"{name}.scale"], p[f"{name}.shift"])
    place = lambda i: t.out(p["places"].value[i : i + 1], lambda g: p["places"].add(np.eye(len(p["places"].value), dtype=g.dtype)[:, i : i + 1] * g))
    sequences, tabular = of.cut(x)
    tokens, there = [], []
    for m, (values, mask) in enumerate(sequences):
        h = t.gelu(linear(t.windows(Node(values * mask), net.kernel), f"near{m}"))
        h = t.dropout(t.gelu(linear(t.windows(h, net.kernel), f"far{m}")), drop)
        h = norm(t.pooled(h, mask / np.maximum(mask.sum(axis=1, keepdims=True), 1)), f"branch{m}")
        tokens.append(t.add(t.gelu(norm(linear(h, f"project{m}"), f"projected{m}")), place(m + 3)))
        there.append(mask.max(axis=1))
    h = t.dropout(t.gelu(norm(linear(Node(tabular), "tabular"), "tabular")), drop)
    told = t.add(t.gelu(norm(linear(h, "tabular2"), "tabular2")), place(1))
    available = np.clip(np.stack(there, axis=1), 0, 1)
    if t.rng is not None and net.modality_dropout > 0:
        available = available * (t.rng.random(available.shape, np.float32) > net.modality_dropout)
    all_ = t.add(t.stacked(*tokens), t.times(p["available"], available), t.times(p["missing"], 1 - available))
    pooled, weights = t.gate(linear(t.gelu(linear(all_, "gate")), "gate2"), all_, available > 0)
    pooled = t.add(pooled, place(2))
    first = t.add(p["first"], place(0))
    rows = t.out(np.repeat(first.value, len(x), axis=0), lambda g: first.add(g.sum(axis=0, keepdims=True)))
    h = t.stacked(rows, told, pooled, *[t.token(all_, m) for m in range(len(tokens))])
    for k in range(net.layers):
        a = t.attention(linear(norm(h, f"before{k}"), f"attend{k}"), net.heads, drop)
        h = t.add(h, t.dropout(linear(a, f"attended{k}"), drop))
        w = t.dropout(t.gelu(linear(norm(h, f"between{k}"), f"wide{k}")), drop)
        h = t.add(h, t.dropout(linear(w, f"narrow{k}"), drop))
    h = t.dropout(t.gelu(linear(norm(t.token(h, slice(0, 3)), "head"), "head")), drop)
    skips = t.times(linear(told, "tabular_skip"), np.float32(0.35)), t.times(linear(pooled, "sequence_skip"), np.float32(0.2))
    return t.add(linear(h, "head2"), *skips), weights


def losses(logits: np.ndarray, label: np.ndarray, class_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's weighted loss, its weight, and the vector."""
    q = _softmax(logits, 1)
    w = class_weights[label]
    return -w * np.log(np.maximum(q[np.arange(len(label)), label], 1e-30)), w, q


def gradient(flat: np.ndarray, spec: dict, net: Network, of: Layout, x: np.ndarray, label: np.ndarray, class_weights: np.ndarray, rng) -> tuple[float, np.ndarray]:
    """The loss of a batch with the gate's small penalty, and its gradient by all parameters."""
    p, tape = named(flat, spec), Tape(rng)
    logits, gate = forward(p, net, of, x, tape)
    each, w, q = losses(logits.value, label, class_weights)
    q[np.arange(len(label)), label] -= 1
    logits.add(q * (w / w.sum())[:, None])
    gate.add(gate.value * np.float32(2e-3 / gate.value.size))
    tape.backward()
    grads = [(np.zeros_like(n.value) if n.grad is None else n.grad).ravel() for n in p.values()]
    return float(each.sum() / w.sum() + 1e-3 * np.square(gate.value).mean()), np.concatenate(grads)


# training

#: Training rows of one part, and the most parts of a fit: weights of more parts are averaged over fewer steps each.
PART_ROWS, MOST_PARTS = 1_024, 32

#: Numbers of a block of weights.
BLOCK = 1 << 16

BLOCKS = "chunk int, part int, rows long, block binary"


@dataclass
class State:
    """Weights, the two moments of their gradients and the steps taken, in one vector."""

    all: np.ndarray
    n: int

    def step(self, g: np.ndarray, net: Network) -> None:
        w, m, v = self.all[: self.n], self.all[self.n : 2 * self.n], self.all[2 * self.n : 3 * self.n]
        g *= min(1.0, net.clip / (float(np.sqrt(np.square(g, dtype=np.float64).sum())) + 1e-6)) if net.clip > 0 else 1.0
        self.all[-1] += 1
        t = float(self.all[-1])
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.001) * (g * g - v)
        w *= np.float32(1 - net.rate * net.decay)
        w -= np.float32(net.rate / (1 - 0.9**t)) * m / (np.sqrt(v) * np.float32((1 - 0.999**t) ** -0.5) + np.float32(1e-8))


def _dealt(rows: DataFrame, state: DataFrame | None, parts: int, key: list) -> DataFrame:
    """part, kind, at, block and the rows' columns: to each part the state's blocks, then its rows (kind, 1 at least) in a random order."""
    h = F.xxhash64(*key)
    out = rows.withColumn("part", F.pmod(h, F.lit(parts)).cast("int")).withColumn("at", F.xxhash64(h, F.lit(1)))
    if state is not None:
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        out = out.unionByName(state.select(every, F.lit(0).alias("kind"), F.col("chunk").cast("long").alias("at"), "block"), allowMissingColumns=True)
    return out.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "at")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """part, kind and the rows of one batch that share them."""
    for b in batches:
        if b.num_rows:
            part, kind = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("part", "kind"))
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *edges], [*edges, b.num_rows], strict=True):
                yield int(part[i]), int(kind[i]), b.slice(i, j - i)


def _of(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _matrix(b: pa.RecordBatch, norms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (_of(b, "x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float32) - norms[0]) / norms[1]


def _vector(blocks: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.float32) for x in blocks])


def _norms(rows: DataFrame, of: Layout) -> tuple[np.ndarray, np.ndarray]:
    """What each place of a packed row is lowered and divided by: its channel's mean and deviation over rows and times."""
    channel, n = of.channels(), of.width

    def run(batches):
        count, mean, square = 0, np.zeros(n), np.zeros(n)
        for b in batches:
            if b.num_rows:
                x = _of(b, "x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                away = x.mean(axis=0) - mean
                total = count + len(x)
                square += np.square(x - x.mean(axis=0)).sum(axis=0) + away * away * (count * len(x) / total)
                mean += away * (len(x) / total)
                count = total
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, count), pa.int64()), pa.array(mean), pa.array(square)], ["k", "n", "mean", "square"])

    names = F.create_map(*[F.lit(int(x)) for k in enumerate(channel) for x in k])[F.col("k")]
    own = rows.select("x").mapInArrow(run, "k int, n long, mean double, square double").withColumn("c", names).where("c >= 0")
    means = own.groupBy("c").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))
    sums = own.join(F.broadcast(means), "c").groupBy("c", "total", "m").agg(F.sum(F.col("square") + F.col("n") * (F.col("mean") - F.col("m")) ** 2).alias("s"))
    found = {r.c: (r.m, (r.s / r.total) ** 0.5) for r in sums.collect()}
    low, scale = np.zeros(n, np.float32), np.ones(n, np.float32)
    for k, c in enumerate(channel):
        if c >= 0:
            low[k], scale[k] = found[c][0], found[c][1] if found[c][1] >= 1e-6 else 1.0
    return low, scale


def _epoch(rows: DataFrame, state: DataFrame | None, parts: int, epoch: int, net: Network, of: Layout, spec: dict, class_weights: np.ndarray, norms) -> DataFrame:
    """chunk, block: the average of the parts' weights after their steps over the rows of kind 2.

    Chunk -1 holds the sums of the given weights' losses on the rows of kind 1.
    """
    size = sum(int(np.prod(s)) for s, _ in spec.values())

    def steps(batches):
        at, blocks, own, rng, left, seen, sums = None, [], None, None, None, 0, np.zeros(4)

        def start(part):
            nonlocal at, blocks, own, rng, left, seen, sums
            at, blocks, own, left, seen, sums = part, [], None, None, 0, np.zeros(4)
            rng = np.random.default_rng([net.seed, epoch, part])

        def ready():
            nonlocal own
            if own is None:
                own = State(_vector(blocks).copy() if blocks else np.concatenate([begin(spec, net.seed), np.zeros(2 * size + 1, np.float32)]), size)

        def learn(x, label):
            loss, g = gradient(own.all[:size], spec, net, of, x, label, class_weights, rng)
            if np.isfinite(loss):
                own.step(g, net)

        def finish():
            out = []
            if left is not None and len(left[1]):
                learn(*left)
            if seen:
                out += [(k // BLOCK, at, seen, own.all[k : k + BLOCK].tobytes()) for k in range(0, len(own.all), BLOCK)]
            if sums[3]:
                out.append((-1, at, int(sums[3]), sums.tobytes()))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "rows", "block"])

        for part, kind, b in _runs(batches):
            if part != at:
                if at is not None:
                    yield from finish()
                start(part)
            if kind == 0:
                blocks += _of(b, "block").to_pylist()
                continue
            ready()
            x, label = _matrix(b, norms), _of(b, "label").to_numpy().astype(int)
            if kind == 1:
                for k in range(0, len(x), net.batch):
                    logits, gate = forward(named(own.all[:size], spec), net, of, x[k : k + net.batch], Tape())
                    each, w, _ = losses(logits.value, label[k : k + net.batch], class_weights)
                    sums += [each.sum(), w.sum(), 1e-3 * np.square(gate.value).mean() * len(each), len(each)]
                continue
            seen += len(x)
            if left is not None:
                x, label = np.concatenate([left[0], x]), np.concatenate([left[1], label])
            whole = len(x) // net.batch * net.batch
            for k in range(0, whole, net.batch):
                learn(x[k : k + net.batch], label[k : k + net.batch])
            left = x[whole:], label[whole:]
        if at is not None:
            yield from finish()

    def average(table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: r["part"])
        if own[0]["chunk"] < 0:
            block = np.sum([np.frombuffer(r["block"]) for r in own], axis=0)
        else:
            n = sum(r["rows"] for r in own)
            block = sum(np.frombuffer(r["block"], np.float32).astype(np.float64) * (r["rows"] / n) for r in own).astype(np.float32)
        return pa.table({"chunk": pa.array([own[0]["chunk"]], pa.int32()), "block": pa.array([block.tobytes()], pa.binary())})

    dealt = _dealt(rows, state, parts, [F.col("row_id"), F.lit(net.seed), F.lit(epoch)])
    return dealt.mapInArrow(steps, BLOCKS).groupBy("chunk").applyInArrow(average, "chunk int, block binary")


def fit(train: DataFrame, rest: DataFrame, classes: int, labels: list[int], of: Layout, net: Network) -> DataFrame:
    """split_id, row_id, role, p of the rest by a network fitted on the training rows (row_id, label, x: packed).

    A share of them, from 256 rows on, tells when to stop: the weights with the least loss
    there are kept, and training ends where `patience` epochs brought none. Without such a
    share there are so many epochs. Weights of classes come from the rows that train.
    """
    spark = train.sparkSession
    place = F.create_map(*[F.lit(int(x)) for k in enumerate(labels) for x in reversed(k)])
    roles = dev_holdout(train.select("row_id", "label"), net.share, net.seed)
    kind = F.when(F.col("role") == "dev", 1).otherwise(2)
    rows = stored(train.select("row_id", "label", "x").join(roles, "row_id").select("row_id", kind.alias("kind"), place[F.col("label")].cast("int").alias("label"), "x"), "fusion")
    counts = {(r.kind, r.label): r.n for r in rows.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = np.array([counts.get((2, k), 0) for k in range(len(labels))])
    n, dev = int(per.sum()), any(k == 1 for k, _ in counts)
    class_weights = (n / (len(labels) * np.maximum(per, 1))).astype(np.float32)
    norms, spec = _norms(rows.where("kind = 2"), of), shapes(net, of, len(labels))
    parts = min(MOST_PARTS, -(-n // PART_ROWS))
    epochs = net.epochs if dev else min(net.epochs, net.patience)
    state = best = None
    least, left = np.inf, net.patience
    for e in range(epochs + dev):
        given = rows.where("kind = 2") if state is None else rows if e < epochs else rows.where("kind = 1")
        at = scratch(spark, "weights")
        blocks = None if state is None else spark.read.schema("chunk int, block binary").parquet(state).where("chunk >= 0")
        _epoch(given, blocks, parts, e, net, of, spec, class_weights, norms).write.parquet(at)
        if state is not None and dev:
            told = np.frombuffer(spark.read.schema("chunk int, block binary").parquet(at).where("chunk < 0").first().block)
            loss = told[0] / told[1] + told[2] / told[3]
            old = state
            if loss + 1e-6 < least:
                old, best, least, left = best, state, loss, net.patience
            else:
                left -= 1
            ended = left <= 0 or e == epochs
            for gone in [at] * ended + [old] * (old is not None and not (ended and best is None)):
                remove(spark, gone)
            if ended:
                break
        elif state is not None:
            remove(spark, state)
        state = at
    return _scored(rest, spark.read.schema("chunk int, block binary").parquet(best or state), classes, labels, of, net, spec, norms)


def _scored(rest: DataFrame, state: DataFrame, classes: int, labels: list[int], of: Layout, net: Network, spec: dict, norms) -> DataFrame:
    size = sum(int(np.prod(s)) for s, _ in spec.values())
    kept = ["split_id", "row_id", "role"]

    def run(batches):
        at, blocks, p = None, [], None
        for part, kind, b in _runs(batches):
            if part != at:
                at, blocks, p = part, [], None
            if kind == 0:
                blocks += _of(b, "block").to_pylist()
                continue
            p = p or named(_vector(blocks)[:size], spec)
            x = _matrix(b, norms)
            out = np.zeros((len(x), classes))
            for k in range(0, len(x), net.batch):
                logits = forward(p, net, of, x[k : k + net.batch], Tape())[0].value
                out[k : k + net.batch, labels] = _softmax(np.nan_to_num(logits.astype(np.float64), nan=0.0, posinf=20.0, neginf=-20.0), 1)
            offsets = pa.array(np.arange(len(x) + 1) * classes, pa.int32())
            yield pa.RecordBatch.from_arrays([*[_of(b, c) for c in kept], pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], [*kept, "p"])

    own = state.where(F.col("chunk").between(0, (size - 1) // BLOCK))
    rows = rest.select(*kept, F.lit(1).alias("kind"), "x")
    parts = max(1, -(-rest.count() // PART_ROWS))
    types = ", ".join(f"{c} {rest.schema[c].dataType.simpleString()}" for c in kept)
    return _dealt(rows, own, parts, [F.col("row_id"), F.lit(net.seed)]).mapInArrow(run, f"{types}, p array<double>")
