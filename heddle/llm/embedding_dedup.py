"""Near-duplicate embeddings by PCA-ordered, tiled comparison.

Vectors are turned into the axes of their second moments, largest first, which
leaves all products as they are. Tiles of vectors are compared in pairs: the
product over the leading axes comes first, and what the rest could add at most is
the product of the two suffix norms. A pair whose sum stays below the threshold
is dropped; the others take the next axes, and the last few are decided by the
cosine of the given vectors in double precision. Pairs of tiles whose boxes lie
too far apart aren't compared at all.

Tiles are cut from vectors in the order of their first axis. Consecutive tiles form
a block, and blocks meet in pairs (those whose boxes lie near enough), so a tile is
sent once for each block, not for each tile, that it is compared with.

Equal vectors are one class with a weight, so a vector that many rows share is
compared once. Tile pairs give link counts and a spanning forest, never a list of
all links of a cluster. Vectors of different lengths link with nothing of another
length.

Defined cases: vectors that are null, zero, empty or hold null or non-finite
components have no links and are their own component. component_id is the
smallest vec_id that isn't null; kept is false for rows without an id. Ids keep their
type, which may be any that has an order (strings too). Only the id and the vector are
read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import column, map_arrow, materialize
from heddle.llm.components import connected_components

#: Vectors in a tile.
TILE = 4096
#: Tiles of a block: at most so many, of so many bytes together (but at least one).
SIDE, BLOCK_BYTES = 4, 64 << 20
#: Axes taken at each step; the rest follow in one.
STEPS = (16, 16)
#: Leading axes of the boxes by which pairs of tiles are skipped.
BOX = 8


def _vector(x: list | None) -> np.ndarray | None:
    if not x or any(v is None for v in x):
        return None
    v = np.asarray(x, np.float64) + 0.0
    return v if np.isfinite(v).all() and v.any() else None


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _stack(blobs: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, d)


def _moments(classes: DataFrame, d: int) -> np.ndarray:
    """Second moments of the unit vectors; only d x d sums reach the driver."""

    def run(batches):
        m = np.zeros((d, d))
        for b in batches:
            u = _unit(_stack(column(b, "v"), d))
            m += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(m.ravel())], ["k", "x"])

    out = np.zeros(d * d)
    for r in classes.select("v").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r.k] = r.x
    return out.reshape(d, d)


def axes(moments: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, largest moment first."""
    _, v = np.linalg.eigh(moments)
    return v[:, ::-1]


def compare(x: np.ndarray, y: np.ndarray, rotation: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i of x, j of y) of pairs with a cosine of at least threshold; same: x is y, i < j only."""
    d, slack = x.shape[1], 1e-5
    ux, uy = _unit(x), _unit(y)
    px, py = ux @ rotation, uy @ rotation
    edges = np.minimum(np.cumsum([0, *STEPS]), d)
    suffix = lambda p, k: np.sqrt(np.maximum((p[:, k:] ** 2).sum(axis=1), 0))
    first = edges[1]
    ax, ay = px[:, :first].astype(np.float32), py[:, :first].astype(np.float32)
    sx, sy = suffix(px, first).astype(np.float32), suffix(py, first).astype(np.float32)
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(x), 512):
        bound = ax[at : at + 512] @ ay.T
        bound += np.outer(sx[at : at + 512], sy)
        flat = np.flatnonzero(bound >= threshold - slack)
        i, j = flat // len(y) + at, flat % len(y)
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 200_000):
            a, b = i[part : part + 200_000], j[part : part + 200_000]
            for lo, hi in zip(edges[1:-1], edges[2:], strict=True):
                if not len(a):
                    break
                reach = np.einsum("ij,ij->i", px[a, :hi], py[b, :hi]) + suffix(px, hi)[a] * suffix(py, hi)[b]
                a, b = a[reach >= threshold - slack], b[reach >= threshold - slack]
            cosine = np.einsum("ij,ij->i", ux[a], uy[b])
            near = np.abs(cosine - threshold) < 1e-9
            if near.any():  # so close to the threshold the given vectors decide
                p, q = x[a[near]], y[b[near]]
                cosine[near] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
            out_i.append(a[cosine >= threshold])
            out_j.append(b[cosine >= threshold])
    return np.concatenate(out_i), np.concatenate(out_j)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each of n nodes' component under the edges (i, j)."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    return label


def _box_gap() -> Column:
    """Square of the least distance between the boxes of two blocks."""
    gaps = F.zip_with(F.zip_with("hi", "olo", lambda h, o: o - h), F.zip_with("lo", "ohi", lambda l, o: l - o), lambda a, b: F.greatest(a, b))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + F.when(g > 0, g * g).otherwise(0.0))


def _links(classes: DataFrame, d: int, threshold: float) -> DataFrame:
    """node, links (weight of linked classes), root: partial results of all tile pairs."""
    rotation = axes(_moments(classes, d))
    lead, box, near = rotation[:, 0], min(BOX, d), 2 - 2 * threshold + 1e-6

    def along(b):
        return {"node": b.column(0), "weight": b.column(1), "v": b.column(2), "first": _unit(_stack(column(b, "v"), d)) @ lead}

    def tile(t: pa.Table) -> pa.RecordBatch:
        blob = b"".join(t.column("v").to_pylist())
        p = (_unit(_stack([blob], d)) @ rotation)[:, :box]
        whole = lambda c: t.column(c).to_numpy().astype(np.int64).tobytes()
        return pa.RecordBatch.from_pydict({"lo": pa.array([p.min(axis=0).tolist()]), "hi": pa.array([p.max(axis=0).tolist()]), "node": pa.array([whole("node")], pa.binary()), "weight": pa.array([whole("weight")], pa.binary()), "v": pa.array([blob], pa.binary())})

    def cut(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held) >= TILE:
                yield tile(held.slice(0, TILE))
                held = held.slice(TILE)
        if held is not None and len(held):
            yield tile(held)

    ranged = map_arrow(classes.select("node", "weight", "v"), along, "node long, weight long, v binary, first double")
    ordered = ranged.repartitionByRange("first", "node").sortWithinPartitions("first", "node").select("node", "weight", "v")
    packed = ordered.mapInArrow(cut, "lo array<double>, hi array<double>, node binary, weight binary, v binary")
    tiles = materialize(packed.withColumn("id", F.monotonically_increasing_id()), "tiles")
    side = max(1, min(SIDE, BLOCK_BYTES // (TILE * d * 8)))
    numbered = tiles.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("i"))
    numbered = materialize(numbered.withColumn("block", F.floor(F.col("i") / side)), "numbers")
    edge = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(box)]).alias(c)
    blocks = tiles.select("id", "lo", "hi").join(numbered, "id").groupBy("block").agg(edge(F.min, "lo"), edge(F.max, "hi"))
    last = F.lit((tiles.count() - 1) // side)
    other = blocks.select(F.col("block").alias("b"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    pairs = blocks.withColumnRenamed("block", "a").withColumn("b", F.explode(F.sequence("a", last))).join(other, "b").where(_box_gap() <= near)
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("block"))

    def meet(t: pa.Table) -> pa.Table:
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        rows = sorted(t.drop_columns(["a", "b"]).to_pylist(), key=lambda r: r["i"])
        parts = [(r["block"], np.frombuffer(r["node"], np.int64), np.frombuffer(r["weight"], np.int64), _stack([r["v"]], d), np.array(r["lo"]), np.array(r["hi"])) for r in rows]
        out = []
        for k, x in enumerate(parts):
            for m in range(k, len(parts)):
                y = parts[m]
                gap = np.maximum(np.maximum(y[4] - x[5], x[4] - y[5]), 0)
                if (x[0], y[0]) != (a, b) or gap @ gap > near:
                    continue
                i, j = compare(x[3], y[3], rotation, threshold, k == m)
                nodes, weights = (x[1], x[2]) if k == m else (np.concatenate([x[1], y[1]]), np.concatenate([x[2], y[2]]))
                j = j if k == m else j + len(x[1])
                links = np.zeros(len(nodes), np.int64)
                np.add.at(links, i, weights[j])
                np.add.at(links, j, weights[i])
                hit = links > 0
                out.append((nodes[hit], links[hit], nodes[forest(i, j, len(nodes))][hit]))
        whole = lambda k: np.concatenate([np.zeros(0, np.int64), *[o[k] for o in out]])
        return pa.table({"node": whole(0), "links": whole(1), "root": whole(2)})

    units = sides.join(numbered, "block").join(tiles, "id").select("a", "b", "block", "i", "node", "weight", "v", "lo", "hi")
    return materialize(units.groupBy("a", "b").applyInArrow(meet, "node long, links long, root long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors, whatever its other columns.

    Two vectors link when their cosine, in double precision, is at least threshold.
    """
    small = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = np.float32 if small else np.float64

    def read(b):
        found = [_vector(x) for x in column(b, "e")]
        blobs = [None if v is None else v.astype(kind).tobytes() for v in found]
        return {"vec_id": b.column(0), "key": [None if x is None else xxhash.xxh3_128_digest(x) for x in blobs], "d": [0 if v is None else len(v) for v in found], "v": [None if v is None else v.tobytes() for v in found]}

    id_type = vectors.schema[id_col].dataType.simpleString()
    id_type = "long" if id_type in ("tinyint", "smallint", "int", "bigint") else id_type
    rows = map_arrow(vectors.select(F.col(id_col).cast(id_type).alias("vec_id"), F.col(vector_col).alias("e")), read, f"vec_id {id_type}, key binary, d int, v binary")
    rows = materialize(rows, "vectors")
    one = rows.where("d > 0").groupBy("key", "d").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    classes = materialize(one.withColumn("node", F.monotonically_increasing_id()), "classes")
    spark = vectors.sparkSession
    links = spark.createDataFrame([], "node long, links long, root long")
    for (d,) in classes.select("d").distinct().collect():
        links = links.union(_links(classes.where(F.col("d") == d), d, threshold))
    components = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    own = classes.drop("v").join(counts, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("id").alias("component_id"))
    found = own.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    full = rows.where("d > 0").select("vec_id", "key").join(found, "key").select("vec_id", "n_links", "component_id")
    full = full.union(rows.where("d = 0").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return full.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
