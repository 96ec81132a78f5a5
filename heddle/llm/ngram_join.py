"""Exact Jaccard self-join of word n-gram sets, with set-relation skipping.

The join reports classes, not pairs: one row per document with the component that
its links reach.

1. Equal sets are one class; its documents share every answer.
2. Each class lists its shingles in one global order: those that few documents
   hold first (by hash), frequent ones last. Two sets with a similarity of t share
   a shingle among the first n - ceil(t n) + 1 of each. Which shingles count as
   frequent changes the work, never the result.
3. Those prefixes are inverted to lists; a list's entries are ordered by set size
   and carry the position of the shingle in its set.
4. Relation rounds: each entry is compared with its predecessor only, then with its
   list's hub, the set with most links so far. Similar sets become one component,
   so that a long list of near copies costs a comparison or two for each member.
5. Skipping round: a list whose members are in one component is skipped whole;
   in the others, size order ends the scan of an entry early, and positions skip
   partners that cannot reach t any more. Only pairs of different components are
   compared: what holds for a component's members follows from the components'
   other links.
6. Derived answers: a set's hub is the most linked of its verified partners, and
   how the two differ is known exactly. What two hubs have in common is computed
   once; it bounds what their members have in common from both sides, so most
   pairs of members get their answer without a look at their sets.

Before any set is sent, parities (a bit or so a shingle) rule out pairs: two sets
differ in at least as many shingles as their parities differ in bits. All that
stays is verified on the whole sets.

Long lists are cut into blocks, and pairs of blocks are the unit of work, so no
task holds a whole hot list. Hashes have 64 bits; classes are told apart by 128.

Defined cases: documents without words have an empty set, link with nothing and
are their own component (their own doc_id). Equal texts, repeated rows and null
ids fall into classes by their text; component_id is the smallest id that isn't
null. Ids are of any type that has an order, strings too. Other columns take no
part, whatever their names. A very long text is a step of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import WHOLE, column, discard, fresh, hash_words, local_rows, map_arrow, materialize, release, windows
from heddle.llm.components import connected_components

#: A shingle that an Arrow batch holds so often is a candidate for the frequent ones.
LOCAL_COUNT = 4
#: At most so many frequent shingles are told to the tasks (8 bytes each).
FREQUENT = 1 << 19
#: Entries of a list beyond which it is cut into blocks.
BLOCK = 2048
#: Entries a task inverts at once.
SHARD_ENTRIES = 200_000
#: Rounds of comparisons with hubs; more of them leave less to the skipping round, never another result.
STAR_ROUNDS = 2
#: Columns of compared pairs of classes a < b: their sizes, and what they have in common.
LINK = "a long, b long, na long, nb long, common long"
#: Rows up to which a table of a few numbers a row is broadcast; its rows are counted first.
BROADCAST_ROWS = 500_000


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(windows(hash_words((text or b"").lower().split()), size))


def _signature(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def parity(s: np.ndarray) -> bytes:
    """How often each value of a hash's low bits occurs, modulo 2: two to four bits a shingle, 512 at least.

    Two sets differ in at least as many shingles as their parities differ in bits.
    """
    size = max(512, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int = 64) -> np.ndarray:
    """The parity of the same set in so many bytes: fewer low bits of the hashes tell its values apart."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key"))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, n, sig of each row; a batch's first row also has the shingles frequent in the batch."""

    def run(b):
        sets = [shingle_set(x) for x in column(b, "text")]
        h, c = np.unique(np.concatenate([*{_signature(s): s for s in sets}.values(), np.zeros(0, np.uint64)]), return_counts=True)
        often = c >= LOCAL_COUNT
        return {
            "doc_id": b.column(0),
            "text_key": b.column(2),
            "n": [len(s) for s in sets],
            "sig": [_signature(s) for s in sets],
            "often": [h[often].view(np.int64), *[None] * (len(sets) - 1)],
            "counts": [c[often], *[None] * (len(sets) - 1)],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(_texts(docs), run, f"doc_id {kind}, text_key long, n long, sig binary, often array<long>, counts array<long>")


def _frequent(rows: DataFrame) -> np.ndarray:
    both = rows.where("often is not null and size(often) > 0").select(F.explode(F.arrays_zip("often", "counts")).alias("x"))
    top = both.groupBy("x.often").agg(F.sum("x.counts").alias("c")).orderBy(F.desc("c"), "often").limit(FREQUENT)
    found = top.toPandas()["often"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _classes(docs: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """node, sig, n, rare, prefix, bits: each distinct set once; the first `rare` shingles of prefix aren't frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(b):
        often, out = shared.value, {}
        for x in column(b, "text"):
            s = shingle_set(x)
            sig = _signature(s)
            if sig is None or sig in out:
                continue
            known = np.zeros(len(s), bool)
            if len(often):
                at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                known = often[at] == s
            order = np.concatenate([s[~known], s[known]])[: _prefix_length(len(s), percent)]
            out[sig] = (len(s), min(len(order), int((~known).sum())), order.tobytes(), parity(s))
        return {"sig": list(out)} | {c: [v[k] for v in out.values()] for k, c in enumerate(("n", "rare", "prefix", "bits"))}

    found = map_arrow(_texts(docs), run, "sig binary, n long, rare int, prefix binary, bits binary")
    one = found.groupBy("sig").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    return materialize(one.withColumn("node", F.monotonically_increasing_id()), "classes")


def _entries(b, rare: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h, node, n, pos of the rare or the frequent part of each prefix."""
    nodes, ns, rares = (np.asarray(column(b, c), np.int64) for c in ("node", "n", "rare"))
    lists = [np.frombuffer(x, np.uint64) for x in column(b, "prefix")]
    part = [x[:r] if rare else x[r:] for x, r in zip(lists, rares, strict=True)]
    size = np.array([len(x) for x in part], np.int64)
    first = np.zeros(len(part), np.int64) if rare else rares
    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    return np.concatenate(part) if part else np.zeros(0, np.uint64), np.repeat(nodes, size), np.repeat(ns, size), pos


def _lists(classes: DataFrame) -> DataFrame:
    """h, node, n, pos of all shingles that two classes or more have in their prefixes."""
    total = classes.agg(F.sum("rare")).first()[0] or 0
    shards = 1 + total // SHARD_ENTRIES

    def cut(b):
        h, node, n, pos = _entries(b, True)
        shard = (h >> np.uint64(40)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(shards + 1))
        parts = [order[edge[k] : edge[k + 1]] for k in range(shards)]
        full = [k for k in range(shards) if len(parts[k])]
        pack = lambda x, kind: [x[parts[k]].astype(kind).tobytes() for k in full]
        return {"shard": full, "h": pack(h & np.uint64(0xFFFFFFFF), np.uint32), "node": pack(node, np.int64), "n": pack(n, np.int32), "pos": pack(pos, np.int32)}

    def shared(t: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        # 40 bits or so are left of a hash; lists that thereby become one only make pairs that fail later
        h = join("h", np.uint32).astype(np.int64) + (t.column("shard")[0].as_py() << 32)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        live = order[np.append(same, False) | np.insert(same, 0, False)] if len(s) else order
        release()
        return pa.table({"h": h[live], "node": join("node", np.int64)[live], "n": join("n", np.int32)[live], "pos": join("pos", np.int32)[live]})

    def often(b):
        h, node, n, pos = _entries(b, False)
        return {"h": (h | np.uint64(1 << 63)).view(np.int64), "node": node, "n": n.astype(np.int32), "pos": pos.astype(np.int32)}

    kind = "h long, node long, n int, pos int"
    packed = map_arrow(classes.where("rare > 0"), cut, "shard int, h binary, node binary, n binary, pos binary", WHOLE)
    rare = packed.groupBy("shard").applyInArrow(shared, kind)
    return materialize(rare.union(map_arrow(classes.where("rare < length(prefix) / 8"), often, kind)), "lists")


def _reach(percent: int) -> str:
    """x before y in size order, at their first common shingle: can they still reach the threshold?"""
    return f"100 * xn >= {percent} * yn and {100 + percent} * (1 + least(xn - xpos, yn - ypos) - 1) >= {percent} * (xn + yn)"


def _predecessors(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of entries next to each other in their list's size order."""
    long = lists.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK)
    dealt = lists.join(long, "h", "left").withColumn("salt", F.when(F.col("c").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK))).cast("int"))

    def near(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("n", "node")
        return df.withColumn("x", F.lag(F.struct("node", "n", "pos")).over(w)).withColumn("k", F.row_number().over(w))

    inside = near(dealt, "h", "salt")
    heads = near(inside.where("k = 1 and c is not null").drop("x", "k"), "h")
    pairs = inside.unionByName(heads).where("x is not null").selectExpr("x.node as xnode", "x.n as xn", "x.pos as xpos", "node as ynode", "n as yn", "pos as ypos")
    return pairs.where(_reach(percent)).select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """A materialised table, marked for broadcast if its exact size allows that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _stars(lists: DataFrame, found: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of a list's hub, its entry with most links, and entries of other components."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    own = lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    hubs = own.join(degree, "node").groupBy("h").agg(F.max(F.struct("degree", F.col("n"), "node", "pos", "component")).alias("hub"))
    met = own.join(hubs, "h").where("component <> hub.component")
    first = (F.col("n") < F.col("hub.n")) | ((F.col("n") == F.col("hub.n")) & (F.col("node") < F.col("hub.node")))
    at = lambda c, low: F.when(first if low else ~first, F.col(c)).otherwise(F.col(f"hub.{c}"))
    pairs = met.select(*[at(c, True).alias(f"x{c}") for c in ("node", "n", "pos")], *[at(c, False).alias(f"y{c}") for c in ("node", "n", "pos")])
    return pairs.where(_reach(percent)).select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()


def _both(pairs: DataFrame, data: DataFrame, value: Column) -> DataFrame:
    """a, b, x, y: the pairs with the value that data has of either node; only those values are shuffled."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    ends = F.broadcast(ends) if pairs.count() <= BROADCAST_ROWS else ends
    at = lambda c: F.max(F.when(F.col("node") == F.col(c), value))
    return data.join(ends, "node").groupBy("a", "b").agg(at("a").alias("x"), at("b").alias("y"))


def _reaches(n: Column, common: Column, percent: int) -> Column:
    """Do two sets of n shingles together, of which so many are common, reach the threshold?"""
    return (100 + percent) * common >= percent * n


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their parities don't rule out."""

    def run(b):
        keep = []
        for x, y in zip(column(b, "x"), column(b, "y"), strict=True):
            size, both = min(len(x["bits"]), len(y["bits"])), x["n"] + y["n"]
            differ = int(np.bitwise_count(folded(x["bits"], size) ^ folded(y["bits"], size)).sum())
            keep.append((100 + percent) * (both - differ) >= 2 * percent * both)
        keep = pa.array(keep, pa.bool_())
        return {"a": b.column(0).filter(keep), "b": b.column(1).filter(keep)}

    return map_arrow(_both(pairs, classes, F.struct("n", "bits")), run, "a long, b long")


def _common(pairs: DataFrame, docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, na, nb, common of the pairs; the sets are made anew from one document of each class."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(classes.select("node", "sig").join(nodes, "node", "left_semi").join(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "sig"), "wanted")
    ids = _small(wanted.select("doc_id").distinct())
    texts = _texts(docs)
    texts = texts.join(ids, texts.doc_id.eqNullSafe(ids.doc_id), "left_semi")

    def sets(b):
        found = {_signature(s): s.tobytes() for s in map(shingle_set, column(b, "text")) if len(s)}
        return {"sig": list(found), "s": list(found.values())}

    def run(b):
        na, nb, common = [], [], []
        for x, y in zip(column(b, "x"), column(b, "y"), strict=True):
            na.append(len(x) // 8)
            nb.append(len(y) // 8)
            common.append(na[-1] + nb[-1] - len(np.unique(np.frombuffer(x + y, np.uint64))))
        return {"a": b.column(0), "b": b.column(1), "na": na, "nb": nb, "common": common}

    found = map_arrow(texts, sets, "sig binary, s binary").join(_small(wanted.select("sig", "node")), "sig").groupBy("node").agg(F.first("s").alias("s"))
    return materialize(map_arrow(_both(pairs, found, F.col("s")), run, LINK), "common")


def _hubs(linked: DataFrame) -> DataFrame:
    """node, hub, lost (shingles of the node that its hub lacks), more (the other way round), of every node with a better linked partner."""
    ends = linked.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("hub"), (F.col("na") - F.col("common")).alias("lost"), (F.col("nb") - F.col("common")).alias("more")), F.struct(F.col("b").alias("node"), F.col("a").alias("hub"), (F.col("nb") - F.col("common")).alias("lost"), (F.col("na") - F.col("common")).alias("more")))).alias("e")).select("e.*")
    degree = materialize(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degree")
    rank = lambda c: F.struct("degree", (-F.col(c)).alias("first"))
    best = ends.join(degree.select(F.col("node").alias("hub"), "degree"), "hub").groupBy("node").agg(F.max(rank("hub")).alias("rank"), F.max_by(F.struct("hub", "lost", "more"), rank("hub")).alias("e"))
    return best.join(degree, "node").where(F.col("rank") > rank("node")).select("node", "e.*")


def _derived(pairs: DataFrame, hubs: DataFrame, percent: int, common) -> tuple[DataFrame, DataFrame]:
    """Of the pairs (a, b, na, nb): those that link by their hubs' answers, and those that these don't decide.

    A pair of hubs is asked for only where two pairs of members or more share it.
    """
    at = lambda c: hubs.select(F.col("node").alias(c), F.col("hub").alias(f"h{c}"), F.col("lost").alias(f"lost_{c}"), F.col("more").alias(f"more_{c}"))
    own = pairs.join(_small(at("a")), "a", "left").join(_small(at("b")), "b", "left")
    own = own.fillna(0, ["lost_a", "more_a", "lost_b", "more_b"]).withColumn("x", F.coalesce("ha", "a")).withColumn("y", F.coalesce("hb", "b"))
    own = materialize(own.withColumn("ha", F.least("x", "y")).withColumn("hb", F.greatest("x", "y")).drop("x", "y"), "members")
    asked = materialize(own.where("ha <> hb").groupBy("ha", "hb").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("ha").alias("a"), F.col("hb").alias("b")), "asked")
    answers = common(asked).select(F.col("a").alias("ha"), F.col("b").alias("hb"), "common")
    joined = own.join(_small(answers), ["ha", "hb"], "left")
    least = F.col("common") - F.col("more_a") - F.col("more_b")
    most = F.col("common") + F.col("lost_a") + F.col("lost_b")
    both = F.col("na") + F.col("nb")
    # a pair of hubs is a pair itself: nothing is lost or more there, so its answer is exact
    yes = F.coalesce(_reaches(both, least, percent), F.lit(False))
    no = F.coalesce(~_reaches(both, most, percent), F.lit(False))
    told = materialize(joined.select("a", "b", yes.alias("yes"), no.alias("no")), "derived")
    return told.where("yes").select("a", "b"), told.where("not yes and not no").select("a", "b")


def _small_parities(classes: DataFrame) -> DataFrame:
    """node, bits: each class's parity in 512 bits."""
    return map_arrow(classes.select("node", "bits"), lambda b: {"node": b.column(0), "bits": [folded(x).tobytes() for x in column(b, "bits")]}, "node long, bits binary")


def _across(lists: DataFrame, found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of different components that can still reach the threshold."""
    own = lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = own.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h", "c")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    open_ = own.join(mixed, "h").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # an entry takes part in the pairs of its block with each block, itself included
    units = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    units = units.select("h", "lo", "hi", "block", "node", "n", "pos", "component").join(_small_parities(classes), "node")
    units = materialize(units, "units")
    buckets = 1 + units.count() // SHARD_ENTRIES

    def pairs(t: pa.Table) -> pa.Table:
        h, lo, hi, block, node, n, pos, comp = (t.column(c).to_numpy() for c in ("h", "lo", "hi", "block", "node", "n", "pos", "component"))
        order = np.lexsort((node, n, hi, lo, h))
        h, lo, hi, block, node, n, pos, comp = (x[order].astype(np.int64) for x in (h, lo, hi, block, node, n, pos, comp))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, 8)[order]
        first = np.flatnonzero((100 + percent) * (n - pos) >= 2 * percent * n)  # positions that skip all larger partners are out
        # pairs as one number each, by the places of their nodes
        nodes, place = np.unique(node, return_inverse=True)
        out, held = np.zeros(0, np.int64), []
        k = 0
        while len(first):
            k += 1
            first = first[first + k < len(h)]
            j = first + k
            go = (h[first] == h[j]) & (lo[first] == lo[j]) & (hi[first] == hi[j]) & (100 * n[first] >= percent * n[j])
            first, j = first[go], j[go]
            ok = (comp[first] != comp[j]) & ((lo[j] == hi[j]) | (block[first] != block[j]))
            ok &= (100 + percent) * np.minimum(n[first] - pos[first], n[j] - pos[j]) >= percent * (n[first] + n[j])
            x, y = first[ok], j[ok]
            for at in range(0, len(x), 50_000):
                i, j = x[at : at + 50_000], y[at : at + 50_000]
                differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                near = (100 + percent) * (n[i] + n[j] - differ) >= 2 * percent * (n[i] + n[j])
                i, j = place[i[near]], place[j[near]]
                held.append(np.minimum(i, j) << 32 | np.maximum(i, j))
            if sum(map(len, held)) > 500_000:
                out, held = np.unique(np.concatenate([out, *held])), []
        out = np.unique(np.concatenate([out, *held]))
        found = pa.table({"a": nodes[out >> 32], "b": nodes[out & 0xFFFFFFFF]})
        del h, lo, hi, block, node, n, pos, comp, bits, nodes, place, out
        release()
        return found

    dealt = units.withColumn("bucket", F.pmod(F.xxhash64("h", "lo", "hi"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, counters: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of
    five-word shingles. counters, if given, is filled: pairs after each round, pairs
    verified on their sets, pairs whose answers were derived.
    """
    return _grouped(docs, percent, counters).drop("text_key")


def _grouped(docs: DataFrame, percent: int, counters: dict[str, int] | None = None) -> DataFrame:
    """near_duplicates() with text_key, a hash of the row's text."""
    docs = docs.select("doc_id", "text")
    rows = materialize(_rows(docs), "rows")
    classes = _classes(docs, _frequent(rows), percent)
    lists = _lists(classes)
    none = local_rows(docs.sparkSession, [], LINK)

    def count(name: str, df: DataFrame) -> None:
        if counters is not None:
            counters[name] = counters.get(name, 0) + df.count()

    def common(pairs: DataFrame) -> DataFrame:
        count("verified", pairs)
        return none if pairs.isEmpty() else _common(pairs, docs, rows, classes)

    def close(pairs: DataFrame) -> DataFrame:
        count("pairs", pairs)
        return materialize(_close(pairs, classes, percent), "close") if not pairs.isEmpty() else pairs

    link = _reaches(F.col("na") + F.col("nb"), F.col("common"), percent)
    tested = materialize(_predecessors(lists, percent), "near")
    linked = common(close(tested)).where(link)
    found = materialize(connected_components(linked), "components")
    for _ in range(STAR_ROUNDS):
        stars = materialize(_stars(lists, found, linked, percent).join(tested, ["a", "b"], "left_anti"), "stars")
        if stars.isEmpty():
            break
        more = common(close(stars)).where(link)
        tested, linked = tested.union(stars), linked.union(more)
        if more.isEmpty():
            break
        found = materialize(connected_components(linked), "components")
    pairs = materialize(_across(lists, found, classes, percent).join(tested, ["a", "b"], "left_anti"), "across")
    last = close(pairs)
    if not last.isEmpty():
        sizes = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"))
        ends = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last
        sized = sizes("b").join(_small(materialize(sizes("a").join(ends, "a"), "ends")), "b")
        yes, open_ = _derived(sized, _hubs(linked), percent, common)
        count("derived", yes)
        count("undecided", open_)
        exact = common(materialize(open_, "undecided")).where(link).select("a", "b")
        found = materialize(connected_components(linked.select("a", "b").union(yes).union(exact)), "components")
    discard(pairs, tested)
    own = classes.select("sig", "node").join(found, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    ids = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("id")).join(own, "sig")
    least = ids.groupBy("component").agg(F.min("id").alias("component_id"))
    of = ids.join(least, "component").select("sig", "component_id")
    full = rows.where("n > 0").join(of, "sig").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", "text_key", "n", "doc_id"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the document with the smallest id.

    Rows with the same id and text are one document, of which the row that is first
    as JSON stays. A group without any id keeps a row of each text. The texts
    themselves aren't shuffled unless rows repeat, or more than BROADCAST_ROWS
    documents go.
    """
    found = _grouped(docs, percent).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("c"))
    goes = ~F.col("doc_id").eqNullSafe(F.col("c"))
    id_, key, gone, row = (fresh(docs, c) for c in ("_id", "_key", "_goes", "_row"))
    marks = materialize(found.where(goes | (F.col("n") > 1)).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), goes.alias(gone)), "marks")
    here = docs["doc_id"].eqNullSafe(marks[id_]) & (F.xxhash64(docs["text"]) == marks[key])
    joined = docs.join(_small(marks), here, "left")
    once = joined.where(F.col(gone).isNull()).select(docs.columns)
    again = joined.where(~F.col(gone)).select(id_, key, F.struct(*docs.columns).alias(row))
    again = again.groupBy(id_, key).agg(F.min_by(row, F.to_json(row)).alias(row)).select(f"{row}.*")
    return once.unionByName(again)
