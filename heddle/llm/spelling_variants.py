"""Words that differ by one code point, through a dictionary of pairs of trie nodes.

Words of a corpus are counted, and each distinct word becomes a path in two tries:
one of the words read forward, one of the words reversed. Nodes are numbered in the
order of the sorted words, so a prefix and a suffix are one integer each. A word of
length L gives L pairs (prefix node, suffix node) around a skipped position and
L + 1 around an insertion point. Two words differ by a replacement exactly where
they share a skipped pair, and by an insertion where a skipped pair of the longer is
an insertion pair of the shorter; neither strings nor hashes are compared.

Each pair of near words meets in one pair of nodes (of a run of equal letters only the
first is skipped for insertions), and those who meet there differ in a single letter, so
at most one more than the alphabet do. What a word takes from each meeting is a count
and its best partner, so no list of pairs is made.

Numbering sorts the words over all tasks. A task numbers the nodes that its own range
adds; nodes that its first word shares with the range before are inherited. Only the
first and last word of each range pass the driver.

Defined cases: null texts have no words; a null id is empty in `<doc_id>:<run>`;
repeated rows count again; a very long text is a step of its own, and a very long
word costs as much memory as its length in the task that holds it; other columns
take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import column, discard, enter, map_arrow, materialize, release, slices

#: Code points of words: ASCII letters and the block from U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: A number of a node is its range's number, shifted by so many bits, plus its place there.
RANGE_BITS = 40


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, slip: int = 199) -> DataFrame:
    """word and n of the runs of letters, A-Z lower-cased, of all texts.

    One in `slip` distinct runs of a document (by checksum) loses a code point.
    """
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def run(b):
        found: Counter[str] = Counter()
        for doc_id, text in zip(column(b, "doc_id"), column(b, "text"), strict=True):
            if not text:
                continue
            head = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for word, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():
                h = zlib.crc32(word.encode(), head)
                if h % slip == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < min_length:
                        continue
                found[word] += n
        return {"word": list(found), "n": list(found.values())}

    # bytes.lower() changes A-Z alone
    counted = map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def number_nodes(words: DataFrame, key: Column, name: str) -> DataFrame:
    """words with an array `name`: the trie node of each prefix of the key, the empty one first.

    Keys are distinct. Numbers grow with the order of the keys: a key's last node is its rank.
    """
    kept = words.columns
    sorted_words = words.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key")

    def paths(batches):
        enter(__name__)
        part, path, last, new = TaskContext.get().partitionId(), [], "", 0
        for b in batches:
            for piece in slices(b):
                local = []
                for word in column(piece, "key"):
                    if not path:
                        path, new = [0], 1
                    same = 0
                    for x, y in zip(last, word, strict=False):
                        if x != y:
                            break
                        same += 1
                    path = path[: same + 1] + list(range(new, new + len(word) - same))
                    new += len(word) - same
                    last = word
                    local.append(path)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([part] * len(local), pa.int64()), pa.array(local, pa.list_(pa.int64()))], [*piece.schema.names, "part", "local"])
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_words.schema)
    found = materialize(sorted_words.mapInArrow(paths, f"{schema}, part long, local array<long>"), "trie")
    ends = found.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("local", "key").alias("path"))
    # the first word's own path is numbered 0, 1, 2...: its leading nodes may be those of the range before
    inherited, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        shared: list[int] = []
        if before is not None:
            last, nodes = before
            same = next((k for k, (x, y) in enumerate(zip(last, r["first"], strict=False)) if x != y), min(len(last), len(r["first"])))
            shared = nodes[: same + 1]
        inherited.append((r["part"], shared))
        before = r["last"], [shared[k] if k < len(shared) else (r["part"] << RANGE_BITS) + k for k in r["path"]]
    spark = words.sparkSession
    # as many rows as ranges
    table = F.broadcast(spark.createDataFrame(inherited, "part long, shared array<long>"))
    node = F.transform("local", lambda k: F.when(k < F.size("shared"), F.get("shared", k.cast("int"))).otherwise(F.shiftleft("part", RANGE_BITS) + k))
    return found.join(table, "part").select(*kept, node.alias(name))


def meetings(words: DataFrame) -> DataFrame:
    """One row for each position of each word: prefix and suffix node, whether a position is skipped, and if so
    whether its letter starts a run of equal letters."""
    n = F.length("word")
    skipped = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get("forward", i).alias("p"),
            F.get("backward", n - 1 - i).alias("s"),
            F.lit(True).alias("skips"),
            ((i == 0) | (F.col("word").substr(i, F.lit(1)) != F.col("word").substr(i + 1, F.lit(1)))).alias("starts"),
        ),
    )
    whole = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.get("forward", i).alias("p"), F.get("backward", n - i).alias("s"), F.lit(False).alias("skips"), F.lit(False).alias("starts")))
    return words.select(F.get("forward", n).alias("id"), "n", F.inline(F.concat(skipped, whole)))


def near_words(places: DataFrame) -> DataFrame:
    """id, n_near and the best near word (largest n, then smallest id) of each word that has one."""
    here = Window.partitionBy("p", "s")
    ranked = here.orderBy(F.col("skips").desc(), F.col("n").desc(), "id")
    self = F.struct("n", (-F.col("id")).alias("id"))
    met = places.withColumns(
        {
            "skippers": F.count(F.when(F.col("skips"), 1)).over(here),
            "starters": F.count(F.when(F.col("starts"), 1)).over(here),
            "whole": F.max(F.when(~F.col("skips"), self)).over(here),
            "starter": F.max(F.when(F.col("starts"), self)).over(here),
            "place": F.row_number().over(ranked),
            "first": F.first(F.when(F.col("skips"), self)).over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "second": F.lead(F.when(F.col("skips"), self)).over(ranked),
        }
    )
    others = F.col("skippers") - 1
    inserted = F.col("starts") & F.col("whole").isNotNull()
    near = F.when(F.col("skips"), others + inserted.cast("int")).otherwise(F.col("starters"))
    twin = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("first"))
    best = F.when(F.col("skips"), F.greatest(twin, F.when(inserted, F.col("whole")))).otherwise(F.col("starter"))
    return met.select("id", near.alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root of forms (id, form): follow the forms to the last, by doubling.

    A form has several times its word's count, so chains are as short as the logarithm of the counts.
    """
    now = materialize(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        discard(now)
        now = step.drop("moved")
        now.stored_at = step.stored_at
        if not moved:
            return now


def group_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, slip: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least min_length code points and min_count occurrences.

    form: the near word of largest n (then the smallest), if that is at least ratio times the word's n.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: a form must be more frequent than its word")
    counted = materialize(word_counts(docs, min_length, min_count, slip), "words")
    forward = number_nodes(counted, F.col("word"), "forward")
    both = materialize(number_nodes(forward, F.reverse("word"), "backward"), "words")
    found = near_words(meetings(both))
    own = both.select(F.get("forward", F.length("word")).alias("id"), "word", "n")
    is_form = F.col("best.n") >= ratio * F.col("n")
    judged = own.join(found, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("best.id")).alias("form_id"), F.when(is_form, F.col("best.n")).alias("form_n"))
    judged = materialize(judged, "variants")
    discard(counted, both)
    ends = roots(judged.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    names = judged.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    tops = judged.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    linked = judged.where("form_id is not null").join(ends.withColumnRenamed("root", "root_id"), "id").join(names, "form_id").join(tops, "root_id")
    lone = judged.where("form_id is null")
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    return linked.select(*cols).unionByName(lone.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n"))
