from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import sharding, url_filter
from heddle.llm.queries import RULES, op1_url_filter

DATA = "/root/testdata/sf0.001"

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "x://example.com/en/7", "x://badexample.com/en/7", "x://example.net/de/81", "x://example.net/de/9", "x://net/de/", "x://foo.org/es/", "x://foo.org#/es/", "x://Listed.com/a.html?u", "x://listed.com/a/", "x://listed.com/ab", "a://b://c/d", "x://listed.com/a/\n", "x://listed.com/" + "a" * 100_000 + ".html"]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def brute(url, listed):
    host, path = brute_parts(url)
    best = max(((len(r), r, v) for v, r in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=None)
    name = host + (path.removesuffix(".html") if path.endswith(".html") else path.removesuffix("/")) if host else None
    hit = name is not None and name in listed
    return host, path, best[1] if best else None, best[2] if best else "block" if hit else "allow", name, hit


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_url_filter_against_brute_force(spark, limit):
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(URLS)] + [(4, URLS[4], 1), (None, None, 1)], "page_id long, url string, block int")
    named = ["listed.com/a", "listed.com/a", None, "c/d", "never.seen/x"]
    listed = spark.createDataFrame([(x,) for x in named], "canonical string")
    found = url_filter.filter_urls(pages, listed, RULES, broadcast_bytes=limit)
    expected = [(r.page_id, *brute(r.url, set(named) - {None})) for r in pages.collect()]
    assert Counter(map(tuple, found.collect())) == Counter(expected)


def test_empty_list_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "x://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "canonical string")
    assert [r.verdict for r in url_filter.filter_urls(pages, none, RULES).collect()] == ["allow"]
    assert url_filter.filter_urls(pages.limit(0), none, RULES).count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = 2000 * 16 // 256
    table = url_filter.bloom(keys, "key", blocks)

    def passed(df):
        ok = F.lit(True)
        for i, m in enumerate(url_filter._bits(F.col("key"))):
            ok = ok & (F.col(f"w{i}").bitwiseAND(m) == m)
        return df.withColumn("block", url_filter._block(F.col("key"), blocks)).join(table, "block").where(ok).count()

    assert passed(keys) == 2000
    assert passed(keys.select(F.concat(F.lit("other"), "key").alias("key"))) < 60


def test_query_runs_without_python(spark):
    df = op1_url_filter(spark, DATA)
    assert df.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 4)])
def test_hilbert_curve_visits_each_cell_once_by_unit_steps(dims, bits):
    side = 2**bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dims), -1).reshape(-1, dims)
    at = sharding.hilbert_index(grid, bits)
    assert sorted(at) == list(range(side**dims))
    path = grid[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name", ["texts", "documents", "no_texts"])
def test_shards_hold_equal_counts(request, name):
    docs = request.getfixturevalue(name)
    found = sharding.assign(docs, ["lang", "source", "n_chars"]).collect()
    import zlib

    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    counts = [len(by[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(16))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    curve = [r.curve for r in sorted(found, key=lambda r: r.rank)]
    assert curve == sorted(curve)


def test_levels_are_middles_of_ranks(spark):
    """Values of many rows spread over all levels; nulls and all-null columns have level 0."""
    values = ["a"] * 13 + ["b"] * 62 + ["c"] * 10 + ["d"] * 15
    df = spark.createDataFrame([(v, float(ord(v)), None) for v in values] + [(None, None, None)], "s string, x double, empty string")
    cuts = sharding.levels(df, ["s", "x", "empty"], 4)
    assert len(cuts["s"]) == 15 and cuts["s"] == sorted(cuts["s"]) and cuts["empty"] == []
    grid = {tuple(c): i for i, c in zip(sharding.hilbert_index(np.array([(k,) for k in range(16)]), 4), [(k,) for k in range(16)], strict=True)}
    at = {i: c[0] for c, i in grid.items()}
    for name in ("s", "x"):
        placed = df.select(name, sharding.hilbert_column(df, [name], cuts, 4).alias("i")).distinct().collect()
        got = {r[0]: at[r.i] for r in placed}
        middles = {"a": 1, "b": 7, "c": 12, "d": 14}
        assert got[None] == 0
        assert all(abs(got[v if name == "s" else float(ord(v))] - m) <= 1 for v, m in middles.items())


def read_by(boxes, **wanted):
    """Shards that a reader of these values must open."""
    return sum(all(r[f"min_{c}"] is not None and r[f"min_{c}"] <= v <= r[f"max_{c}"] for c, v in wanted.items()) for r in boxes)


def test_readers_skip_shards_by_each_column(spark):
    """Against dealing by hash, which prunes nothing, and against sorting by one column, which prunes by that one only."""
    dims = ["lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    found = sharding.assign(docs, dims).select("doc_id", "shard").join(docs, "doc_id")
    boxes = sharding.ranges(found, dims).collect()
    shares = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    for lang, n in shares.items():
        assert read_by(boxes, lang=lang) <= (8 if n <= docs.count() / 5 else 14), (lang, read_by(boxes, lang=lang))
        assert read_by(boxes, lang=lang, n_chars=300) < read_by(boxes, lang=lang)
    hashed = sharding.ranges(docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16))), dims).collect()
    by_length = sharding.ranges(docs.selectExpr("*", "ntile(16) OVER (ORDER BY n_chars) AS shard"), dims).collect()
    mean = lambda b: sum(read_by(b, source=f"src{k}", lang=x) for k in range(20) for x in shares) / (20 * len(shares))
    assert mean(boxes) < 0.6 * min(mean(hashed), mean(by_length))


def test_columns_with_the_names_of_shards(spark, tmp_path):
    docs = spark.range(50).selectExpr("cast(id AS string) AS doc_id", "id % 3 AS _shard", "id % 5 AS _slot", "1 AS _file", "'x' AS cell", "2 AS salt", "concat('t', id) AS text")
    sharding.write_shards(docs, str(tmp_path / "s"), ["_shard"], shards=4, rows_per_file=5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert back.columns[-1] == "_shard_" and back.select("_shard_").distinct().count() == 4
    with pytest.raises(ValueError):
        sharding.assign(docs, ["_shard", "_slot", "_file"], bits=7)


@pytest.mark.parametrize(("hot", "share", "rows"), [(10, 0.01, 7), (10_000, 0.5, 3)])
def test_groups_of_a_cell_are_numbered_gapless(spark, monkeypatch, hot, share, rows):
    monkeypatch.setattr(sharding, "HOT_ROWS", hot)
    monkeypatch.setattr(sharding, "HOT_SHARE", share)
    monkeypatch.setattr(sharding, "GROUP_ROWS", rows)
    docs = spark.range(300).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 4)) AS source", "if(id % 3 = 0, 'same', concat('t', id % 40)) AS text")
    found = sharding.assign(docs, ["source"]).collect()
    assert sorted(r.rank for r in found) == list(range(300))
    runs = [(r.curve, r.text_crc32) for r in sorted(found, key=lambda r: r.rank)]
    assert sum(a != b for a, b in zip(runs, runs[1:])) + 1 == len(set(runs))


def test_written_shards_hold_all_rows(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "s"), ["lang", "source", "n_chars"], shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(documents.columns).collect())) == sorted(map(str, documents.collect()))


@pytest.mark.parametrize("hot", [10, 10_000])
def test_written_shards_are_those_of_assign(spark, tmp_path, monkeypatch, hot):
    """Also where one cell holds most rows; equal texts lie together inside it."""
    monkeypatch.setattr(sharding, "HOT_ROWS", hot)
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id % 4 = 0, 'source_1', 'source_2') AS source", "concat('t', id % 5 * (id % 3)) AS text")
    found = sharding.assign(docs, ["source"], shards=8).collect()
    sharding.write_shards(docs, str(tmp_path / "s"), ["source"], shards=8)
    back = spark.read.parquet(str(tmp_path / "s")).select("doc_id", "_shard").collect()
    assert sorted(map(tuple, back)) == sorted((r.doc_id, r.shard) for r in found)
    runs = [(r.curve, r.text_crc32) for r in sorted(found, key=lambda r: r.rank)]
    assert sum(a != b for a, b in zip(runs, runs[1:])) + 1 == len(set(runs))
    assert len({r.curve for r in found}) == 2
