"""Leakage-checked splits, never as index lists.

A family of splits is two tables: one row per row (its fold, and what else decides its
role), and one row per split. A row's role in a split follows from the two when it is
read, so a family costs a pass over the rows, not rows times splits. members() gives the
table (split_id, row_id, role) of the splits that are asked for; totals() adds up both
sides of all splits from sums by fold.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.ordered import running_sums

#: Groups that group_k_fold() places one by one; the rest is dealt by running sums.
HEAVY = 1000
MISSING = "<missing>"


@dataclass(frozen=True)
class Family:
    """rows: row_id, fold, wing, rank. candidates: split_id, fold, trains, rank; splits are those of which both sides hold rows.

    A split tests its fold. It trains, as `trains` says, on others (all other folds),
    first or second (the other folds of the wing true or false), or earlier (folds of
    lower rank). Rows whose fold is null take part in no test and, for earlier, in nothing.
    """

    rows: DataFrame
    candidates: DataFrame
    kinds: tuple[str, ...] = ("others",)

    @property
    def splits(self) -> DataFrame:
        return self.candidates.join(self.totals().select("split_id").distinct(), "split_id", "left_semi")

    def role(self, fold: Column, trains: Column, rank: Column) -> Column:
        """The role of a row of `rows` in a split of these values; null where it has none."""
        own = F.coalesce(F.col("fold") == fold, F.lit(False))
        trained = (
            F.when(trains == "others", True)
            .when(trains == "first", F.col("wing"))
            .when(trains == "second", ~F.col("wing"))
            .when(trains == "earlier", F.coalesce(F.col("rank") < rank, F.lit(False)))
        )
        return F.when(own, "test").when(trained, "train")

    def members(self, ids: Iterable[str] | None = None) -> DataFrame:
        """split_id, row_id, role of the splits asked for, or of all, which is rows times splits."""
        chosen = self.splits if ids is None else self.splits.where(F.col("split_id").isin(list(ids)))
        asked = chosen.select("split_id", F.col("fold").alias("_fold"), "trains", F.col("rank").alias("_rank"))
        role = self.role(F.col("_fold"), F.col("trains"), F.col("_rank"))
        return self.rows.crossJoin(asked).select("split_id", "row_id", role.alias("role")).where("role is not null")

    def totals(self, sums: dict[str, Column] | None = None) -> DataFrame:
        """split_id, role, n and the sums over both sides of every split; rows are added up by fold once."""
        return totals(self.rows, self.candidates, self.kinds, sums or {})


def totals(rows: DataFrame, splits: DataFrame, kinds: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    names = ["n", *sums]
    # a row for each group; all else follows from it
    each = rows.groupBy("fold", "wing", "rank").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]).persist()
    wing = lambda c, w: F.coalesce(F.sum(F.when(F.col("wing") == w, F.col(c))), F.lit(0))
    own = each.where("fold is not null").groupBy("fold").agg(*[F.sum(c).alias(c) for c in names], *[wing(c, w).alias(f"{c}_own_{k}") for c in names for k, w in (("first", True), ("second", False))])
    sides = each.agg(*[F.sum(c).alias(f"{c}_others") for c in names], *[wing(c, w).alias(f"{c}_{k}") for c in names for k, w in (("first", True), ("second", False))])
    s = splits.join(own, "fold").crossJoin(F.broadcast(sides))
    if "earlier" in kinds:
        ranks = running_sums(each.where("rank is not null").groupBy(F.col("rank").alias("_rank")).agg(*[F.sum(c).alias(c) for c in names]), [], "_rank", names)
        s = s.join(ranks.select("_rank", *[(F.col(f"{c}_upto") - F.col(c)).alias(f"{c}_earlier") for c in names]), F.col("rank") == F.col("_rank"), "left")

    def trained(c: str) -> Column:
        by_kind = {"others": F.col(f"{c}_others") - F.col(c), "first": F.col(f"{c}_first") - F.col(f"{c}_own_first"), "second": F.col(f"{c}_second") - F.col(f"{c}_own_second"), "earlier": F.col(f"{c}_earlier") if "earlier" in kinds else None}
        return F.coalesce(*[F.when(F.col("trains") == k, by_kind[k]) for k in kinds])

    side = lambda role, of: F.struct(F.lit(role).alias("role"), *[of(c).alias(c) for c in names])
    whole = s.withColumns({f"_t_{c}": trained(c) for c in names}).where("n > 0 and _t_n > 0")
    return whole.select("split_id", F.explode(F.array(side("test", F.col), side("train", lambda c: F.col(f"_t_{c}")))).alias("x")).select("split_id", "x.*")


def _rows(df: DataFrame, fold: Column, wing: Column | None = None, rank: Column | None = None) -> DataFrame:
    yes = F.lit(True) if wing is None else F.coalesce(wing, F.lit(False))
    return df.select("row_id", fold.cast("string").alias("fold"), yes.alias("wing"), (F.lit(None) if rank is None else rank).cast("long").alias("rank"))


def _splits(folds: DataFrame, split_id: Column, trains: str | Column = "others") -> DataFrame:
    kind = trains if isinstance(trains, Column) else F.lit(trains)
    return folds.select(split_id.alias("split_id"), "fold", kind.alias("trains"), "rank")


def logo_family(df: DataFrame, key: str, prefix: str = "logo") -> Family:
    rows = _rows(df, F.col(key))
    folds = rows.where("fold is not null").select("fold", F.lit(None).cast("long").alias("rank")).distinct()
    return Family(rows, _splits(folds, F.concat(F.lit(f"{prefix}|"), F.col("fold"))))


def leave_one_group_out(df: DataFrame, key: str, prefix: str = "logo") -> DataFrame:
    """Members of one split per group; rows without one train in all."""
    return logo_family(df, key, prefix).members()


def kfold_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """group, fold: groups by falling size (then name), each to the lightest fold (then the lowest).

    So go the HEAVY largest; the others, each smaller than any of these, are dealt in
    hash order by running sums of their rows into what room the folds have left.
    A null group is a group, named MISSING.
    """
    counts = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(MISSING)).alias("group")).agg(F.count(F.lit(1)).alias("c"))
    spark, load, placed = df.sparkSession, [0] * k, []
    for r in counts.orderBy(F.desc("c"), "group").limit(HEAVY).collect():
        fold = load.index(min(load))
        load[fold] += r["c"]
        placed.append((r["group"], fold))
    heads = spark.createDataFrame(placed, "group string, fold int")
    if len(placed) < HEAVY:
        return heads
    tail = counts.join(F.broadcast(heads), "group", "left_anti").withColumn("at", F.xxhash64("group").cast("double") + F.pmod(F.crc32(F.col("group").cast("binary")), F.lit(1024)) / 2048)
    merged = tail.groupBy("at").agg(F.sum("c").alias("c"))
    rest = merged.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    level = (sum(load) + rest) / k
    room = [max(0.0, level - x) for x in load]
    scale = rest / sum(room) if sum(room) else 1.0
    ends, upto = [], 0.0
    for x in room:
        upto += x * scale
        ends.append(upto)
    run = running_sums(merged, [], "at", ["c"])
    middle = F.col("c_upto") - F.col("c") / 2
    fold = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < middle)), F.lit(k - 1)).cast("int")
    return heads.unionByName(tail.join(run.select("at", fold.alias("fold")), "at").select("group", "fold"))


def kfold_family(df: DataFrame, key: str, k: int) -> Family:
    folds = kfold_groups(df, key, k)
    own = df.select("row_id", F.coalesce(F.col(key).cast("string"), F.lit(MISSING)).alias("group")).join(folds, "group")
    rows = _rows(own, F.col("fold"))
    every = df.sparkSession.range(k).select(F.col("id").cast("string").alias("fold"), F.lit(None).cast("long").alias("rank"))
    return Family(rows, _splits(every, F.concat(F.lit("fold|"), F.col("fold"))))


def group_k_fold(df: DataFrame, key: str, k: int) -> DataFrame:
    """Members of k folds balanced by rows; no group is in two folds."""
    return kfold_family(df, key, k).members()


def heldout_family(df: DataFrame, group: str, value: str, subject: str = "subject_id", prefix: str = "heldout") -> Family:
    rows = _rows(df, F.col(subject))
    folds = df.where(F.col(group) == value).select(F.col(subject).cast("string").alias("fold"), F.lit(None).cast("long").alias("rank")).where("fold is not null").distinct()
    return Family(rows, _splits(folds, F.concat(F.lit(f"{prefix}|"), F.col("fold"))))


def heldout_with_background(df: DataFrame, group: str, value: str, subject: str = "subject_id", prefix: str = "heldout") -> DataFrame:
    """One split per subject of a group; everyone else trains."""
    return heldout_family(df, group, value, subject, prefix).members()


def forward_family(df: DataFrame, key: str, numeric: bool = False, prefix: str = "forward") -> Family:
    """Periods in text order, or by their digits; periods are few, rows are not."""
    text = F.col(key).cast("string")
    order = [F.regexp_extract("fold", r"([0-9]+)", 1).cast("long"), F.col("fold")] if numeric else [F.col("fold")]
    periods = df.select(text.alias("fold")).where("fold is not null").distinct().withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    ranked = df.select("row_id", text.alias("fold")).join(periods, "fold")
    return Family(_rows(ranked, F.col("fold"), rank=F.col("rank")), _splits(periods.where("rank > 1"), F.concat(F.lit(f"{prefix}|"), F.col("fold")), "earlier"), ("earlier",))


def forward_chain(df: DataFrame, key: str, numeric: bool = False, prefix: str = "forward") -> DataFrame:
    """Test on each period but the first, train on all earlier."""
    return forward_family(df, key, numeric, prefix).members()


REGIMES = {"background_to_target": "second", "mixed_to_target": "others", "target_loso": "first"}


def population_family(df: DataFrame, target: str = "target", subject: str = "subject_id", group: str = "group") -> Family:
    """For each target subject three training sets: the background, everyone else, the other targets."""
    rows = _rows(df, F.col(subject), F.col(group) == target)
    folds = rows.where("wing and fold is not null").select("fold", F.lit(None).cast("long").alias("rank")).distinct()
    named = folds.withColumn("regime", F.explode(F.array(*map(F.lit, REGIMES))))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in REGIMES.items() for x in p]), F.col("regime"))
    return Family(rows, _splits(named, F.concat_ws("|", "regime", "fold"), kind), tuple(REGIMES.values()))


def population_regimes(df: DataFrame, target: str = "target", subject: str = "subject_id", group: str = "group") -> DataFrame:
    return population_family(df, target, subject, group).members()


def calibration_holdout(members: DataFrame, df: DataFrame, subject: str = "subject_id", label: str = "label") -> DataFrame:
    """Move the last max(1, n div 5) training subjects to role cal.

    Undone where it would take all subjects or has under two classes; the split goes
    where the rest of the training rows has under two.
    """
    own = members.join(df.select("row_id", F.col(subject).cast("string").alias("_s"), F.col(label).alias("_l")), "row_id")
    subjects = own.where("role = 'train'").select("split_id", "_s").distinct()
    w = Window.partitionBy("split_id")
    held = subjects.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("_s")))).where("_n > 1 and _k <= greatest(1, _n div 5) and greatest(1, _n div 5) < _n").select("split_id", "_s").withColumn("_cal", F.lit(True))
    marked = own.join(held, ["split_id", "_s"], "left").withColumn("_cal", F.coalesce("_cal", F.lit(False)) & (F.col("role") == "train"))
    stats = marked.groupBy("split_id").agg(F.count_distinct(F.when(F.col("_cal"), F.col("_l"))).alias("_c"), F.count_distinct(F.when(~F.col("_cal") & (F.col("role") == "train"), F.col("_l"))).alias("_t"), F.count_distinct(F.when(F.col("role") == "train", F.col("_l"))).alias("_all"))
    out = marked.join(stats, "split_id").withColumn("_use", F.col("_cal") & (F.col("_c") >= 2))
    rest = F.when(F.col("_c") >= 2, F.col("_t")).otherwise(F.col("_all"))
    return out.where(rest >= 2).select("split_id", "row_id", F.when(F.col("_use"), "cal").otherwise(F.col("role")).alias("role"))


def leakage(members: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values (and rows, key `row_id`) on both sides of a split; empty when there is no leak."""
    absent = [k for k in keys if k not in df.columns]
    if absent:
        raise KeyError(f"no such columns: {absent}")
    own = members.join(df.select("row_id", *[k for k in keys if k != "row_id"]), "row_id")
    values = own.select("split_id", "role", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in dict.fromkeys(["row_id", *keys])])).alias("x")).select("split_id", "role", "x.*").where("value is not null")
    sides = values.groupBy("split_id", "key", "value").agg(F.max((F.col("role") == "test").cast("int")).alias("t"), F.max((F.col("role") != "test").cast("int")).alias("r"))
    return sides.where("t = 1 and r = 1").select("split_id", "key", "value")


def family_leakage(family: Family, df: DataFrame, keys: list[str]) -> DataFrame:
    """leakage() of a family's splits, from the folds in which a value lies; no row is taken once a split.

    A value leaks where its rows lie in the split's fold and in a fold (or wing, or
    earlier rank) that the split trains on. Values of one cell of these only are gone
    before splits are met.
    """
    absent = [k for k in keys if k not in df.columns]
    if absent:
        raise KeyError(f"no such columns: {absent}")
    cells = ["fold", "wing", "rank"]
    named = [k for k in dict.fromkeys(keys) if k != "row_id"]
    own = family.rows.join(df.select("row_id", *named), "row_id") if named else family.rows
    known = family.splits.select("split_id", F.col("fold").alias("_fold"), "trains", F.col("rank").alias("_rank"))
    role = family.role(F.col("x._fold"), F.col("x.trains"), F.col("x._rank"))
    out: DataFrame | None = None
    for k in ["row_id", *named]:
        values = own.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("value"), *cells).agg(F.count(F.lit(1)).alias("_n"))
        met = values.groupBy("value").agg(F.collect_set(F.struct(*cells)).alias("_cells")).where(F.size("_cells") > 1)
        # the splits that test one of a value's folds; the other cells tell whether one trains
        tested = met.withColumn("_fold", F.explode(F.array_distinct(F.transform("_cells", lambda c: c["fold"])))).join(known, "_fold")
        each = tested.select("split_id", "value", F.struct("_fold", "trains", "_rank").alias("x"), F.explode("_cells").alias("_c")).select("split_id", "value", "x", "_c.*")
        found = each.where(role == "train").select("split_id", F.lit(k).alias("key"), "value").distinct()
        out = found if out is None else out.unionByName(found)
    return out


def filter_splits(splits: DataFrame, families: list[str] | None = None, ids: list[str] | None = None, per_family: int | None = None, order: str = "split_id") -> DataFrame:
    """Allowlists of families and ids, then the first so many of each family."""
    s = splits.withColumn("split_family", F.split_part("split_id", F.lit("|"), F.lit(1)))
    if families:
        s = s.where(F.col("split_family").isin(families))
    if ids:
        s = s.where(F.col("split_id").isin(ids))
    if per_family:
        s = s.withColumn("_k", F.row_number().over(Window.partitionBy("split_family").orderBy(order))).where(F.col("_k") <= per_family).drop("_k")
    return s


def repetition_family(df: DataFrame, keep: Column, key: str = "repetition", prefix: str = "loro") -> Family:
    """One split per repetition among the rows that `keep` selects."""
    return logo_family(df.where(keep), key, prefix)


def repetition_holdout(df: DataFrame, keep: Column, key: str = "repetition", prefix: str = "loro") -> DataFrame:
    return repetition_family(df, keep, key, prefix).members()


def episode_quota(dynamic: Column, position: Column) -> Column:
    """Episodes of a fold: three of each static position 0 and 1, two of dynamic ones, none else."""
    return F.when(dynamic == 1, 2).when((dynamic == 0) & position.isin(0, 1), 3).otherwise(0)


def quota_folds(df: DataFrame, block: list[str], quota: Column, folds: int = 4) -> DataFrame:
    """block, episode_id, fold: each block's first quota * folds episodes, dealt in turn.

    Rows of one episode are one (its first row); label 0 takes no part.
    """
    w = Window.partitionBy("episode_id").orderBy("row_id")
    first = df.where("label <> 0").withColumn("_quota", quota).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("episode_id", "row_id")) - 1
    return first.withColumn("_r", rank).where(F.col("_r") < F.col("_quota") * folds).select(*block, "episode_id", F.pmod(F.col("_r"), F.lit(folds)).alias("fold"))


def dev_holdout(df: DataFrame, share: float, seed: int = 0, least: int = 256, by: list[str] | None = None) -> DataFrame:
    """by, row_id, role: the share of each label with the smallest hashes is dev; none of a group under `least` rows.

    Where a label has a single row in its group, the share is taken of all the group's
    rows instead. Ranks come from counts by bucket of the hash, so that no task sorts a
    whole label.
    """
    by = by or []
    if share <= 0:
        return df.select(*by, "row_id", F.lit("train").alias("role"))
    sizes = df.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum("n").alias("_n"), F.min("n").alias("_least"))
    rows = df.join(sizes, by) if by else df.crossJoin(F.broadcast(sizes))
    h = rows.select(*by, "row_id", F.when(F.col("_least") > 1, F.col("label")).otherwise(0).alias("s"), "_n", F.xxhash64("row_id", F.lit(seed)).alias("h")).withColumn("b", F.pmod(F.shiftright("h", 48), F.lit(4096)))
    counts = h.groupBy(*by, "s", "b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by, "s")
    before = counts.select(*[F.col(c).alias(f"{c}2") for c in by], F.col("s").alias("s2"), F.col("b").alias("b2"), (F.sum("c").over(w.orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(w).alias("all"))
    k = F.row_number().over(Window.partitionBy(*by, "s", "b").orderBy("h", "row_id")) + F.col("before")
    test = F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2"))
    for c in by:
        test = test & (F.col(c) == F.col(f"{c}2"))
    ranked = h.join(before, test)
    return ranked.select(*by, "row_id", F.when((F.col("_n") >= least) & (k <= F.floor(F.col("all") * share)), "dev").otherwise("train").alias("role"))


def families_for(df: DataFrame, dataset: str) -> list[Family]:
    """The split families of a kind of dataset; an unknown kind is an error."""
    kinds = {
        "population": lambda: [population_family(df)],
        "sessions": lambda: [forward_family(df, "session", prefix="dayshift"), logo_family(df, "subject_id", "subject_logo")],
        "days": lambda: [forward_family(df, "day", numeric=True, prefix="forward_day")],
    }
    if dataset not in kinds:
        raise ValueError(f"unknown dataset kind: {dataset}")
    return kinds[dataset]()


def splits_for(df: DataFrame, dataset: str) -> DataFrame:
    """Members of all splits of a kind of dataset."""
    first, *more = [f.members() for f in families_for(df, dataset)]
    for m in more:
        first = first.unionByName(m)
    return first
