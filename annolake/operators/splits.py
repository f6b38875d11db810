"""Leak-free splits by physical group, and their audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.session import stable

# Three hex digits of the ranking hash: 4096 evenly filled, already ordered buckets.
_BUCKET_DIGITS = 3


def _cuts(total: Column, ratios: dict[str, float]) -> Column:
    """Last position of each slice, in the given order of the ratios.

    Sizes are the floor of each share; the remainder goes to the largest fractions, ties by name.
    """
    if abs(sum(ratios.values()) - 1.0) > 1e-8:
        raise ValueError(f"shares of the splits add up to {sum(ratios.values())} instead of 1: {ratios}")
    names = sorted(ratios)
    spots = F.sequence(F.lit(0), F.lit(len(ratios) - 1))
    shares = F.array(*[
        F.struct((total * F.lit(float(r))).alias("exact"), F.lit(names.index(n)).alias("tie")) for n, r in ratios.items()
    ])
    whole = lambda e: e["exact"].cast("long")
    part = lambda e: e["exact"] - whole(e)
    spare = total - F.aggregate(shares, F.lit(0).cast("long"), lambda s, e: s + whole(e))
    ahead = lambda e: F.size(F.filter(
        shares, lambda o: (part(o) > part(e)) | ((part(o) == part(e)) & (o["tie"] < e["tie"]))
    ))
    sizes = F.transform(shares, lambda e: whole(e) + (ahead(e) < spare).cast("long"))
    return F.transform(
        spots, lambda i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0).cast("long"), lambda s, v: s + v)
    )


def _slice_name(position: Column, cuts: Column, ratios: dict[str, float]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in ratios]), F.size(F.filter(cuts, lambda c: c < position)))


def _place_groups(df: DataFrame, seed: Column, group: str, by: list[str], cuts: Callable[[Column], Column]) -> DataFrame:
    """Distinct groups with ``_position`` in their hash order and the ``_cuts`` of their scope.

    The hash is uniform, so its leading digits are balanced range buckets: ranks come from
    per-bucket windows plus the counts of the buckets before, never from one sorted task.
    """
    groups = (
        df.select(*by, group, F.concat(seed.cast("string"), F.lit(":"), F.col(group)).alias("_seeded"))
        .distinct()
        .withColumn("_hash", F.sha2("_seeded", 256))
        .withColumn("_bucket", F.conv(F.substring("_hash", 1, _BUCKET_DIGITS), 16, 10).cast("int"))
    )
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = groups.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    buckets = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    totals = counted.groupBy(*by).agg(F.sum("_n").alias("_total")).select(*by, cuts(F.col("_total")).alias("_cuts"))
    if by:
        buckets = buckets.join(totals, by)
    else:
        buckets = buckets.withColumn("_cuts", totals.scalar())
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", group)
    placed = groups.withColumn("_row", F.row_number().over(inside)).join(buckets, [*by, "_bucket"])
    return placed.select(*by, group, (F.col("_before") + F.col("_row")).alias("_position"), "_cuts")


def allocate_groups(
    df: DataFrame,
    ratios: dict[str, float],
    seed: int | Column,
    group: str = "group_id",
    by: Sequence[str] = (),
    name: str = "split",
) -> DataFrame:
    """One row per distinct group with its slice of the hash-ranked groups."""
    by = list(by)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    placed = _place_groups(df, seed, group, by, lambda total: _cuts(total, ratios))
    return placed.select(*by, group, _slice_name(F.col("_position"), F.col("_cuts"), ratios).alias(name))


def assign_folds(
    df: DataFrame, k: int, seed: int, group: str = "group_id", name: str = "fold"
) -> DataFrame:
    """Equal-ratio allocation into ``k`` numbered folds."""
    return allocate_groups(df, {str(i): 1.0 / k for i in range(k)}, seed + 404, group, name=name)


def assign_splits(df: DataFrame, policy: dict, seed: int) -> DataFrame:
    """The split ladder over a catalog.

    1. ``bridge``: per dataset, groups owning a bridge row; every row of such a group follows.
    2. ``pooled``: several datasets share one allocation of the rows still without a split.
    3. ``single``: one allocation per dataset of the rows still without a split; a dataset is
       in ``pooled`` or in ``single``, not in both.
    4. ``external``: datasets with a constant split, overriding what was set before.
    5. ``folds``: cross-validation folds of one dataset.
    """
    keys = ["dataset_id", "group_id"]
    blank = F.coalesce("split", F.lit("")) == ""
    # One pass over the rows gives what every step needs to know about a group.
    groups = df.groupBy(*keys).agg(F.max(F.col("dataset_role") == "bridge").alias("bridge"), F.max(blank).alias("open"))
    dataset = F.col("dataset_id")
    rest = F.col("open") & ~F.col("bridge")
    ratios = policy.get("bridge", {"train": 0.6, "val": 0.2, "test": 0.2})
    # step name, members, scope inside the step, seed, ratios
    steps = [("bridge", F.col("bridge"), dataset, F.lit(seed + 1000) + F.length(dataset), ratios)]
    pooled = policy.get("pooled")
    if pooled:
        steps.append(("pooled", rest & dataset.isin(pooled["datasets"]), F.lit(""), F.lit(seed + 1), pooled["ratios"]))
    for dataset_id, ratios in policy.get("single", {}).items():
        steps.append(("single", rest & (dataset == dataset_id), dataset, F.lit(seed + len(dataset_id)), ratios))
    folds = policy.get("folds")
    if folds:
        k = int(folds["k"])
        steps.append(("folds", dataset == folds["dataset"], F.lit(""), F.lit(seed + 404), {str(i): 1.0 / k for i in range(k)}))

    # All steps are ranked together: each has its own scope, and a group its own scopes.
    joins = F.array_compact(F.array(*[
        F.when(member, F.struct(
            F.lit(number).alias("step"), scope.alias("scope"), step_seed.cast("long").alias("seed")
        )) for number, (_, member, scope, step_seed, _) in enumerate(steps)
    ]))
    members = stable(groups.select(*keys, F.explode(joins).alias("s")).select(*keys, "s.*"))
    scope = ["step", "scope"]

    def per_step(value: Callable[[dict], Column]) -> Column:
        result = F.lit(None)
        for number, (*_, ratios) in enumerate(steps):
            result = F.when(F.col("step") == number, value(ratios)).otherwise(result)
        return result

    placed = _place_groups(
        members, F.col("seed"), "group_id", scope, lambda total: per_step(lambda ratios: _cuts(total, ratios))
    )
    chosen = per_step(lambda ratios: _slice_name(F.col("_position"), F.col("_cuts"), ratios))
    settled = members.join(placed.select(*scope, "group_id", chosen.alias("chosen")), [*scope, "group_id"])
    named = lambda *names: F.max(F.when(F.col("step").isin([i for i, s in enumerate(steps) if s[0] in names]), F.col("chosen")))
    table = settled.groupBy(*keys).agg(
        named("bridge").alias("_bridge"), named("pooled", "single").alias("_filled"), named("folds").alias("_fold")
    )
    result = df.join(table, keys, "left").withColumn(
        "split", F.coalesce("_bridge", F.when(blank, F.col("_filled")), "split", F.lit(""))
    )
    external = policy.get("external")
    if external:
        result = result.withColumn(
            "split", F.when(dataset.isin(external["datasets"]), external["split"]).otherwise(F.col("split"))
        )
    if folds:
        result = result.withColumn("ring_r2_fold", F.coalesce("_fold", "ring_r2_fold", F.lit("")))
    return result.select(*df.columns)


def split_leaks(df: DataFrame) -> DataFrame:
    """Groups seen in more than one split, with their sorted splits (A4)."""
    return (
        df.groupBy("group_id")
        .agg(F.array_sort(F.collect_set(F.coalesce("split", F.lit("")))).alias("splits"))
        .where(F.size("splits") > 1)
    )


def group_overlap(df: DataFrame) -> DataFrame:
    """For every split pair, the groups found in both.

    Works on the leaking groups only; a group's splits are as few as the split names.
    """
    pairs = split_leaks(df).select("group_id", F.explode("splits").alias("split_l"), "splits")
    return (
        pairs.select("group_id", "split_l", F.explode("splits").alias("split_r"))
        .where(F.col("split_l") < F.col("split_r"))
    )


def intersect_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct groups common to two tables (U4)."""
    return left.select("group_id").intersect(right.select("group_id"))


def split_audit(df: DataFrame, positive: Column, raise_on_overlap: bool = False) -> DataFrame:
    """Per split: records, groups, records by dataset, positives and negatives."""
    if raise_on_overlap:
        shared = group_overlap(df).take(5)
        if shared:
            raise ValueError(f"physical groups shared between splits: {shared}")
    by_dataset = count_map(df, ["split"], "dataset_id", "dataset_records")
    return (
        df.groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_distinct("group_id").alias("groups"),
            F.count_if(positive).alias("positive_records"),
            F.count_if(~F.coalesce(positive, F.lit(False))).alias("verified_negative_records"),
        )
        .join(by_dataset, "split")
    )


def count_map(df: DataFrame, keys: Sequence[str], value: str, name: str = "counts") -> DataFrame:
    """Sorted map value -> count per key (A2); counted first, so only distinct values meet."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(value), F.lit("")), F.col("_n"))))
    return counted.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def map_text(column: str) -> Column:
    """A count map as ``key=count`` pairs joined by a comma and a blank."""
    entries = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.array_join(entries, ", ")
