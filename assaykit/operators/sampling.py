"""Deterministic draws: apportionment, terciles, round robin, splits, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.numbering import hex_cut, ranked
from assaykit.operators.rounds import kept


def stable(key: Column, salt: str = "") -> Column:
    """An order that looks random and that every engine gets alike."""
    return F.md5(F.concat(F.lit(salt), key.cast("string")))


def apportion(strata: DataFrame, stratum: str, size: str, total: int, ties: str = "asc") -> DataFrame:
    """Largest-remainder seats for each stratum, none above its size; what caps leave over goes by remaining room.

    ties: equal remainders go to the smaller key (asc) or the larger (desc); both are in use. One row for each stratum.
    """
    everything = Window.partitionBy()
    quota = F.lit(total) * F.col(size) / F.sum(size).over(everything)
    q = strata.withColumn("_q", quota).withColumn("_base", F.floor("_q")).withColumn("_left", F.col("_q") - F.col("_base"))
    key = F.desc(stratum) if ties == "desc" else F.asc(stratum)
    seats = F.lit(total) - F.sum("_base").over(everything)
    q = q.withColumn("_seats", F.least(F.col("_base") + (F.row_number().over(Window.orderBy(F.desc(F.round("_left", 9)), key)) <= seats).cast("long"), F.col(size)))
    spare = F.lit(total) - F.sum("_seats").over(everything)
    room = F.col(size) - F.col("_seats")
    before = F.coalesce(F.sum(room).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(room, spare - before))
    return q.select(stratum, size, (F.col("_seats") + extra).cast("long").alias("seats"))


def terciles(df: DataFrame, order: list[Column], groups: list[str], cut: Column, parts: int = 3) -> DataFrame:
    """Part floor(i * parts / n) + 1 by rank, which deals remainders otherwise than ntile; ``cut`` as for ranks."""
    r = ranked(df, groups, order, cut, "_rank", "_rows")
    return r.withColumn("part", (F.floor((F.col("_rank") - 1) * parts / F.col("_rows")) + 1).cast("long")).drop("_rank", "_rows")


def fractional_order(df: DataFrame, stratum: str, key: str) -> DataFrame:
    """(i + 1/2) / n within each stratum, by a numeric key: any prefix of this order is nearly proportional."""
    r = ranked(df, [stratum], [F.col(key)], F.col(key), "_rank", "_rows")
    return r.withColumn("place", (F.col("_rank") - 0.5) / F.col("_rows")).drop("_rank", "_rows")


def in_turn(df: DataFrame, stratum: str, key: str, salt: str) -> DataFrame:
    """Turn of each row within its stratum by stable order of the key; sorted by turn and stratum this is a round robin."""
    digest = stable(F.col(key), salt)
    return ranked(df, [stratum], [digest, F.col(key)], hex_cut(digest), "turn")


def first_n(df: DataFrame, stratum: list[str], n: int, order: list[Column]) -> DataFrame:
    """Up to n rows of each stratum."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*stratum).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def split(df: DataFrame, stratum: str, key: str, share: float, salt: str = "split") -> DataFrame:
    """Distinct keys with ``valid``: about that share of each stratum by hash, at least one of three or more."""
    digest = stable(F.col(key), salt)
    r = ranked(df.select(stratum, key).distinct(), [stratum], [digest, F.col(key)], hex_cut(digest), "_rank", "_rows")
    want = F.floor(F.col("_rows") * share + 0.5)
    want = F.when(F.col("_rows") >= 3, F.greatest(F.lit(1), want)).otherwise(want)
    return r.withColumn("valid", F.col("_rank") <= want).drop("_rank", "_rows")


def covered(df: DataFrame, cluster: str, vendor: str, vendors: int) -> DataFrame:
    """Clusters that every vendor covers."""
    return df.groupBy(cluster).agg(F.count_distinct(vendor).alias("_n")).where(F.col("_n") == vendors).select(cluster)


def quota_backfill(df: DataFrame, bucket: str, quotas: dict[str, int], total: int, order: list[Column], groups: list[str]) -> DataFrame:
    """Per group the quota of each bucket, topped up to ``total`` from the rest in order."""
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(bucket) == name, n).otherwise(quota)
    inside = F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order)) <= quota
    ranked = df.withColumn("_in", inside)
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_in"), *order))).where(F.col("_r") <= total).withColumn("by", F.when(F.col("_in"), "quota").otherwise("back-fill")).drop("_in", "_r")


def carve(df: DataFrame, item: str, categories: str, total: int, salt: str) -> DataFrame:
    """(item, stratum, carved): ``total`` items set apart in proportion to the exact sets of categories, by stable order in each.

    A stratum is an item's sorted categories; items without any are stratum ``(none)`` and stay. Fewer items with categories than ``total`` all go.
    """
    rows = df.select(item, F.array_join(F.array_sort(F.array_distinct(categories)), "|").alias("stratum"))
    pool = rows.where("stratum <> ''")
    sizes = pool.groupBy("stratum").agg(F.count(F.lit(1)).alias("_size"))
    seats = apportion(sizes, "stratum", "_size", min(total, pool.count())).select(F.col("stratum").alias("_s"), "seats")  # a row for each set of categories
    digest = stable(F.col(item), salt)
    placed = ranked(pool, ["stratum"], [digest, F.col(item)], hex_cut(digest), "_rank")
    drawn = placed.join(seats, F.col("stratum") == F.col("_s")).select(item, "stratum", (F.col("_rank") <= F.col("seats")).alias("carved"))
    return drawn.unionByName(rows.where("stratum = ''").select(item, F.lit("(none)").alias("stratum"), F.lit(False).alias("carved")))


def disjoint(df: DataFrame, item: str, sections: dict[str, tuple[Column, int]], salt: str) -> DataFrame:
    """(section, item, place): n items for each section, of those that meet its condition and that no section before it drew.

    Items of a section come in stable order. A section takes its n smallest and no more, so what is drawn stays as small as the numbers asked for.
    """
    taken: DataFrame | None = None
    for i, (name, (holds, n)) in enumerate(sections.items()):
        digest = stable(F.col(item), f"{salt}|{name}|")
        pool = df.where(holds).select(F.col(item).alias("_i"), digest.alias("_d")).distinct()
        if taken is not None:
            pool = pool.join(F.broadcast(taken.select("_i")), "_i", "left_anti")  # at most the numbers asked for
        drawn = pool.orderBy("_d", "_i").limit(n)
        place = F.row_number().over(Window.orderBy("_d", "_i"))  # n rows
        drawn = kept(drawn.select(F.lit(name).alias("section"), F.lit(i).alias("_n"), "_i", place.alias("place")))
        taken = drawn if taken is None else taken.unionByName(drawn)
    return taken.select("section", F.col("_i").alias(item), F.col("place").cast("long").alias("place"))
