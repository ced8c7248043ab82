"""Constrained selection: greedy picks per category with entity crowding, deep-dive pick, daily summary, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.config import DEFAULT
from quillstream.operators.tables import written


def select_top(candidates: DataFrame, categories: list[str], group: str = "digest_date", cfg=DEFAULT) -> DataFrame:
    """Candidates (group, category, key, total, entities) picked for each digest, with their rank.

    Categories in their fixed order share the used entities (a candidate's first three). Candidates are taken by total, ties
    by key. If a category has more than one candidate beyond the picks, one whose entities were used is passed over for
    good while any left without used ones scores more than its total less the crowding penalty per overlap.

    A pick is an aggregate over the candidates behind the last pick: of those without overlap, and of those with one, two
    and three, only the best can be next, and it is if the best without overlap doesn't beat it. So no group is gathered.
    """
    names = F.transform(F.slice(F.coalesce("entities", F.array().cast("array<string>")), 1, 3), lambda e: F.lower(e))
    kept = written(candidates.filter(F.col("category").isin(categories)).select(group, "category", "key", "total", F.array_distinct(names).alias("names")), "candidates")
    state = kept.select(group).distinct().withColumn("used", F.array().cast("array<string>"))
    picks = None
    for category in categories:
        mine = kept.filter(F.col("category") == category)
        state = state.withColumns({"last_total": F.lit(None).cast("double"), "last_key": F.lit(None).cast("string")})
        many = mine.groupBy(group).agg((F.count("*") > cfg.picks_per_category + 1).alias("many"))
        mine = mine.join(many, group)
        for rank in range(1, cfg.picks_per_category + 1):
            behind = F.col("last_total").isNull() | (F.col("total") < F.col("last_total")) | ((F.col("total") == F.col("last_total")) & (F.col("key") > F.col("last_key")))
            overlap = F.when(F.col("many"), F.size(F.array_intersect("names", "used"))).otherwise(0)
            row = F.struct((-F.col("total")).alias("minus"), "key", "names")
            best = [F.min(F.when(overlap == o, row)).alias(f"b{o}") for o in range(4)]
            found = mine.join(state, group).filter(behind).groupBy(group).agg(*best)
            free = -F.col("b0.minus")
            fits = lambda o: F.when(free.isNull() | (-F.col(f"b{o}.minus") - cfg.penalties["crowding"] * o >= free), F.col(f"b{o}"))
            next_ = F.array_min(F.array_compact(F.array("b0", fits(1), fits(2), fits(3))))
            found = written(found.select(group, next_.alias("p")).filter("p is not null"), "picks")
            one = found.select(group, F.lit(category).alias("category"), F.col("p.key").alias("key"), (-F.col("p.minus")).alias("total"), F.lit(rank).alias("rank"))
            picks = one if picks is None else picks.unionByName(one)
            # a digest without a next pick has none after it either
            state = state.join(found, group, "left").select(group, F.array_union("used", F.coalesce("p.names", F.array().cast("array<string>"))).alias("used"), F.coalesce(-F.col("p.minus"), F.lit(float("-inf"))).alias("last_total"), F.coalesce("p.key", "last_key").alias("last_key"))
    return picks


def underfilled(picks: DataFrame, categories: list[str], group: str = "digest_date", cfg=DEFAULT) -> DataFrame:
    """(group, category, picks) of the categories with fewer picks than there should be; those without any count 0."""
    every = picks.select(group).distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    n = picks.groupBy(group, "category").agg(F.count("*").alias("picks"))
    return every.join(n, [group, "category"], "left").withColumn("picks", F.coalesce("picks", F.lit(0))).filter(F.col("picks") < cfg.picks_per_category)


def deep_dive(items: DataFrame, group: str = "digest_date", cfg=DEFAULT) -> DataFrame:
    """The relevant item with the highest democracy score, then total, of each digest, if it reaches the floor."""
    order = Window.partitionBy(group).orderBy(F.desc("democracy"), F.desc("total"), "key")
    return items.filter("relevant").withColumn("_r", F.row_number().over(order)).filter((F.col("_r") == 1) & (F.col("democracy") >= cfg.deep_dive_floor)).drop("_r")


def daily_summary(items: DataFrame, group: str = "digest_date") -> DataFrame:
    """Counts and means of each digest. Without a relevant item the net direction is 0, and the last three are null."""
    d, relevant = F.when(F.col("relevant"), F.col("direction")), F.count_if("relevant")
    some = lambda c: F.when(relevant > 0, c)
    return items.groupBy(group).agg(
        F.count("*").alias("stories"), relevant.alias("democracy_relevant"), F.coalesce(F.round(F.avg(d), 3), F.lit(0.0)).alias("net_direction"),
        some(F.count_if(d < -0.3)).alias("erosion_stories"), some(F.count_if(d > 0.3)).alias("strengthening_stories"),
        F.round(F.avg(F.when(F.col("relevant"), F.col("significance"))), 3).alias("mean_significance"),
    )


def last_ascending(df: DataFrame, key: str, n: int) -> DataFrame:
    """The last n rows by key, oldest first."""
    return df.orderBy(F.desc(key)).limit(n).orderBy(key)
