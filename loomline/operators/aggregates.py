"""Aggregates over finite values, power means, ladders, votes and apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: str) -> Column:
    """x where it is a finite number, else null."""
    c = F.col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_sum(x: str) -> Column:
    return F.sum(finite(x))


def moments(x: str, digits: int = 6) -> list[Column]:
    """count, mean, population variance and deviation of the finite values."""
    v = finite(x)
    return [F.count(v).alias("n"), F.round(F.avg(v), digits).alias("mean"), F.round(F.var_pop(v), digits).alias("variance"), F.round(F.stddev_pop(v), digits).alias("deviation")]


def complete_cases(fields: list[str]) -> list[Column]:
    """A sum and a count for each field, and for rows that have all of them."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & finite(f).isNotNull()
    each = [x for f in fields for x in (F.round(F.sum(finite(f)), 2).alias(f"{f}_sum"), F.count(finite(f)).alias(f"{f}_n"))]
    return [*each, *[F.round(F.sum(F.when(whole, finite(f))), 2).alias(f"{f}_complete") for f in fields], F.count_if(whole).alias("complete_n")]


def power_mean(x: str, weight: str, power: float) -> Column:
    """Weighted; the geometric mean for power 0."""
    v, w = F.col(x), F.col(weight)
    if power == 0:
        return F.exp(F.sum(w * F.ln(v)) / F.sum(w))
    return F.pow(F.sum(w * F.pow(v, F.lit(power))) / F.sum(w), F.lit(1 / power))


def ladder(ranks: DataFrame, player: str, place: str, points: int, most: int) -> DataFrame:
    """Each place is worth the whole part of points / place; per player the places held, the firsts and the points, the best `most`."""
    by = ranks.groupBy(player).agg(F.count("*").alias("places"), F.count_if(F.col(place) == 1).alias("firsts"), F.sum(F.floor(F.lit(points) / F.col(place))).alias("points"))
    return by.orderBy(F.desc("points"), player).limit(most)


def votes(ballots: DataFrame, choice: str, options: DataFrame, option: str) -> DataFrame:
    """Votes per option, options without votes too; a null choice is none."""
    counted = ballots.where(F.col(choice).isNotNull()).groupBy(F.col(choice).alias(option)).agg(F.count("*").alias("votes"))
    return options.join(counted, option, "left").select(option, F.coalesce("votes", F.lit(0)).alias("votes"))


def decided(tally: DataFrame, option: str) -> DataFrame:
    """First and second by votes, and whether the first is certain: the rest of the voters are fewer than its votes."""
    order = Window.orderBy(F.desc("votes"), option)  # a row per option
    top = tally.withColumn("at", F.row_number().over(order)).withColumn("voters", F.sum("votes").over(Window.partitionBy()))
    return top.where("at <= 2").select(option, "votes", F.col("at").cast("long").alias("place"), ((F.col("at") == 1) & (F.col("voters") - F.col("votes") < F.col("votes"))).alias("certain"))


def apportion(df: DataFrame, amount: int, weight: str, order: str) -> DataFrame:
    """Shares of a whole amount by weight, in order, each rounded so that the running total is: nothing is lost."""
    running = Window.orderBy(order)
    total = F.sum(weight).over(Window.partitionBy())
    upto = F.floor(amount * F.sum(weight).over(running) / total)
    return df.withColumn("upto", F.when(total > 0, upto).otherwise(F.lit(0))).withColumn("share", F.col("upto") - F.lag("upto", 1, 0).over(running)).drop("upto")
