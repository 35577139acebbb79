"""Purged cross-validation: blocks of trading dates, all test combinations, purge and embargo in trading positions."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.columns import beside, shielded
from ..session import materialise
from .panel import trading_dates


def blocks(panel: DataFrame, groups: int = DEFAULT.groups) -> DataFrame:
    """(date, pos, block): contiguous blocks of distinct dates, sizes differing by one at most."""
    return trading_dates(panel).withColumn("block", F.ntile(groups).over(Window.orderBy("pos")) - 1)


def n_paths(groups: int = DEFAULT.groups, test: int = DEFAULT.test_groups) -> int:
    return comb(groups, test) * test // groups


@shielded
def split_roles(samples: DataFrame, groups: int = DEFAULT.groups, test: int = DEFAULT.test_groups, embargo: int = DEFAULT.embargo) -> DataFrame:
    """Adds ``train_in`` and ``test_in``: the numbers of the splits in which a row of ``samples`` (date, t1) has that role.

    A row trains unless it lies in a test block, resolves at or after a test block's start having begun by its end, or
    falls within ``embargo`` trading dates after it. Blocks' ranges (one row a block) and combinations are small, so
    each row is compared with them in one expression instead of being joined for each split. A null ``t1`` purges
    nothing; rows with a null date go.
    """
    dated = materialise(blocks(samples, groups), "blocks")  # one row a date
    spans = dated.groupBy("block").agg(F.min("date").alias("b0"), F.max("date").alias("b1"), F.max("pos").alias("p1"))
    last = dated.agg(F.max("pos").alias("p_last"))
    ends = dated.select(F.col("pos").alias("until_pos"), F.col("date").alias("until"))
    spans = beside(spans, last).withColumn("until_pos", F.least(F.col("p1") + embargo, "p_last")).join(ends, "until_pos")
    packed = spans.agg(F.array_sort(F.collect_list(F.struct("block", "b0", "b1", "until"))).alias("_spans"))
    rows = beside(samples.join(F.broadcast(dated.select("date", F.col("block").alias("_block"))), "date"), packed)

    def blocked(b: int):
        span = F.try_element_at("_spans", F.lit(b + 1))
        purge = (F.col("t1") >= span["b0"]) & (F.col("date") <= span["b1"])
        late = (F.col("date") > span["b1"]) & (F.col("date") <= span["until"])
        return F.coalesce(purge, F.lit(False)) | F.coalesce(late, F.lit(False))

    barred = F.array(*[blocked(b) for b in range(groups)])
    rows = rows.withColumn("_barred", barred)
    train, held = [], []
    for i, pair in enumerate(combinations(range(groups), test)):
        inside = F.col("_block").isin(*pair)
        free = ~inside
        for b in pair:
            free = free & ~F.col("_barred")[b]
        train.append(F.when(free, i))
        held.append(F.when(inside, i))
    return rows.withColumns({"train_in": F.array_compact(F.array(*train)), "test_in": F.array_compact(F.array(*held))}).drop("_spans", "_block", "_barred")


def split_numbers(groups: int = DEFAULT.groups, test: int = DEFAULT.test_groups) -> list[int]:
    return list(range(comb(groups, test)))


def roles(samples: DataFrame, groups: int = DEFAULT.groups, test: int = DEFAULT.test_groups, embargo: int = DEFAULT.embargo) -> DataFrame:
    """(split_id, role) for each row of ``samples`` (see :func:`split_roles`): train or test, other rows are left out."""
    tagged = split_roles(samples, groups, test, embargo)
    each = lambda c, role: F.transform(c, lambda s: F.struct(s.cast("int").alias("split_id"), F.lit(role).alias("role")))
    both = F.concat(each("train_in", "train"), each("test_in", "test"))
    return tagged.withColumn("_s", F.explode(both)).select(*samples.columns, "_s.split_id", "_s.role")


def temporal_split(samples: DataFrame, test_fraction: float = DEFAULT.test_fraction, embargo: int = DEFAULT.embargo) -> DataFrame:
    """Role by one cut in time: test from date number int(n * (1 - fraction)), train before the embargo ahead of it."""
    dates = trading_dates(samples)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    cut = F.floor(n * (1.0 - test_fraction)).cast("int")
    tagged = dates.withColumn("_cut", cut)
    role = F.when(F.col("pos") >= F.col("_cut"), "test").when(F.col("pos") < F.greatest(F.lit(0), F.col("_cut") - embargo), "train")
    return samples.join(F.broadcast(tagged.select("date", role.alias("role"))), "date").where("role is not null")


def meta_split(samples: DataFrame) -> DataFrame:
    """Role by the median date: primary rows resolve by it, meta rows begin after it."""
    cut = samples.agg(F.percentile(F.unix_date("date"), F.lit(0.5)).alias("_cut")).withColumn("_k", F.lit(1))
    rows = samples.withColumn("_k", F.lit(1)).join(F.broadcast(cut), "_k").drop("_k")
    day = F.unix_date("date")
    role = F.when(day > F.col("_cut"), "meta").when(F.unix_date("t1") <= F.col("_cut"), "primary")
    return rows.withColumn("role", role).drop("_cut").where("role is not null")


def effective_n(dates: DataFrame, horizon: int = DEFAULT.horizon) -> DataFrame:
    """Distinct dates over the horizon, 1 at least."""
    n = F.floor(F.count_distinct("date") / max(int(horizon), 1))
    return dates.agg(F.greatest(n, F.lit(1)).cast("long").alias("n_eff"))
