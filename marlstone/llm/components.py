"""Connected components of a link table, by contraction, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, sized, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a long, b long); component is the smallest id reachable.

    Each round hooks every vertex to its smallest neighbour, follows the hooks once more, and rewrites the links
    between what remains; every vertex that is not the smallest around it goes, so links shrink geometrically. Hot
    vertices are handled by partial aggregation (``min`` per vertex) and by joins whose skewed side Spark can split.
    Links with a null end or equal ends are ignored; an empty table gives an empty result.
    """
    clean = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, whole = written(clean, "links"), None
    while True:
        n = edges.count()
        if not n:
            break
        ends = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
            edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
        )
        hook = written(ends.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("h")), "hooks")
        small = hook.count()
        onward = sized(hook.select(F.col("x").alias("h"), F.col("h").alias("h2")), small)
        jumped = written(hook.join(onward, "h").select("x", F.col("h2").alias("h")), "jumps")
        drop_written(hook)
        to_a = sized(jumped.select(F.col("x").alias("a"), F.col("h").alias("ha")), small)
        to_b = sized(jumped.select(F.col("x").alias("b"), F.col("h").alias("hb")), small)
        moved = edges.join(to_a, "a").join(to_b, "b").where("ha <> hb")
        moved = moved.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct()
        nxt = written(moved, "links")
        drop_written(edges)
        edges = nxt
        if whole is None:
            whole = jumped.select(F.col("x").alias("id"), F.col("h").alias("component"))
        else:
            step = sized(jumped.select(F.col("x").alias("component"), F.col("h").alias("next")), small)
            whole = whole.join(step, "component", "left")
            whole = written(whole.select("id", F.coalesce("next", "component").alias("component")), "components")
    if whole is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return whole
