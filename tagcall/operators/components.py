"""Connected components by large and small stars: every round ties each node to smaller ones of its neighbours.

A large star ties the greater neighbours of a node to the least node around it, a small star the
lesser ones; in the end each node hangs from the least of its component, after some rounds times the
logarithm of the nodes.  A node's neighbours are never in one row or task: the least of them is an
aggregate, and joins deal the edges of the few nodes that hold a good share of them where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import drop, saved

#: A key is hot if it holds more than one in so many rows, so there are fewer hot keys than this.
HOT = 1000


def spread_join(rows: DataFrame, of_keys: DataFrame, on: list[str], total: int, count: str = "n") -> DataFrame:
    """Rows joined to one row for each key, which counts the key's rows; those of hot keys stay where they are."""
    hot = F.broadcast(of_keys.where(F.col(count) * HOT > total))  # fewer than HOT rows
    cold = rows.join(hot.select(*on), on, "left_anti").join(of_keys.where(F.col(count) * HOT <= total), on)
    return rows.join(hot, on).unionByName(cold)


def _stars(edges: DataFrame, keys: list[str], total: int, large: bool) -> DataFrame:
    """One kind of star around every node u of the edges (u, v)."""
    u, v = F.col("u"), F.col("v")
    if large:
        around = saved(edges.unionByName(edges.select(*keys, v.alias("u"), u.alias("v"))), "star-edges")
        least = saved(around.groupBy(*keys, "u").agg(F.least(F.first("u"), F.min("v")).alias("least"), F.count("*").alias("n")), "star-least")
        made = spread_join(around.where(v > u), least, [*keys, "u"], 2 * total).select(*keys, v.alias("u"), F.col("least").alias("v"))
    else:
        around = edges
        least = saved(around.groupBy(*keys, "u").agg(F.min("v").alias("least"), F.count("*").alias("n")), "star-least")
        made = spread_join(around, least, [*keys, "u"], total).select(*keys, v.alias("u"), F.col("least").alias("v")).unionByName(least.select(*keys, "u", F.col("least").alias("v")))
    out = saved(made.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    for d in [least, *([around] if large else [])]:
        drop(d)
    return out


def _state(edges: DataFrame, keys: list[str]) -> tuple:
    every: list[Column] = [F.xxhash64(*keys, "u", "v")]
    return tuple(edges.agg(F.count("*"), F.bit_xor(every[0]), F.sum(every[0].cast("decimal(38,0)"))).first())


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, label) from edges (keys, a, b): the least node of each one's component.  Nodes of different keys are apart."""
    d = saved(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = _state(d, keys)
    while state[0]:
        larger = _stars(d, keys, state[0], True)
        smaller = _stars(larger, keys, larger.count(), False)
        drop(d), drop(larger)
        d, before = smaller, state
        state = _state(d, keys)
        if state == before:
            break
    tops = d.select(*keys, F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return d.select(*keys, F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops)
