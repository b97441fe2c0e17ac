"""Connected components by alternating large-star and small-star rounds.

No group is collected: minima are aggregated before the shuffle, joined back
skew-safely, and each round is written as a table, so that a hub that links a
third of all nodes is spread over tasks and a lost executor costs one round at
most. A caller may have a few links, a bounded number, finished by one task
instead: a round is some nine exchanges, whose tasks and plans the driver keeps
account of however few rows they have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catena.llm.common import Scratch, saved, skew_join


def connected_components(links: DataFrame, a: str = "a", b: str = "b", keep: Callable[[DataFrame], DataFrame] = saved, at_once: int = 0) -> DataFrame:
    """(node, component) for every node in links; component is the smallest node reachable.

    links holds pairs of longs in any order; loops, repeats and pairs with a
    null are ignored. No links give an empty table. keep writes the result.
    As soon as at_once distinct links or fewer are there, one task does the rest.
    """
    spark = links.sparkSession
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    table = Scratch(spark)
    edges = table.saved(edges)
    state = _state(edges)
    while state[0] > at_once:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        with table:
            table = Scratch(spark)
            edges = table.saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    with table:
        if 0 < state[0] <= at_once:
            return keep(edges.coalesce(1).mapInArrow(_whole, "node long, component long"))
        return keep(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of links u - v, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # both are roots, so that no cycle comes about
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if links:
        found = least_reachable(*map(np.concatenate, zip(*links)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
