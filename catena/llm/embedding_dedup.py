"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of one label are compared in tiles, on axes in the order of variance: a
rotation from a bounded sample, which changes no product. Leading axes come
first; with them known, the product of two vectors' norms on the other axes
bounds what is missing, and a pair that cannot reach the threshold is dropped.
Pairs left at the end are decided by the cosine of the vectors themselves.

Two unit vectors of cosine c are sqrt(2 - 2 c) apart, so on each axis as well.
A grid of that width on the first two axes makes cells, of which only
neighbours meet; a cell with many vectors is dealt into tiles by a salt, so
that no task gets more than two tiles at a time. A tile pair returns, for each
linked vector, how many it links with and the smallest of those it is connected
with there, instead of pairs. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catena.llm.common import saved, shuffle_partitions, skew_join
from catena.llm.components import connected_components

THRESHOLD = 0.98
#: Vectors of a tile, about.
TILE = 512
#: The bound of the sample that the axes are fitted on; they decide the order of work, not the result.
SAMPLE = 20_000
#: Axes after which bounds are taken.
STEPS = (8, 16, 32)
_SLACK = 1e-9


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Columns: axes by falling second moment."""
    _, axes = np.linalg.eigh(vectors.T @ vectors)
    return axes[:, ::-1].copy()


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs of rows with cosine of at least threshold."""
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    ra, rb = (ua @ axes, ub @ axes) if axes is not None else (ua, ub)
    d = ra.shape[1]
    cuts = [k for k in STEPS if k < d] + [d]
    tail = lambda x, k: np.sqrt(np.maximum((x[:, k:] ** 2).sum(axis=1), 0))
    known = ra[:, : cuts[0]] @ rb[:, : cuts[0]].T
    i, j = np.nonzero(known + np.outer(tail(ra, cuts[0]), tail(rb, cuts[0])) >= threshold - _SLACK)
    known = known[i, j]
    for k, nxt in zip(cuts, cuts[1:]):
        known = known + np.einsum("pd,pd->p", ra[i, k:nxt], rb[j, k:nxt])
        ta, tb = tail(ra, nxt), tail(rb, nxt)
        keep = known + ta[i] * tb[j] >= threshold - _SLACK
        i, j, known = i[keep], j[keep], known[keep]
    dots = np.einsum("pd,pd->p", a[i], b[j])
    cosine = dots / (np.linalg.norm(a, axis=1)[i] * np.linalg.norm(b, axis=1)[j])
    keep = cosine >= threshold
    return i[keep], j[keep]


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block(rep: np.ndarray, weight: np.ndarray, side: np.ndarray, vectors: np.ndarray, own: bool, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root) of the linked vectors of a tile (own) or of two tiles."""
    order = np.argsort(rep, kind="stable")
    rep, weight, side, vectors = rep[order], weight[order], side[order], vectors[order]
    left = np.arange(len(rep)) if own else np.flatnonzero(side == 0)
    right = left if own else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return rep[:0], weight[:0], rep[:0]
    i, j = close_pairs(vectors[left], vectors[right], axes, threshold)
    i, j = left[i], right[j]
    if own:
        i, j = i[i < j], j[i < j]
    links = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
    some = np.flatnonzero(links)
    return rep[some], links[some].astype(np.int64), rep[_local_roots(len(rep), i, j)][some]


def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & finite & (square > 0), F.lit(False))


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of one label and one dimension are compared, in double
    precision. A vector that is null, zero, or holds a null or a value that is
    not finite, one with a null label and one with a null id link with nothing.
    n_links counts other rows, repeats of an id too; component_id is the
    smallest vec_id reachable by links; kept says whether that is the row's
    own. An empty table gives an empty one; other columns are not read.
    """
    spark = table.sparkSession
    # An exact test of equality is not needed: classes that are split by it link with each other.
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("ok", _usable(F.col("v"), F.col("label")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("class", F.when(F.col("ok"), F.concat_ws(":", F.hex(F.xxhash64("label", "v")), F.hex(F.xxhash64(F.lit(1), "v", "label")), "label")))
    good = rows.where("ok")
    classes = saved(good.groupBy("class", "label").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("v").alias("v")))

    sizes = {r["d"]: r["count"] for r in classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()}
    axes, dim = None, 0
    for dim, n in sizes.items():
        draw = F.pmod(F.xxhash64("rep", F.lit("axes")), F.lit(1 << 30)) / float(1 << 30)
        sample = np.array([r["v"] for r in classes.where((F.size("v") == dim) & (draw < SAMPLE / n)).select("v").limit(2 * SAMPLE).toLocalIterator()], float).reshape(-1, dim)
        axes = principal_axes(sample / np.linalg.norm(sample, axis=1, keepdims=True)) if len(sample) else None
    width = float(np.sqrt(2 - 2 * threshold)) + _SLACK

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for v in batch.column(2).to_pylist():
                u = np.array(v)
                u = u / np.linalg.norm(u)
                lead = u @ axes[:, :2] if axes is not None and len(u) == dim else u[:2]
                at.append([int(np.floor(x / width)) for x in lead] + [0] * (2 - len(lead)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in at], pa.int32()), pa.array([y for _, y in at], pa.int32())], [*batch.schema.names, "x", "y"])

    placed = classes.select("rep", "weight", "v", F.concat_ws(":", F.size("v"), "label").alias("space")).mapInArrow(cells, "rep long, weight long, v array<double>, space string, x int, y int")
    placed = saved(placed)
    counts = placed.groupBy("space", "x", "y").agg(F.ceil(F.count(F.lit(1)) / float(tile)).cast("int").alias("tiles"))
    counts = saved(counts.withColumn("cell", F.xxhash64("space", "x", "y")))
    own = skew_join(placed.withColumn("cell", F.xxhash64("space", "x", "y")), counts.select("cell", "tiles"), "cell").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).drop("cell", "tiles")
    # A cell meets itself and its eight neighbours; the cell of a pair that comes first is side 0.
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = own.withColumn("s", F.explode(steps)).withColumn("cell", F.xxhash64("space", F.col("x") + F.col("s.dx"), F.col("y") + F.col("s.dy")))
    near = skew_join(near, counts.select("cell", "tiles"), "cell").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when((F.col("s.dx") == 0) & (F.col("s.dy") == 0), (F.col("tile") > F.col("other")).cast("int")).otherwise(((F.col("s.dx") < 0) | (F.col("s.dx") == 0) & (F.col("s.dy") < 0)).cast("int"))
    here = F.struct(F.col("x"), F.col("y"), F.col("tile"))
    there = F.struct((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("other").alias("tile"))
    near = near.withColumn("side", side)
    pair = F.when(F.col("side") == 0, F.to_json(F.array(here, there))).otherwise(F.to_json(F.array(there, here)))
    dealt = near.select(F.concat_ws(" ", "space", pair).alias("key"), (F.to_json(here) == F.to_json(there)).alias("own"), "side", "rep", "weight", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            now = None
            for batch in batches:
                keys = batch.column(0).to_pylist()
                cut = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
                for a, b in zip(cut, cut[1:]):
                    if a == b:
                        continue
                    if keys[a] != now and held:
                        yield pa.Table.from_batches(held)
                        held = []
                    now = keys[a]
                    held.append(batch.slice(a, b - a))
            if held:
                yield pa.Table.from_batches(held)

        for g in groups():
            g = g.combine_chunks()
            v = g.column("v").chunk(0)
            vectors = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            rotation = axes if axes is not None and vectors.shape[1] == dim else None
            out = _block(*(g.column(c).to_numpy() for c in ("rep", "weight", "side")), vectors, g.column("own")[0].as_py(), rotation, threshold)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["rep", "n", "root"])

    found = saved(dealt.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key").mapInArrow(compare, "rep long, n long, root long"))
    component = connected_components(found, "rep", "root")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = classes.select("class", "rep", "weight").join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = skew_join(good.select("vec_id", "class"), known, "class").select("vec_id", "n_links", "component_id")
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
