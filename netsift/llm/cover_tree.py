"""Embedding near-duplicates: dual traversal of a cover tree.

Vectors of one label (and length) are scaled to length one and put into a tree: a node's points go to the nearest of a few
centres, level by level, so radii shrink by halves and more, until a node is small enough for one task. Each node keeps its
centre and its covering radius. The traversal starts with each root against itself and replaces pairs of nodes by pairs of
their children; a pair is pruned when its centres are farther apart than both radii and the threshold distance together,
so no pair of points within the threshold is ever lost. Pairs of leaves that remain compare their points exactly.

Results: each task counts the links of its points and gives out a spanning forest of them, never the pairs, so groups of
any size stay linear. Equal vectors are one class that enters the tree once.

Rows: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing;
vectors of different lengths never link; every row of a repeated vector counts; a null id has no component and is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, store

COSINE = 0.98
LEAF = 6000  # points of a leaf at most
_FAN = 64  # children of a node at most
_SALT = 5000  # points that meet one copy of their node's centres


def _matrix(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    lists = batch.column(batch.schema.get_field_index(name))
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks sorted (node, salt, role): the centres' rows first, then points; each point goes to its nearest centre."""
    block, centres, names = None, [], []
    matrix = np.empty((0, 0))
    for batch in batches:
        get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: B023, E731
        node, salt, role, cls, vectors = get("node"), get("salt"), get("role"), get("cls"), _matrix(batch, "vec")
        out_node, out_child, out_cls, out_far, out_vec = [], [], [], [], []
        at = 0
        while at < len(node):
            if (node[at], salt[at]) != block:
                block, centres, names = (node[at], salt[at]), [], []
            if role[at] == 0:
                centres.append(vectors[at])
                names.append(cls[at])
                matrix = np.array(centres)
                at += 1
                continue
            end = at
            while end < len(node) and role[end] == 1 and (node[end], salt[end]) == block:
                end += 1
            points = np.array(vectors[at:end])
            far = np.sqrt(np.maximum(0.0, ((points[:, None, :] - matrix[None]) ** 2).sum(2))) if len(points) * matrix.size < 4_000_000 else np.sqrt(np.maximum(0.0, 2 - 2 * points @ matrix.T))
            best = far.argmin(1)
            exact = np.sqrt(((points - matrix[best]) ** 2).sum(1))
            out_node += node[at:end]
            out_child += [names[b] for b in best]
            out_cls += cls[at:end]
            out_far += exact.tolist()
            out_vec += vectors[at:end]
            at = end
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_node, pa.int64()), pa.array(out_child, pa.int64()), pa.array(out_cls, pa.int64()), pa.array(out_far, pa.float64()), pa.array(out_vec, pa.list_(pa.float64()))],
            names=["node", "child", "cls", "far", "vec"],
        )


def _leaf_pairs(cosine: float):
    """Of rows sorted (pair, side): all links between two leaves, or inside one (then only side 0 is there)."""

    def links(left: tuple, right: tuple | None):
        ids, weight, points = left
        other_ids, other_weight, other = right or left
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        counts: dict[int, int] = {}
        for at in range(0, len(ids), 1024):
            near = points[at : at + 1024] @ other.T >= cosine
            if right is None:
                near[np.arange(len(near)), np.arange(at, at + len(near))] = False
            rows, cols = np.nonzero(near)
            if not len(rows):
                continue
            for table, keys, index, amount in ((counts, ids, rows + at, other_weight[cols]),) + (((counts, other_ids, cols, weight[rows + at]),) if right is not None else ()):
                total = np.bincount(index, amount, len(keys))
                for k in np.flatnonzero(total):
                    table[int(keys[k])] = table.get(int(keys[k]), 0) + int(total[k])
            starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            for a, b in zip(starts, [*starts[1:], len(rows)]):  # a row of links: all in one component
                own = root(int(ids[rows[a] + at]))
                for c in other_ids[cols[a:b]]:
                    theirs = root(int(c))
                    if theirs != own:
                        low, high = min(own, theirs), max(own, theirs)
                        parent[high] = low
                        own = low
        return [(k, v, root(k)) for k, v in counts.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, sides = None, {}

        def done():
            if 0 not in sides:
                return None
            ready = {s: (np.array(i, np.int64), np.array(w, np.float64), np.array(v)) for s, (i, w, v) in sides.items()}
            out = links(ready[0], ready.get(1))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["cls", "links", "root"])

        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: B023, E731
            for p, s, c, w, v in zip(get("pair"), get("side"), get("cls"), get("weight"), _matrix(batch, "vec")):
                if p != pair:
                    if (made := done()) is not None:
                        yield made
                    pair, sides = p, {}
                held = sides.setdefault(s, ([], [], []))
                held[0].append(c)
                held[1].append(w)
                held[2].append(v)
        if (made := done()) is not None:
            yield made

    return run


def _distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _tree(points: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(points with their leaf, nodes): nodes have node, parent, center, radius."""
    placed = points  # node, cls, weight, vec
    nodes, finished = None, None
    first = placed.groupBy("node").agg(F.count("*").alias("size"), F.min_by("vec", "cls").alias("center"))
    # every point is at most 2 away from any centre on the unit sphere
    level = store(first.select("node", F.lit(None).cast("long").alias("parent"), "center", F.lit(2.0).alias("radius"), "size"), "level")
    while True:
        nodes = level if nodes is None else nodes.union(level)
        big = level.where(F.col("size") > LEAF)
        small = placed.join(level.where(F.col("size") <= LEAF).select("node"), "node")
        finished = small if finished is None else finished.union(small)
        if big.isEmpty():
            return finished, nodes
        fan = F.least(F.lit(_FAN), F.ceil(2 * F.col("size") / LEAF))
        inner = placed.join(big.select("node", "size", "radius", fan.alias("fan")), "node")
        # A node so tight that all its points are linked is dealt out by hash: centres would not tell them apart.
        tight = F.col("radius") <= reach / 2
        by_hash = inner.where(tight).withColumn("child", F.xxhash64("node", F.pmod(F.xxhash64("cls", F.lit(1)), F.ceil(2 * F.col("size") / LEAF)), F.lit("tight")))
        spread = inner.where(~tight)
        draw = F.pmod(F.xxhash64("cls", "node"), F.lit(1 << 30)) / float(1 << 30)
        some = spread.withColumn("draw", draw).where(F.col("draw") < 4 * F.col("fan") / F.col("size"))  # four times the centres, expected
        centres = some.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("draw", "cls"))).where("rank <= fan")
        centres = centres.select("node", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / _SALT) - 1).cast("int"))).alias("salt"), F.lit(0).alias("role"), "cls", F.lit(0).cast("long").alias("weight"), "vec")
        rows = spread.select("node", F.pmod(F.xxhash64("cls", F.lit(2)), F.ceil(F.col("size") / _SALT)).cast("int").alias("salt"), F.lit(1).alias("role"), "cls", "weight", "vec")
        blocks = centres.union(rows).repartition("node", "salt").sortWithinPartitions("node", "salt", "role", "cls")
        moved = blocks.select("node", "salt", "role", "cls", "vec").mapInArrow(_descend, "node long, child long, cls long, far double, vec array<double>")
        moved = moved.join(points.select("cls", "weight"), "cls").withColumn("center_cls", F.col("child")).withColumn("child", F.xxhash64("node", "child"))
        moved = store(moved.select("node", "child", "center_cls", "cls", "far", "weight", "vec").union(by_hash.select("node", "child", F.lit(None).cast("long"), "cls", F.lit(None).cast("double"), "weight", "vec")), "moved")
        found = moved.groupBy("node", "child").agg(F.count("*").alias("size"), F.max("far").alias("far"), F.max_by("vec", F.when(F.col("cls") == F.col("center_cls"), 1).otherwise(0)).alias("center"))
        old = big.select("node", F.col("center").alias("old_center"), F.col("radius").alias("old_radius"))
        kept = F.col("far").isNull()  # dealt by hash: the parent's ball still covers them
        level = store(found.join(old, "node").select(F.col("child").alias("node"), F.col("node").alias("parent"), F.when(kept, F.col("old_center")).otherwise(F.col("center")).alias("center"), F.when(kept, F.col("old_radius")).otherwise(F.col("far") + 1e-9).alias("radius"), "size"), "level")
        placed = moved.select(F.col("child").alias("node"), "cls", "weight", "vec")


def near_duplicates(spark: SparkSession, embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("cls", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("label", "vec")))
    ids = store(rows.select("vec_id", "cls"), "vectors")
    # scaled by the largest component first, so that no square overflows or vanishes
    top = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    scaled = F.transform("vec", lambda x: x / F.col("top"))
    length = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("scaled", lambda x: x / F.col("length"))
    same = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("weight"), F.min("vec_id").alias("rep"), F.min_by("vec", "vec_id").alias("a_vec"), F.first("vec").alias("b_vec"), F.first("label").alias("label"))
    same = same.withColumn("vec", F.coalesce("a_vec", "b_vec")).withColumn("top", top).withColumn("scaled", scaled).withColumn("length", length)
    classes = store(same.select(F.xxhash64("label", F.size("vec")).alias("node"), "cls", "weight", "rep", unit.alias("vec")), "classes")

    points, nodes = _tree(classes.select("node", "cls", "weight", "vec"), reach)
    points, nodes = store(points, "points"), store(nodes, "nodes")
    # Dual traversal: pairs of nodes become pairs of children; a leaf stays itself.
    inner = nodes.where("parent is not null").select(F.col("parent").alias("of"), "node", "center", "radius")
    leaves = nodes.join(inner.select(F.col("of").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("of"), "node", "center", "radius")
    below = store(inner.union(leaves), "below")
    pairs = store(nodes.where("parent is null").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(True).alias("open")), "pairs")
    is_leaf = leaves.select(F.col("node").alias("leaf"))
    while not pairs.where("open").isEmpty():
        left = below.select(F.col("of").alias("a"), F.col("node").alias("a2"), F.col("center").alias("a_center"), F.col("radius").alias("a_radius"))
        right = below.select(F.col("of").alias("b"), F.col("node").alias("b2"), F.col("center").alias("b_center"), F.col("radius").alias("b_radius"))
        step = pairs.where("open").join(left, "a").join(right, "b").where("a <> b or a2 <= b2")
        step = step.where((F.col("a2") == F.col("b2")) | (_distance("a_center", "b_center") <= F.col("a_radius") + F.col("b_radius") + reach))
        step = step.select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        step = step.join(is_leaf.withColumnRenamed("leaf", "a").withColumn("a_leaf", F.lit(True)), "a", "left").join(is_leaf.withColumnRenamed("leaf", "b").withColumn("b_leaf", F.lit(True)), "b", "left")
        step = step.select("a", "b", (F.col("a_leaf").isNull() | F.col("b_leaf").isNull()).alias("open"))
        pairs = store(pairs.where("not open").union(step), "pairs")

    todo = pairs.withColumn("pair", F.xxhash64("a", "b"))
    sides = todo.select("pair", F.col("a").alias("node"), F.lit(0).alias("side")).union(todo.where("a <> b").select("pair", F.col("b").alias("node"), F.lit(1).alias("side")))
    met = points.join(sides, "node").select("pair", "side", "cls", "weight", "vec").repartition("pair").sortWithinPartitions("pair", "side")
    found = store(met.mapInArrow(_leaf_pairs(cosine), "cls long, links long, root long"), "found")
    joined = components(spark, found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))

    group = classes.select("cls", "weight", "rep").join(joined, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls"))
    names = group.groupBy("comp").agg(F.min("rep").alias("name"))
    told = group.join(names, "comp").join(links, "cls", "left").select("cls", "name", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = ids.join(told, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("name", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
