"""Embedding near-dedup: all pairs of close vectors by a dual traversal of cover trees.

Vectors of one label are compared by cosine, as distances between points of the unit sphere. A cover tree
has nested levels: a node's children are centres chosen from its points so that each point is within half
the radius of one, the node's own centre first. Two trees are walked together: a pair of nodes is dropped
if their centres are farther apart than the threshold and both covering radii, accepted whole if even
their farthest points are close, and split otherwise; what is left at the leaves is computed in doubles.

A label of more than `block` vectors is dealt by the top levels of such a tree: centres are the nodes of a
cover tree of about SAMPLE of its vectors, every vector goes to its nearest centre, and a node's covering
radius is the farthest of all its vectors, so it bounds them however the sample fell. Two nodes meet only if
their centres are no farther apart than the threshold and both radii; only then are their vectors copied to
each other, in blocks of about `block`. A task builds the trees of two blocks and walks them, so no task holds
a label. Where vectors have no near neighbours at all and no clusters, as random ones of many dimensions, radii
are too large to part nodes, and a label's work is the square of its blocks.

Equal vectors are collapsed first and count by their number. A task returns counts and a spanning forest of
its links, never the pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those with a
null label or id, link with nothing and keep their row; vectors of different lengths don't link; rows that
share an id are one node of the links; an empty table gives no rows; other columns pass through, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, components, fresh, joined, table

LEAF = 24
#: About so many vectors of a label give its centres.
SAMPLE = 4096
#: Vectors that a task holds against the centres.
CHUNK = 16384
#: What bounds on distances allow for rounding.
SLACK = 1e-7


class Tree:
    """A cover tree of unit vectors; nodes are numbers, points[n] the places of a node's points."""

    def __init__(self, units: np.ndarray):
        self.units = units
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.points: list[np.ndarray] = []
        self.children: list[np.ndarray | None] = []
        every = np.arange(len(units))
        todo = [self.node(0, every, self.far(0, every), 2.0)]
        while todo:
            n, reach = todo.pop()
            if len(self.points[n]) <= LEAF or self.radius[n] == 0:
                continue
            reach = min(reach, self.radius[n] * 1.000001) / 2
            kids = self.split(self.centre[n], self.points[n], reach)
            self.children[n] = np.array([k for k, _ in kids])
            todo += kids

    def split(self, centre: int, points: np.ndarray, reach: float) -> list[tuple[int, float]]:
        """Nodes of the points: each belongs to the first centre within reach; a point that none covers is the next centre."""
        kids = []
        rest = np.concatenate([[centre], points[points != centre]])
        while len(rest):
            some = self.units[rest[:256]]
            apart = distance(some @ some.T) <= reach
            chosen, open_ = [], np.ones(len(some), bool)
            for k in range(len(some)):
                if open_[k]:
                    chosen.append(k)
                    open_ &= ~apart[k]
                    open_[k] = False
            away = distance(self.units[rest] @ some[chosen].T)
            near = away <= reach
            near[chosen, np.arange(len(chosen))] = True
            taken, owner = near.any(1), near.argmax(1)
            owner[chosen] = np.arange(len(chosen))  # a centre is its own
            order = np.flatnonzero(taken)[np.argsort(owner[taken], kind="stable")]
            edges = np.searchsorted(owner[order], np.arange(len(chosen) + 1))
            for j, c in enumerate(rest[chosen].tolist()):
                mine = order[edges[j] : edges[j + 1]]
                kids.append(self.node(c, rest[mine], away[mine, j], reach))
            rest = rest[~taken]
        return kids

    def top(self, most: int) -> list[int]:
        """Centres of the upper levels: the widest node is split for as long as there are fewer than `most`."""
        nodes = [0]
        while len(nodes) < most:
            wide = max((n for n in nodes if self.children[n] is not None), key=lambda n: self.radius[n], default=None)
            if wide is None:
                break
            nodes.remove(wide)
            nodes += self.children[wide].tolist()
        return sorted({self.centre[n] for n in nodes})[: 4 * most]

    def far(self, centre: int, places: np.ndarray) -> np.ndarray:
        return distance(self.units[places] @ self.units[centre])

    def node(self, centre: int, points: np.ndarray, away: np.ndarray, reach: float) -> tuple[int, float]:
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.points.append(points)
        self.children.append(None)
        return len(self.centre) - 1, reach


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Links:
    """Weighted numbers of links, and links that join what all of them join."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count = weights, np.zeros(len(weights), np.int64)
        self.left: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.right: list[np.ndarray] = [np.zeros(0, np.int64)]

    def some(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] with b[i]."""
        np.add.at(self.count, a, self.weights[b])
        np.add.at(self.count, b, self.weights[a])
        self.left.append(a)
        self.right.append(b)

    def all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links each of a with each of b; a star joins them."""
        self.count[a] += self.weights[b].sum()
        self.count[b] += self.weights[a].sum()
        rest = np.concatenate([a[1:], b])
        self.left.append(np.full(len(rest), a[0]))
        self.right.append(rest)

    def roots(self) -> np.ndarray:
        return joined(len(self.weights), np.concatenate(self.left), np.concatenate(self.right))


def products(p: list[np.ndarray], q: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of p[k] with q[k], for all k, one behind the other."""
    sizes_p, sizes_q = np.array([len(x) for x in p]), np.array([len(x) for x in q])
    first, second = np.concatenate(p), np.concatenate(q)
    times = np.repeat(sizes_q, sizes_p)
    a = np.repeat(first, times)
    start = np.repeat(np.repeat(np.cumsum(sizes_q) - sizes_q, sizes_p), times)
    within = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    return a, second[start + within]


def walk(left: Tree, right: Tree, shift: int, links: Links, cosine: float) -> int:
    """Adds all links between two trees, or within one if they are the same; returns the pairs computed."""
    limit, same, computed = float(np.sqrt(2 - 2 * cosine)), left is right, 0
    leaf = [np.array([k is None for k in t.children]) for t in (left, right)]
    centre = [np.array(t.centre) for t in (left, right)]
    radius = [np.array(t.radius) for t in (left, right)]
    size = [np.array([len(p) for p in t.points]) for t in (left, right)]
    todo, leaves = [(0, 0)], []

    def settle() -> None:
        """Computes the pairs of leaves that bounds left open."""
        nonlocal computed
        for k in range(0, len(leaves), 2000):
            part = leaves[k : k + 2000]
            a, b = products([left.points[p] for p, _ in part], [right.points[q] for _, q in part])
            if same:  # a leaf met with itself gives each pair twice
                own = np.repeat([p == q for p, q in part], [len(left.points[p]) * len(right.points[q]) for p, q in part])
                ok = ~own | (a < b)
                a, b = a[ok], b[ok]
            close = np.einsum("ij,ij->i", left.units[a], right.units[b]) >= cosine
            computed += len(a)
            links.some(a[close], b[close] + shift)
        leaves.clear()

    while todo:
        p, q = todo.pop()
        if leaf[0][p] and leaf[1][q]:
            leaves.append((p, q))
            continue
        one = same and p == q
        if leaf[0][p] or (not leaf[1][q] and not one and right.radius[q] > left.radius[p]):
            split_p, split_q = np.array([p]), right.children[q]
        else:
            split_p, split_q = left.children[p], left.children[p] if one else np.array([q])
        units_q = right.units[centre[1][split_q]].T
        for k in range(0, len(split_p), 256):
            rows = split_p[k : k + 256]
            apart = distance(left.units[centre[0][rows]] @ units_q)
            reach = radius[0][rows][:, None] + radius[1][split_q][None, :]
            maybe, surely = apart - reach <= limit + SLACK, apart + reach <= limit - SLACK
            if one:
                maybe, surely = np.triu(maybe, k), np.triu(surely, k + 1)
            i, j = np.nonzero(maybe)
            take = surely[i, j]
            x, y = rows[i], split_q[j]
            many = size[0][x] * size[1][y] > LEAF * LEAF
            for u, v in zip(x[take & many], y[take & many], strict=True):
                links.all(left.points[u], right.points[v] + shift)
            leaves += zip(x[take & ~many].tolist(), y[take & ~many].tolist(), strict=True)  # few points: cheaper computed with others
            todo += list(zip(x[~take].tolist(), y[~take].tolist(), strict=True))
        if len(leaves) > 20_000:
            settle()
    settle()
    return computed


def block_links(ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray, block: np.ndarray, cosine: float) -> pd.DataFrame:
    """(id, links, root) of the vectors of two blocks that link across them, or of one within it."""
    order = np.lexsort((ids, block))
    ids, vectors, weights, block = ids[order], vectors[order], weights[order], block[order]
    units = unit_rows(vectors)
    links, cut = Links(weights), int(np.searchsorted(block, block[0], "right"))
    left = Tree(units[:cut])
    if cut == len(ids):
        walk(left, left, 0, links, cosine)
    else:
        walk(left, Tree(units[cut:]), cut, links, cosine)
    some = np.flatnonzero(links.count)
    return pd.DataFrame({"id": ids[some], "links": links.count[some], "root": ids[links.roots()[some]]})


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def dealt_by_nodes(scratch: Scratch, classes: DataFrame, sizes: DataFrame, cosine: float, block: int, nodes: int) -> tuple[DataFrame, DataFrame]:
    """For labels of several blocks: (label, dim, cid, node), and (label, dim, node, first, blocks, partners: ranges of blocks).

    The blocks of a node are first to first + blocks - 1 of its label's; partners are those of all nodes that may hold a link.
    """
    limit = float(np.sqrt(2 - 2 * cosine))
    large = sizes.filter(F.col("n") > block)
    own = classes.join(large, ["label", "dim"]).withColumn("h", F.xxhash64("v"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        units = unit_rows(np.stack(group["v"].to_numpy()))
        order = np.lexsort(units.T[::-1])
        units = units[order]
        centres = Tree(units).top(min(nodes, int(group["n"].iloc[0]) * 4 // block + 1))
        return pd.DataFrame({"label": group["label"].iloc[0], "dim": group["dim"].iloc[0], "node": np.arange(len(centres)), "centre": list(units[centres])})

    kinds = f"label {classes.schema['label'].dataType.simpleString()}, dim int, node int, centre array<double>"
    sample = own.filter(F.pmod("h", F.col("n")) < SAMPLE).select("label", "dim", "n", "v")
    found = sample.groupBy("label", "dim").applyInPandas(choose, kinds)
    # a label whose sample came out empty is one node, whose centre is any vector
    spare = own.join(found.select("label", "dim").distinct().hint("merge"), ["label", "dim"], "left_anti").groupBy("label", "dim").agg(F.min("v").alias("centre"))
    found = scratch.save(found, "sampled")
    centres = scratch.save(found.unionByName(spare.select("label", "dim", F.lit(0).alias("node"), "centre")), "centres")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    parted = own.select("label", "dim", F.pmod(F.xxhash64("cid"), chunks).cast("int").alias("chunk"), "cid", "v")
    copies = centres.join(large, ["label", "dim"]).select("label", "dim", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "node", "centre")

    def nearest(group: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"label": [], "dim": [], "cid": [], "node": [], "away": []})
        points, middles = unit_rows(np.stack(group["v"].to_numpy())), unit_rows(np.stack(held["centre"].to_numpy()))
        near = (points @ middles.T).argmax(1)
        away = distance(np.einsum("ij,ij->i", points, middles[near]))
        return pd.DataFrame({"label": group["label"].iloc[0], "dim": group["dim"].iloc[0], "cid": group["cid"], "node": held["node"].to_numpy()[near], "away": away})

    key = ["label", "dim", "chunk"]
    kinds = f"label {classes.schema['label'].dataType.simpleString()}, dim int, cid long, node int, away double"
    placed = scratch.save(parted.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(nearest, kinds), "placed")
    wide = placed.groupBy("label", "dim", "node").agg(F.max("away").alias("radius"), F.count("*").alias("n")).join(centres.hint("merge"), ["label", "dim", "node"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        middles = unit_rows(np.stack(group["centre"].to_numpy()))
        radius, blocks = group["radius"].to_numpy(), -(-group["n"].to_numpy() // block)
        first = np.cumsum(blocks) - blocks
        near = distance(middles @ middles.T) <= radius[:, None] + radius[None, :] + limit + SLACK
        near |= near.T
        np.fill_diagonal(near, True)
        partners = [[{"first": int(first[k]), "blocks": int(blocks[k])} for k in np.flatnonzero(row)] for row in near]
        return pd.DataFrame({"label": group["label"], "dim": group["dim"], "node": group["node"], "first": first, "blocks": blocks, "partners": partners})

    kinds = f"label {classes.schema['label'].dataType.simpleString()}, dim int, node int, first int, blocks int, partners array<struct<first: int, blocks: int>>"
    ranges = scratch.save(wide.groupBy("label", "dim").applyInPandas(meet, kinds), "nodes")
    return placed, ranges


def near_vectors(scratch: Scratch, vectors: DataFrame, cosine: float = 0.93, block: int = 8192, nodes: int = 256) -> DataFrame:
    """vectors (vec_id, embedding, label) with n_links, component_id and kept."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    is_sound, whole, own_label, own_class, weight, links, group = fresh(vectors, "sound", "v", "label", "class", "weight", "links", "group")
    rows = vectors.withColumn(is_sound, F.coalesce(sound, F.lit(False)))
    classes = rows.filter(is_sound).groupBy("label", F.size("embedding").alias("dim"), v.alias("v")).agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sizes = scratch.save(classes.groupBy("label", "dim").agg(F.count("*").alias("n")), "sizes")
    keyed = classes
    if sizes.filter(F.col("n") > block).isEmpty():
        dealt = keyed.withColumn("mine", F.lit(0)).withColumn("other", F.lit(0))
    else:
        placed, ranges = dealt_by_nodes(scratch, classes, sizes, cosine, block, nodes)
        keyed = keyed.join(placed.select("cid", "node"), "cid", "left").join(ranges, ["label", "dim", "node"], "left")
        keyed = keyed.withColumn("mine", F.coalesce(F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"), F.lit(0)))
        every = F.flatten(F.transform("partners", lambda p: F.sequence(p["first"], p["first"] + p["blocks"] - 1)))
        dealt = keyed.withColumn("other", F.explode(F.coalesce(every, F.array(F.lit(0)))))
    dealt = dealt.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        if group["low"].iloc[0] != group["high"].iloc[0] and group["mine"].nunique() == 1:  # the other block is empty
            return pd.DataFrame({"id": [], "links": [], "root": []})
        return block_links(group["id"].to_numpy(), np.stack(group["v"].to_numpy()), group["weight"].to_numpy(), group["mine"].to_numpy(), cosine)

    found = dealt.select("label", "dim", "low", "high", "id", "weight", "mine", "v").groupBy("label", "dim", "low", "high").applyInPandas(compare, "id long, links long, root long")
    found = scratch.save(found, "found")
    labels = components(scratch, found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links")).join(labels, "id", "left").select("id", "links", F.coalesce("component", "id").alias("component"))
    of_class = classes.join(counted, "id", "left").select(F.col("label").alias(own_label), F.col("v").alias(whole), F.col("id").alias(own_class), F.col("weight").alias(weight), F.col("links").alias(links), F.col("component").alias(group))
    of_class = scratch.save(of_class, "of_class")
    scratch.drop("classes", "sizes", "found", "sampled", "centres", "placed", "nodes")
    kept = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    good = rows.filter(is_sound).join(of_class.hint("merge"), (v == F.col(whole)) & (F.col("label") == F.col(own_label)), "left")
    component, n = F.coalesce(group, own_class), F.coalesce(links, F.lit(0)) + F.col(weight) - 1
    good = good.select(*kept, n.cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
    # rows that link with nothing don't take part in the join, whose null keys would meet in one task
    rest = rows.filter(~F.col(is_sound)).select(*kept, F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return good.unionByName(rest)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(Scratch(spark, "covertree"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("embedding", "label")


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.93),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id
"""
