"""Operator 9, embedding near-dedup: cover trees over blocks of vectors, traversed in pairs, for exact pairs above a cosine.

Vectors are scaled to length 1, where the distance d of two has cosine 1 - d * d / 2. Equal vectors are one node with a
number of copies. The top of the tree is the cover tree of a bounded sample (SAMPLE vectors, smallest hashes), cut at its
deepest level of at most GROUPS nodes: each vector belongs to its nearest one there. A node that still holds many vectors
is split by hash into blocks of about BLOCK, and each block is a subtree, built in a task and stored in one row:
nested levels of halving radii (2, 1, 1/2, ...), a node's centre staying its own first child, further children taken
farthest first until all of the node's vectors are within the level's radius, each vector under its nearest child, and
the covering radius measured over all of them. Separation holds inside a block; covering, on which exactness rests,
everywhere.

Two groups meet only if their centres' distance is at most both covering radii and the distance sought. Of groups that
meet, SIDE blocks of the one and SIDE of the other are a small task, which descends each pair of subtrees level by level:
a pair of nodes goes on to its children only if their distance is at most both covering radii and the distance sought,
and at the bottom the vectors of the pairs left are compared. A task returns, for each node, its number of links there and the smallest node of its
piece of the task's graph, which keeps the graph connected without listing pairs.

Where distances concentrate (independent vectors of many dimensions) no covering radius rules anything out above single
vectors; then all pairs of blocks meet, and shuffle grows with n * n / (BLOCK * SIDE). That is the method's own limit.

Vectors that are null, empty, zero or hold null or non-finite parts, and those without vec_id, link with nothing; vectors
of different lengths neither. Huge and tiny parts are scaled before they are squared. Rows that share a vec_id are
vectors of their own. Empty tables give no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from bondsight.llm import shared
from bondsight.llm.components import components

COSINE = 0.95
SAMPLE, BLOCK, GROUPS, ROWS = 4096, 2048, 512, 512
SIDE = 4  # blocks on a side of a task
TOP, LEVELS = 2.0, 7  # the root's radius, and how often it is halved
ROUNDING = np.float32(1e-5)  # of cosines in single precision, with room
SLACK = 1e-6  # a distance from a cosine is exact to about 1e-8
TREE = "team int, block int, nodes binary, copies binary, vectors binary, counts array<int>, parents binary, centres binary, radii binary"


def units(flat: np.ndarray, width: int) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = flat.reshape(-1, width).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors(column: pa.Array, width: int) -> np.ndarray:
    return units(column.flatten().to_numpy(zero_copy_only=False), width) if len(column) else np.zeros((0, width))


def distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def apart(cosine: float) -> float:
    return float(np.sqrt(2 - 2 * cosine)) + SLACK


class Tree:
    """Nested levels over the rows of x, from the root down: each level's centres, covering radii and parents; leaves last.

    A level's arrays are of its nodes; parents[0] is empty of meaning, and parents of the leaves, one a row, close the list.
    """

    def __init__(self, centres: list[np.ndarray], radii: list[np.ndarray], parents: list[np.ndarray]) -> None:
        self.centres, self.radii, self.parents = centres, radii, parents

    @classmethod
    def build(cls, x: np.ndarray, levels: int = LEVELS) -> Tree:
        d = distances(x @ x.T)
        np.fill_diagonal(d, 0)
        members = [np.arange(len(x))]
        centres, radii, parents = [np.zeros(1, np.int32)], [np.array([d[0].max()])], [np.zeros(1, np.int32)]
        radius = TOP
        for _ in range(levels):
            radius /= 2
            if not radii[-1].any():  # every node is a single vector
                break
            own, of, below, far = [], [], [], []
            for k, (centre, some) in enumerate(zip(centres[-1], members, strict=True)):
                picked, near, at = [int(centre)], d[centre, some], np.zeros(len(some), np.int32)
                while near.max() > radius:
                    new = int(some[near.argmax()])
                    closer = d[new, some] < near
                    at[closer] = len(picked)
                    near = np.where(closer, d[new, some], near)
                    picked.append(new)
                for j, c in enumerate(picked):
                    mine = at == j
                    own.append(c)
                    of.append(k)
                    below.append(some[mine])
                    far.append(near[mine].max())
            members = below
            centres.append(np.array(own, np.int32))
            radii.append(np.array(far))
            parents.append(np.array(of, np.int32))
        leaf = np.zeros(len(x), np.int32)
        for k, some in enumerate(members):
            leaf[some] = k
        return cls(centres, radii, [*parents, leaf])

    def at(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres and radii of a level; below the last one, its own."""
        level = min(level, len(self.centres) - 1)
        return self.centres[level], self.radii[level]

    def up(self, level: int) -> np.ndarray:
        return self.parents[level] if level < len(self.centres) else np.arange(len(self.centres[-1]))


def meeting(a: Tree, b: Tree, x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Dual descent: which nodes of both trees' last levels may hold vectors within reach of each other.

    Bounds are compared as cosines in single precision, loosened by more than its rounding.
    """
    x, y = x.astype(np.float32), y.astype(np.float32)
    active = np.ones((1, 1), bool)
    for level in range(max(len(a.centres), len(b.centres))):
        if level:
            active = active[a.up(level)][:, b.up(level)]
        (p, r), (q, s) = a.at(level), b.at(level)
        rows, cols = np.flatnonzero(active.any(1)), np.flatnonzero(active.any(0))
        other, far = y[q[cols]].T, s[cols].astype(np.float32) + np.float32(reach)
        for i in range(0, len(rows), ROWS):
            some = rows[i : i + ROWS]
            bound = r[some, None].astype(np.float32) + far if r[some].any() else far
            near = x[p[some]] @ other >= 1 - bound * bound / 2 - ROUNDING
            if len(cols) == active.shape[1] and len(rows) == len(active):
                active[i : i + ROWS] &= near
            else:
                active[np.ix_(some, cols)] &= near
    return active


def _group(centres: np.ndarray):
    def group(batches):
        for batch in batches:
            x = vectors(batch.column("x"), centres.shape[1])
            best = (x @ centres.T).argmax(1) if len(x) else np.zeros(0, int)
            d = np.linalg.norm(x - centres[best], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("x"), pa.array(best, pa.int32()), pa.array(d)], names=["node", "copies", "x", "team", "far"])

    return group


def _built(width: int):
    def built(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        raw = block["x"].chunk(0).flatten().to_numpy(zero_copy_only=False)
        tree = Tree.build(units(raw, width))
        flat = lambda parts: pa.array([np.concatenate(parts).tobytes()], pa.binary())
        return pa.table({
            "team": block["team"][:1], "block": block["block"][:1], "nodes": flat([block["node"].to_numpy()]), "copies": flat([block["copies"].to_numpy()]), "vectors": flat([raw]),
            "counts": pa.array([[len(c) for c in tree.centres]], pa.list_(pa.int32())), "parents": flat(tree.parents), "centres": flat(tree.centres), "radii": flat(tree.radii),
        })

    return built


def _stored(task: pa.Table, row: int, width: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tree]:
    read = lambda c, t: np.frombuffer(task[c][row].as_py(), t)
    counts = task["counts"][row].as_py()
    cut = np.cumsum(counts)[:-1]
    parents = read("parents", np.int32)
    tree = Tree(np.split(read("centres", np.int32), cut), np.split(read("radii", np.float64), cut), np.split(parents, np.cumsum(counts)))
    return read("nodes", np.int64), read("copies", np.int64), units(read("vectors", kind), width), tree


def _traverse(cosine: float, width: int, kind: type):
    """Links between the blocks of both sides, or inside one side."""

    def traverse(task: pa.Table) -> pa.Table:
        own = {c: task[c].to_numpy() for c in ("p", "q", "i", "j", "team", "block")}
        left, right = (np.flatnonzero((own["team"] == own[t]) & (own["block"] // SIDE == own[n])) for t, n in (("p", "i"), ("q", "j")))
        same = (own["p"] == own["q"]).all() and (own["i"] == own["j"]).all()
        trees = {int(row): _stored(task, int(row), width, kind) for row in range(len(task))}
        found = [_met(trees[int(x)], trees[int(y)], x == y, cosine) for n, x in enumerate(left) for y in (right[n:] if same else right)]
        return pa.concat_tables([_result(*[np.zeros(0, np.int64)] * 3), *found])

    return traverse


def _met(first: tuple, second: tuple, same: bool, cosine: float) -> pa.Table:
    """Links between two blocks, or (same) inside one."""
    (nodes_a, copies_a, x, a), (nodes_b, copies_b, y, b) = first, second
    active = meeting(a, b, x, y, apart(cosine))
    n, shift = len(x), 0 if same else len(x)
    node = nodes_a if same else np.concatenate([nodes_a, nodes_b])
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    rows, cols = np.flatnonzero(active.any(1)[a.parents[-1]]), np.flatnonzero(active.any(0)[b.parents[-1]])
    edges = []
    for i in range(0, len(rows), ROWS):
        own = rows[i : i + ROWS]
        hit = (x[own] @ y[cols].T >= cosine) & active[np.ix_(a.parents[-1][own], b.parents[-1][cols])]
        if same:
            hit &= own[:, None] != cols
        if hit.any():
            links[own] += hit @ copies_b[cols]
            if not same:
                links[n + cols] += hit.T @ copies_a[own]
            edges += _bridges(hit, own, cols + shift)
    p, q = np.concatenate(edges, 1) if edges else (root[:0], root[:0])
    while len(p):
        low = np.minimum(root[p], root[q])
        was = root.copy()
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        root = root[root]
        if np.array_equal(root, was):
            break
    with_ = links > 0
    return _result(node[with_], links[with_], node[root[with_]])


def _bridges(hit: np.ndarray, own: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """A forest that joins what `hit` joins: rows and columns take the smallest label until nothing changes."""
    rows, cols = np.arange(len(own)), np.full(len(other), len(own))
    edges = []
    while True:
        new_cols = np.minimum(cols, np.where(hit, rows[:, None], len(own)).min(0))
        new_rows = np.minimum(rows, np.where(hit, new_cols[None, :], len(own)).min(1))
        if np.array_equal(new_rows, rows) and np.array_equal(new_cols, cols):
            break
        rows, cols = new_rows, new_cols
    linked, back = hit.any(1), hit.any(0)
    edges.append(np.stack([own[linked], own[rows[linked]]]))
    edges.append(np.stack([other[back], own[cols[back]]]))
    return edges


def _result(node, links, root) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})


def _links(nodes: DataFrame, width: int, cosine: float, kind: type) -> DataFrame:
    """(node, links, root) of all tasks over nodes(node, copies, x) of one width."""
    some = nodes.orderBy(F.xxhash64("node")).limit(max(1, min(SAMPLE, (64 << 20) // (8 * width)))).select("x").toPandas()["x"]
    x = units(np.concatenate([np.asarray(v) for v in some]), width)
    top = Tree.build(x)
    centres = x[[c for c in top.centres if len(c) <= GROUPS][-1]]
    placed = shared.settle(nodes.mapInArrow(_group(centres), f"node long, copies long, x array<{'float' if kind is np.float32 else 'double'}>, team int, far double"))
    teams = placed.groupBy("team").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas().sort_values("team")
    of, far, blocks = teams["team"].to_numpy(), teams["far"].to_numpy(), (-(-teams["n"] // BLOCK)).to_numpy()
    d = np.linalg.norm(centres[of][:, None] - centres[of][None], axis=2)
    meet = np.argwhere(np.triu(d <= far[:, None] + far[None] + apart(cosine)))
    sides = -(-blocks // SIDE)
    pairs = nodes.sparkSession.createDataFrame([(int(of[i]), int(of[j]), int(sides[i]), int(sides[j])) for i, j in meet], "p int, q int, np int, nq int")
    blocks_of = nodes.sparkSession.createDataFrame([(int(t), int(b)) for t, b in zip(of, blocks, strict=True)], "team int, blocks int")
    placed = placed.join(F.broadcast(blocks_of), "team").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    trees = shared.settle(placed.select("team", "block", "node", "copies", "x").groupBy("team", "block").applyInArrow(_built(width), TREE))
    pairs = F.broadcast(pairs)  # at most GROUPS squared
    own, side = F.struct(*trees.columns).alias("tree"), F.floor(F.col("block") / SIDE).cast("int")
    at = trees.select(own, "team", side.alias("side"))
    left = at.join(pairs, F.col("team") == F.col("p")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    left = left.where((F.col("p") < F.col("q")) | (F.col("side") <= F.col("other"))).select("p", "q", F.col("side").alias("i"), F.col("other").alias("j"), "tree.*")
    right = at.join(pairs, F.col("team") == F.col("q")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("np") - 1)))
    right = right.where((F.col("p") < F.col("q")) | (F.col("other") < F.col("side"))).select("p", "q", F.col("other").alias("i"), F.col("side").alias("j"), "tree.*")
    return left.unionByName(right).groupBy("p", "q", "i", "j").applyInArrow(_traverse(cosine, width, kind), "node long, links long, root long")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each row of embeddings(vec_id, embedding): n_links, component_id, kept."""
    shared.session(embeddings)
    given = embeddings.schema["embedding"].dataType
    kind, part = (np.float32, "float") if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else (np.float64, "double")
    rows = shared.columns(embeddings, vec_id="long", embedding=f"array<{part}>")
    fine = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("embedding", F.when(fine, F.transform("embedding", lambda v: (v + F.lit(0.0)).cast(part))))  # no negative zeros
    nodes = rows.where("embedding is not null").groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = shared.settle(nodes.withColumn("node", F.monotonically_increasing_id()))
    each = nodes.select("node", "copies", F.size("embedding").alias("width"), F.col("embedding").alias("x"))
    found = None
    for (width,) in each.select("width").distinct().collect():
        one = _links(each.where(F.col("width") == width).drop("width"), width, cosine, kind)
        found = one if found is None else found.unionByName(one)
    if found is None:
        links = nodes.select("node", F.lit(0).alias("links"), F.col("least").alias("component"))
    else:
        found = shared.settle(found)
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        each = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = each.groupBy("root").agg(F.min("least").alias("component"))
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        links = each.join(least, "root").join(counts, "node", "left").select("node", F.coalesce("links", F.lit(0)).alias("links"), "component")
    info = nodes.join(links, "node").select(F.col("embedding").alias("_x"), "copies", "links", "component")
    out = rows.join(info, F.col("embedding") == F.col("_x"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
