"""Near-duplicate vectors by an epsilon grid order join.

Cosine >= t of unit vectors is Euclidean distance <= eps = sqrt(2 - 2t). Projecting on orthonormal directions never
lengthens a distance, so two vectors whose projections on the leading principal directions lie further than
eps apart cannot link. The centred vectors are sorted by their grid cells (side eps / 4, at least 1/32) on those directions, the
sequence is cut into blocks, block pairs whose bounding boxes lie further than eps apart are skipped, and every other
pair is joined by halving both intervals again and again, skipping distant halves, down to leaves. In a leaf the
projections of all its pairs are compared first, and only pairs not further apart than eps there have their cosine
computed, in double precision. In many dimensions boxes hide what projections show: there the leaves do the skipping.

Equal vectors are one class, joined once. A block pair gives a count and a root for each class it links, not its
links, so a group of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import connected_components, settled

#: Numbers in a block: 16384 vectors of 64, fewer longer ones.
BLOCK_VALUES = 1 << 20
LEAF = 128
#: Principal directions of the bounding boxes and of the filter in the leaves, and of the grid.
LEADING, GRID = 16, 9
#: What rounding in single precision may add to a squared distance of projections.
SLACK = 1e-4
#: Vertices of the graph: a class's smallest vec_id, or one beyond all of them for a class that has none.
VERTEX = "decimal(20,0)"
UNNAMED = Decimal(1 << 63)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths, scaled first so that no square overflows or vanishes."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _principal(classes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, (dim, k) leading principal directions) of all unit vectors: sums and sums of products by task, added up by cell."""

    def partial(batches):
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            if batch.num_rows:
                v = unit(_matrix(batch.column(0), dim))
                v = np.concatenate([v, np.ones((len(v), 1))], 1)
                total += v.T @ v
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    rows = classes.select("vector").mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect()
    total = np.zeros((dim + 1) ** 2)
    for cell, value in rows:
        total[cell] = value
    total = total.reshape(dim + 1, dim + 1) / max(1.0, total[-1])
    mean = total[-1, :-1]
    _, directions = np.linalg.eigh(total[:-1, :-1] - np.outer(mean, mean))
    return mean, np.ascontiguousarray(directions[:, ::-1][:, : min(LEADING, dim)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _distant(lo_a, hi_a, lo_b, hi_b, eps: float) -> bool:
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return bool(gap @ gap > eps * eps)


def _near(a: tuple, b: tuple, i: int, j: int, k: int, m: int, threshold: float, eps: float) -> tuple[np.ndarray, int]:
    """(which pairs of a leaf link, pairs whose cosine was computed): the projections tell most pairs apart."""
    p, q = a[3][i:j], b[3][k:m]
    apart = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)
    rows, columns = np.nonzero(apart <= eps * eps + SLACK)
    if 4 * len(rows) > (j - i) * (m - k):
        return a[1][i:j] @ b[1][k:m].T >= threshold, (j - i) * (m - k)
    near = np.zeros((j - i, m - k), bool)
    if len(rows):
        near[rows, columns] = np.einsum("nd,nd->n", a[1][i:j][rows], b[1][k:m][columns]) >= threshold
    return near, len(rows)


def side_of(projections: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> tuple:
    """A side of join_intervals, in grid order."""
    return projections, vectors, weights, projections.astype(np.float32)


def join_intervals(a: tuple, b: tuple | None, threshold: float, eps: float, tally: dict | None = None):
    """Weighted link counts of both sides, and star edges between their positions (b's follow a's).

    `b` None joins `a` with itself. Recursive: an interval pair is dropped if the bounding boxes of its projections are
    distant, else the longer interval is halved. `tally` counts point pairs: all, skipped by boxes, skipped by points.
    """
    same = b is None
    b = a if same else b
    n_a = len(a[0])
    links = [np.zeros(n_a, np.int64), np.zeros(len(b[0]), np.int64)]
    edges: list[np.ndarray] = []
    boxes: list[dict] = [{}, {}]
    boxed = pointed = every = 0

    def box(side: int, lo: int, hi: int):
        key = (lo, hi)
        if key not in boxes[side]:
            p = (a, b)[side][0][lo:hi]
            boxes[side][key] = (p.min(0), p.max(0))
        return boxes[side][key]

    todo = [(0, n_a, 0, len(b[0]))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m or (same and m <= i):
            continue
        if _distant(*box(0, i, j), *box(1, k, m), eps):
            boxed += (j - i) * (m - k)
        elif j - i <= LEAF and m - k <= LEAF:
            every += (j - i) * (m - k)
            near, computed = _near(a, b, i, j, k, m, threshold, eps)
            pointed += (j - i) * (m - k) - computed
            if same and i == k:
                near = np.triu(near, 1)
            if not near.any():
                continue
            links[0][i:j] += near @ b[2][k:m]
            links[1][k:m] += a[2][i:j] @ near
            edges.append(_stars(near, i, k + (0 if same else n_a)))
        elif j - i >= m - k:
            # Halving at a multiple of LEAF keeps the leaves of a self join on its diagonal.
            half = i + max(LEAF, (j - i) // 2 // LEAF * LEAF)
            todo += [(i, half, k, m), (half, j, k, m)]
        else:
            half = k + max(LEAF, (m - k) // 2 // LEAF * LEAF)
            todo += [(i, j, k, half), (i, j, half, m)]
    if tally is not None:
        for name, n in (("pairs", every + boxed), ("boxes", boxed), ("points", pointed)):
            tally[name] = tally.get(name, 0) + n
    if same:
        links = [links[0] + links[1], None]
    return links[0], links[1], (np.concatenate(edges) if edges else np.zeros((0, 2), np.int64))


def _stars(near: np.ndarray, row_at: int, column_at: int) -> np.ndarray:
    """For a leaf's links: an edge from each linked position to the smallest one of its component there."""
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    near = near[np.ix_(rows, columns)]
    r, c = rows + row_at, columns + column_at
    top = np.iinfo(np.int64).max
    low_r, low_c = r.copy(), c.copy()
    while True:
        new_c = np.minimum(low_c, np.where(near, low_r[:, None], top).min(0))
        new_r = np.minimum(low_r, np.where(near, new_c[None, :], top).min(1))
        if (new_c == low_c).all() and (new_r == low_r).all():
            break
        low_r, low_c = new_r, new_c
    found = np.stack([np.concatenate([r, c]), np.concatenate([low_r, low_c])], 1)
    return found[found[:, 0] != found[:, 1]]


def _roots(n: int, edges: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches."""
    root = np.arange(n)
    while len(edges):
        before = root.copy()
        low = np.minimum(root[edges[:, 0]], root[edges[:, 1]])
        np.minimum.at(root, edges[:, 0], low)
        np.minimum.at(root, edges[:, 1], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _blocks(classes: DataFrame, mean: np.ndarray, directions: np.ndarray, dim: int, eps: float) -> DataFrame:
    """The classes in grid order, packed: block, cells lo and hi on the first direction, lo, hi, cls, node, named, n, vectors."""
    k, side = min(GRID, directions.shape[1]), max(eps / 4, 1 / 32)

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                p = (unit(_matrix(batch.column(3), dim)) - mean) @ directions
                cell = np.floor(p / side).astype(np.int64)
                packed = np.zeros(len(p), np.int64)
                for d in range(k):  # |p| <= 2, so seven bits hold a cell
                    packed = packed << 7 | np.clip(cell[:, d] + 64, 0, 127)
                yield pa.record_batch([*batch.columns, pa.array(packed)], names=["cls", "node", "n", "vector", "key"])

    kind = dict(classes.dtypes)["vector"]
    keyed = classes.select("cls", "node", "n", "vector").mapInArrow(cells, f"cls long, node long, n long, vector {kind}, key long")
    ranked = settled(
        keyed.repartitionByRange("key", "cls")
        .sortWithinPartitions("key", "cls")
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    counts = sorted(ranked.groupBy("part").count().collect())
    # One number for each partition of the sort, as many as the session has shuffle partitions.
    begins, at = {}, 0
    for part, n in counts:
        begins[part] = at
        at += n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in begins.items() for x in pair]).cast("map<int,bigint>"), F.col("part"))
    numbered = ranked.withColumn("seq", F.col("place") + offset).withColumn("block", F.expr(f"seq div {max(64, BLOCK_VALUES // dim)}"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        vectors = np.asarray(pa.concat_arrays(table["vector"].chunks).flatten()).reshape(-1, dim)
        p = (unit(vectors) - mean) @ directions
        whole = lambda name: table[name].to_numpy()
        first = np.floor(p[:, 0] / eps)
        return pa.table(
            {
                "block": pa.array([whole("block")[0]]),
                "cell_lo": pa.array([int(first.min())]),
                "cell_hi": pa.array([int(first.max())]),
                "lo": pa.array([p.min(0).tolist()], pa.list_(pa.float64())),
                "hi": pa.array([p.max(0).tolist()], pa.list_(pa.float64())),
                "cls": pa.array([whole("cls").astype(np.int64).tobytes()]),
                "node": pa.array([table["node"].fill_null(0).to_numpy().astype(np.int64).tobytes()]),
                "named": pa.array([table["node"].is_valid().to_numpy().tobytes()]),
                "n": pa.array([whole("n").astype(np.int64).tobytes()]),
                "vectors": pa.array([vectors.astype(np.float64 if vectors.dtype == np.float64 else np.float32).tobytes()]),
            }
        )

    schema = "block long, cell_lo long, cell_hi long, lo array<double>, hi array<double>, cls binary, node binary, named binary, n binary, vectors binary"
    return settled(numbered.select("block", "seq", "cls", "node", "n", "vector").groupBy("block").applyInArrow(packed, schema))


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: block pairs whose bounding boxes are not provably distant.

    Equi-join of the cells on the first direction, in which the blocks lie one after the other, with their neighbours.
    """
    own = blocks.select("block", "lo", "hi", F.explode(F.sequence("cell_lo", "cell_hi")).alias("cell"))
    other = blocks.select(
        F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(F.col("cell_lo") - 1, F.col("cell_hi") + 1)).alias("cell")
    )
    gap = F.zip_with(
        F.zip_with("lo", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    return (
        own.join(other, "cell").where(F.col("block") <= F.col("b")).where(apart <= eps * eps).select(F.col("block").alias("a"), "b").distinct()
    )


def _links(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(cls, node, links, root_cls, root): for each class and block pair that links it, copies linked and a class of its component; null nodes stay null."""
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    mean, directions = _principal(classes, dim)
    blocks = _blocks(classes, mean, directions, dim, eps)
    pairs = settled(_block_pairs(blocks, eps))
    sides = pairs.select("a", "b", F.col("a").alias("block")).union(pairs.where("a <> b").select("a", "b", F.col("b").alias("block")))
    dealt = sides.join(blocks.select("block", "cls", "node", "named", "n", "vectors"), "block")

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        read = []
        for row in table.to_pylist():
            n = np.frombuffer(row["n"], np.int64)
            raw = row["vectors"]
            v = unit(np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(n) else np.float64).reshape(-1, dim))
            names = np.frombuffer(row["cls"], np.int64), np.frombuffer(row["node"], np.int64), np.frombuffer(row["named"], bool)
            read.append((names, side_of((v - mean) @ directions, v, n)))
        first, second = read[0], read[1] if len(read) > 1 else None
        links_a, links_b, edges = join_intervals(first[1], second and second[1], threshold, eps)
        (cls, node, named), links = first[0], links_a
        if second:
            cls, node, named, links = (np.concatenate(x) for x in (*zip(first[0], second[0], strict=True), (links_a, links_b)))
        some = np.flatnonzero(links > 0)
        root = _roots(len(cls), edges)[some]
        ids = lambda at: pa.array(node[at], mask=~named[at])
        return pa.table({"cls": cls[some], "node": ids(some), "links": links[some], "root_cls": cls[root], "root": ids(root)})

    return settled(dealt.groupBy("a", "b").applyInArrow(join, "cls long, node long, links long, root_cls long, root long"))


def _vertex(node: str, cls: str) -> Column:
    return F.coalesce(F.col(node).cast(VERTEX), (F.col(cls).cast("decimal(19,0)") + F.lit(UNNAMED)).cast(VERTEX))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of `vectors`.

    Links join vectors of one length with cosine >= `threshold`, in double precision; all are found. n_links counts
    the other rows linked directly, component_id is the smallest vec_id reachable, kept says it is its own.
    Vectors that are null, empty, zero, or hold a null, NaN or infinity link with nothing, nor do vectors of different
    lengths. Repeated rows are copies of each other; rows that share a vec_id but not the vector are one node of
    the graph. A null vec_id gets a null component unless it reaches another, and counts as kept. Other columns are
    not read; an empty table gives none.
    """
    v = F.col("vector")
    usable = (
        v.isNotNull()
        & (F.size(v) > 0)
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    )
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    keyed = rows.select(
        "vec_id",
        F.when(F.col("usable"), F.col("vector")).alias("vector"),
        F.when(F.col("usable"), F.xxhash64("vector")).alias("h1"),
        F.when(F.col("usable"), F.xxhash64(F.lit(41), "vector")).alias("h2"),
    )
    classes = settled(
        keyed.where("vector IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("vector").alias("vector"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    linked = None
    for (dim,) in sorted(classes.select(F.size("vector")).distinct().collect()):
        found = _links(classes.where(F.size("vector") == dim), dim, threshold)
        linked = found if linked is None else linked.union(found)
    if linked is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    # A vec_id in several classes makes them one node.
    named = keyed.where("vector IS NOT NULL AND vec_id IS NOT NULL").groupBy("vec_id")
    many = named.agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi").select("vec_id")
    same = keyed.join(many, "vec_id").join(classes.select("h1", "h2", "node"), ["h1", "h2"])
    edges = linked.select(_vertex("node", "cls").alias("a"), _vertex("root", "root_cls").alias("b"))
    edges = edges.union(same.select(F.col("vec_id").cast(VERTEX), F.col("node").cast(VERTEX)))
    components = connected_components(edges).withColumnRenamed("node", "vertex")
    least = F.when(F.col("component") < F.lit(UNNAMED), F.col("component").cast("long"))
    by_class = (
        classes.select("h1", "h2", "cls", "node", "n", _vertex("node", "cls").alias("vertex"))
        .join(counts, "cls", "left")
        .join(components, "vertex", "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce(least, "node").alias("component_id"))
    )
    component = F.coalesce("component_id", "vec_id")
    return keyed.join(by_class, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
