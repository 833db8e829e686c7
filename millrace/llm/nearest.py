"""Exact search for the greatest inner products, by cover trees on both sides.

Spark deals the vectors out in blocks. A task indexes a block, data and queries
together, in one cover tree; a pair of a block's data and a block's queries is
then searched by going down both trees at once, and two nodes are left alone if
their radii say that no vector below one can beat the worst score that a query
below the other already has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored, table

SCALE = 256
TOP = 5
EVERY = 50
BLOCK_ROWS = 4096
LEAF = 16
# Below this, sums of products of whole numbers are exact in floating point.
EXACT = 2.0**52


@dataclass
class Tree:
    """Node i covers ``order[start[i]:stop[i]]`` within ``radius[i]`` of ``centre[i]``;
    its children are ``first[i]`` up to ``last[i]``, none for a leaf."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Points of a node are dealt to centres that are over half its radius apart
    and cover all of it within that distance; each becomes a child."""
    order, at = np.arange(len(points)), 0
    start, stop, centres, radii, first, last = [0], [len(points)], [], [], [], []
    while at < len(start):
        own = order[start[at] : stop[at]]
        # The root is at the mean, a child where its first point is.
        centre = points[own].mean(axis=0) if at == 0 and len(own) else centres_of(points, own)
        away = np.sqrt(((points[own] - centre) ** 2).sum(axis=1))
        radius = float(away.max(initial=0.0))
        centres.append(centre)
        radii.append(radius)
        first.append(len(start))
        if len(own) > leaf and radius > 0:
            child = _deal(points[own], radius / 2)
            by_child = np.argsort(child, kind="stable")
            order[start[at] : stop[at]] = own[by_child]
            sizes = np.bincount(child)
            if len(sizes) > 1:
                ends = start[at] + np.cumsum(sizes)
                start += (ends - sizes).tolist()
                stop += ends.tolist()
        last.append(len(start))
        at += 1
    return Tree(
        order, np.array(start), np.array(stop), np.array(centres), np.array(radii),
        np.array(first), np.array(last),
    )


def centres_of(points: np.ndarray, own: np.ndarray) -> np.ndarray:
    return points[own[0]] if len(own) else np.zeros(points.shape[1])


def _deal(points: np.ndarray, reach: float) -> np.ndarray:
    """For each point the number of the first centre within ``reach``; a point
    that no centre reaches becomes one."""
    child = np.full(len(points), -1)
    left = np.arange(len(points))
    number = 0
    squares = (points**2).sum(axis=1)
    while len(left):
        centre = points[left[0]]
        near = squares[left] - 2 * (points[left] @ centre) + centre @ centre <= reach * reach
        near[0] = True
        child[left[near]] = number
        left = left[~near]
        number += 1
    return child


def search(
    queries: np.ndarray,
    query_tree: Tree,
    data: np.ndarray,
    data_tree: Tree,
    worst: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, data)`` whose product may reach ``worst`` of the query.

    Both are kept unless the bound on all products of two nodes,
    c.d + |c| s + |d| r + r s with centres c, d and radii r, s, is below what
    every query of the node has already.
    """
    group_worst = np.array(
        [
            worst[query_tree.order[a:b]].min() if b > a else np.inf
            for a, b in zip(query_tree.start, query_tree.stop, strict=True)
        ]
    )
    query_size = np.sqrt((query_tree.centre**2).sum(axis=1))
    data_size = np.sqrt((data_tree.centre**2).sum(axis=1))
    q, d = np.array([0]), np.array([0])
    found_q, found_d = [], []
    while len(q):
        middle = np.concatenate(
            [
                (query_tree.centre[q[i : i + 65536]] * data_tree.centre[d[i : i + 65536]]).sum(axis=1)
                for i in range(0, len(q), 65536)
            ]
        )
        bound = (
            middle
            + query_size[q] * data_tree.radius[d]
            + data_size[d] * query_tree.radius[q]
            + query_tree.radius[q] * data_tree.radius[d]
        )
        # A little more than the bound, for what rounding takes off it.
        keep = bound + 1e-9 * np.abs(bound) + 1e-6 >= group_worst[q]
        q, d = q[keep], d[keep]
        q_leaf = query_tree.first[q] == query_tree.last[q]
        d_leaf = data_tree.first[d] == data_tree.last[d]
        done = q_leaf & d_leaf
        found_q.append(q[done])
        found_d.append(d[done])
        # Go down on the side with the wider node.
        open_q, open_d = ~q_leaf[~done], ~d_leaf[~done]
        q, d = q[~done], d[~done]
        down_q = open_q & (~open_d | (query_tree.radius[q] >= data_tree.radius[d]))
        q1, d1 = _children(query_tree, q[down_q], d[down_q])
        d2, q2 = _children(data_tree, d[~down_q], q[~down_q])
        q, d = np.concatenate([q1, q2]), np.concatenate([d1, d2])
    return np.concatenate(found_q), np.concatenate(found_d)


def _children(tree: Tree, nodes: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = tree.last[nodes] - tree.first[nodes]
    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(tree.first[nodes], sizes) + offset, np.repeat(beside, sizes)


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(queries.shape[1], 1)
    if most < EXACT:
        return (queries @ data.T).astype(np.int64)
    return queries.astype(np.int64) @ data.astype(np.int64).T


def best(
    query_ids: np.ndarray,
    queries: np.ndarray,
    data_ids: np.ndarray,
    data: np.ndarray,
    top: int,
    worst: np.ndarray | None = None,
) -> list[tuple[int, int, int]]:
    """Per query the ``top`` greatest products in a block: query, data id, score.

    ``worst`` are scores that each query is known to have ``top`` of; what is
    below them is not sought.
    """
    if not len(queries) or not len(data):
        return []
    worst = np.full(len(queries), -np.inf) if worst is None else worst.copy()
    query_tree, data_tree = cover_tree(queries), cover_tree(data)
    # Any ``top`` candidates give each query a first bound on its worst score.
    probe = np.linspace(0, len(data) - 1, min(len(data), 64)).astype(int)
    scores = products(queries, data[probe]).astype(float)
    scores[query_ids[:, None] == data_ids[probe][None, :]] = -np.inf
    if len(probe) >= top:
        worst = np.maximum(worst, -np.partition(-scores, top - 1, axis=1)[:, top - 1])
    pair_q, pair_d = search(queries, query_tree, data, data_tree, worst)
    result = []
    by_query = np.argsort(pair_q, kind="stable")
    pair_q, pair_d = pair_q[by_query], pair_d[by_query]
    cuts = np.flatnonzero(np.diff(pair_q, prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows = query_tree.order[query_tree.start[pair_q[a]] : query_tree.stop[pair_q[a]]]
        near = np.concatenate(
            [data_tree.order[data_tree.start[n] : data_tree.stop[n]] for n in pair_d[a:b]]
        )
        near = near[np.argsort(data_ids[near], kind="stable")]
        for row, found in zip(rows, products(queries[rows], data[near]), strict=True):
            fits = np.flatnonzero((found >= worst[row]) & (data_ids[near] != query_ids[row]))
            # Stable, so of equals the smaller id comes first.
            first = fits[np.argsort(-found[fits], kind="stable")][:top]
            result += [(int(query_ids[row]), int(data_ids[near[i]]), int(found[i])) for i in first]
    return result


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, numbers array<double>, size``: floor(256 x) of each component."""
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    fine = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < 1e15), F.lit(False))
    )
    return vectors.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine
    ).select("vec_id", numbers.alias("numbers"), F.size("embedding").alias("size"))


def _in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Add ``block``: a number below the count of blocks that the rows need."""
    n = rows.count()
    blocks = max(1, math.ceil(n / block_rows))
    return rows.withColumn("block", (F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).cast("int"))


def _as_block(rows, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(rows.column("vec_id").to_pylist(), dtype=np.int64)
    flat = rows.column("numbers").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.astype(float).reshape(len(ids), size)


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _result(rows: list[tuple[int, int, int]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.table([pa.array(c, pa.int64()) for c in columns], schema=RESULT)


def top_products(
    vectors: DataFrame, every: int = EVERY, top: int = TOP, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible
    by ``every`` the ``top`` greatest products with the others.

    Ties go to the smaller id; fewer candidates give fewer rows. Vectors that
    are NULL or hold NULL, NaN, infinite or, as products would not fit, huge
    components (1e15) take no part, nor do rows without an id. Vectors of
    different lengths have no product. Rows that repeat an id are one vector, of
    which one is taken; an id's own rows are never its candidates. Other
    columns are not read.

    First each query is held against the block it lies in, which gives it a
    score to beat; then against the other blocks, each pair of blocks a task.
    """
    whole = stored(
        whole_numbers(vectors).groupBy("vec_id").agg(F.min(F.struct("size", "numbers")).alias("v"))
        .select("vec_id", "v.size", "v.numbers"),
        "vectors",
    )
    data = _in_blocks(whole, block_rows)
    is_query = F.col("vec_id") % every == 0
    schema = "query_id bigint, vec_id bigint, score bigint"

    def at_home(key, rows):
        ids, points = _as_block(rows, key[1].as_py())
        mine = ids % every == 0
        return _result(best(ids[mine], points[mine], ids, points, top))

    home = stored(
        data.groupBy("block", "size").applyInArrow(lambda key, rows: at_home(key, rows), schema),
        "nearest-home",
    )
    worst = home.groupBy("query_id").agg(
        F.when(F.count("*") >= top, F.min("score")).cast("double").alias("worst")
    )
    queries = whole.filter(is_query).join(
        worst, F.col("vec_id") == F.col("query_id"), "left"
    ).select("vec_id", "size", "numbers", "worst")
    # Queries are few, so a block of them meets all blocks of data.
    home_block = data.select("vec_id", F.col("block").alias("home"))
    queries = _in_blocks(queries.join(home_block, "vec_id"), block_rows).withColumnRenamed(
        "block", "query_block"
    )
    blocks = data.select("block", "size").distinct()
    query_blocks = queries.select("query_block", "size").distinct()
    pairs = query_blocks.join(blocks, "size")
    left = queries.join(pairs, ["query_block", "size"])
    right = data.join(pairs, ["block", "size"])
    # New names, as both sides come from the same table.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)

    def apart(key, left_rows, right_rows):
        ids, points = _as_block(right_rows, key[2].as_py())
        block = key[1].as_py()
        left_rows = left_rows.filter(pa.compute.not_equal(left_rows.column("home"), block))
        query_ids, query_points = _as_block(left_rows, key[2].as_py())
        known = np.array(
            [-np.inf if w is None else w for w in left_rows.column("worst").to_pylist()], dtype=float
        )
        return _result(best(query_ids, query_points, ids, points, top, known))

    keys = ["query_block", "block", "size"]
    away = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(lambda key, a, b: apart(key, a, b), schema)
    )
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        home.unionByName(away)
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_top_products(spark, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (
           PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
