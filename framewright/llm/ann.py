"""Nearest neighbours by inner product: a forest of random-projection trees and one priority queue over all of them.

A tree projects on one random direction a level and splits every node at the median of a sample. A query descends all
trees at once: the queue holds branches not taken, those whose split lies nearest to the query first, and gives leaves
until enough have been searched. How many are enough is measured on the sample against brute force, so that data with
structure need few leaves and data without it (where no index helps) nearly as many as there are. The candidates in
the leaves are reranked exactly in double precision.

Equal vectors are one row of the index with the smallest ids that have them, so copies never crowd a leaf. Leaves and
the queries of a leaf are dealt to several tasks beyond a fixed number of rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES = 3
LEAF = 1024
#: Rows that trees are fitted to and the search is tuned on, all or about this many.
SAMPLE = 50_000
TUNING_QUERIES = 200
#: Recall aimed at on the sample.
RECALL = 0.96
#: Queries and vectors of a leaf that meet in one task, at most on average.
BLOCK = 16384


class Forest:
    def __init__(self, sample, depth: int, trees: int = TREES, seed: int = 17):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.depth = depth
        d = sample.shape[1]
        self.directions = [rng.normal(size=(d, depth)) / np.sqrt(d) for _ in range(trees)]
        self.splits = []
        for r in self.directions:
            p = sample @ r
            split, node = np.zeros(2**depth - 1), np.zeros(len(sample), np.int64)
            for level in range(depth):
                order = np.lexsort((p[:, level], node))
                first = np.searchsorted(node[order], np.arange(2**level + 1) + 2**level - 1)
                for k in range(2**level):
                    own = p[order[first[k] : first[k + 1]], level]
                    split[2**level - 1 + k] = own[len(own) // 2] if len(own) else 0.0
                node = 2 * node + 1 + (p[:, level] >= split[node])
            self.splits.append(split)

    def leaves(self, x):
        """Leaf of each row in each tree (rows by trees)."""
        import numpy as np

        out = []
        for r, split in zip(self.directions, self.splits):
            p, node = x @ r, np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (p[:, level] >= split[node])
            out.append(node - (2**self.depth - 1))
        return np.stack(out, axis=1)

    def search_order(self, vector, most: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order in which the shared queue gives them, `most` at most."""
        projected = [(vector @ r).tolist() for r in self.directions]
        queue = [(0.0, t, 0, 0) for t in range(len(projected))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < most:
            far, tree, node, level = heapq.heappop(queue)
            p, split = projected[tree], self.splits[tree]
            while level < self.depth:
                gap = p[level] - split[node]
                right = gap >= 0
                heapq.heappush(queue, (far + gap * gap, tree, 2 * node + 1 + (not right), level + 1))
                node = 2 * node + 1 + right
                level += 1
            found.append((tree, node - (2**self.depth - 1)))
        return found


def tune(forest: Forest, sample, k: int, recall: float = RECALL, queries: int = TUNING_QUERIES) -> int:
    """The number of leaves that reach the recall on the sample, the nearest k of each of some of its rows."""
    import numpy as np

    total = len(forest.splits) * 2**forest.depth
    if forest.depth == 0 or len(sample) <= k + 1:
        return total
    leaves, curve, counted = forest.leaves(sample), np.zeros(total + 1), 0
    for q in np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int):
        s = sample @ sample[q]
        s[q] = -np.inf
        best = np.argpartition(-s, k)[:k]
        place = {x: i for i, x in enumerate(forest.search_order(sample[q], total), 1)}
        for b in best:
            curve[min(place[t, int(x)] for t, x in enumerate(leaves[b]))] += 1
            counted += 1
    return int(np.searchsorted(np.cumsum(curve) / counted, recall)) or 1


def clean(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str) -> DataFrame:
    """(id, query, vec: array<double>) of the rows that take part: the id and all components are there and finite, and one isn't 0."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k nearest other rows found, ties to the smaller id.

    Rows that share the query's id count as its own. Vectors that take no part (see clean) are neither queries nor
    candidates; vectors of each length are searched among themselves. An empty table gives an empty result.
    """
    rows = clean(vectors, is_query, id_col, vec_col)
    lengths = [r["d"] for r in rows.groupBy(F.size("vec").alias("d")).agg(F.count_if("query").alias("q")).filter("q > 0").orderBy("d").collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_nearest(rows.filter(F.size("vec") == d), d, k, trees, leaf, sample, recall) for d in lengths]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, dims: int, k: int, trees: int, leaf: int, sample: int, recall: float) -> DataFrame:
    """nearest() of clean rows of one length."""
    import numpy as np

    rows = materialize(rows.select("id", "query", "vec", F.xxhash64("vec").alias("key"), F.hash("vec").alias("key2")), "ann-rows")
    classes = rows.groupBy("key", "key2").agg(F.min(F.struct("id", "vec")).alias("m"), F.max("query").alias("query"), F.count("*").alias("n"))
    classes = materialize(classes.select("key", "key2", F.col("m.id").alias("cid"), F.col("m.vec").alias("vec"), "query", "n"), "ann-classes")
    members = _members(rows, classes, k + 1)
    total, n_queries = classes.agg(F.count("*"), F.count_if("query")).head()

    share = int(1e9 * min(1.0, sample / max(1, total)))  # about `sample` vectors, without sorting any
    picked = classes.filter(F.pmod(F.xxhash64("cid"), F.lit(10**9)) < share).select("cid", "vec").toArrow().sort_by("cid")["vec"].combine_chunks()
    fitted = picked.flatten().to_numpy().reshape(-1, dims)
    depth = max(0, int(np.ceil(np.log2(min(total / leaf, len(fitted) / 16)))) if total > leaf else 0)
    forest = Forest(fitted, depth, trees)
    probes = tune(forest, fitted, min(k, len(fitted) - 1) or 1, recall)
    n_leaves = trees * 2**depth
    query_parts = max(1, -(-n_queries * probes // (n_leaves * BLOCK)))
    vector_parts = max(1, -(-total // (2**depth * BLOCK)))

    index = classes.select("cid", "vec").mapInArrow(_routed(forest, dims, query_parts, vector_parts), "leaf long, cid long, vec binary")
    asked = classes.filter("query").select("cid", "vec").mapInArrow(_asked(forest, dims, probes, query_parts, vector_parts), "leaf long, cid long, vec binary")
    found = asked.groupBy("leaf").cogroup(index.groupBy("leaf")).applyInArrow(_rerank(dims, k + 1), "cid long, found array<struct<s: double, c: long>>")
    # a class comes from each tree at most once, with the same score: its copies are next to each other
    ordered = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, trees * (k + 1))
    best = found.groupBy("cid").agg(F.slice(F.array_distinct(ordered), 1, k + 1).alias("found"))
    best = materialize(best, "ann-found")
    # from classes to rows: s is the negated score, so that ascending order is the contract's
    each = best.select("cid", F.explode("found").alias("f")).select(F.col("cid").alias("q"), F.col("f.s").alias("s"), F.col("f.c").alias("cid"))
    each = each.join(members, "cid", "left").select("q", "s", F.explode(F.coalesce("ids", F.array("cid"))).alias("v"))
    lists = materialize(each.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "v"))), 1, k + 1).alias("near")), "ann-lists")
    queries = rows.filter("query").join(classes.filter("query").select("key", "key2", "cid"), ["key", "key2"]).select("id", "cid").distinct()
    queries = materialize(queries, "ann-queries")
    joined = queries.join(lists, F.col("cid") == F.col("q"))
    near = F.slice(F.filter("near", lambda x: x["v"] != F.col("id")), 1, k)
    out = joined.select(F.col("id").alias("query_id"), F.posexplode(near).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _members(rows: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(cid, ids): of vectors that several rows have, the `most` smallest ids; cut in parts first, so no task sees all rows of a vector."""
    many = rows.select("id", "key", "key2").join(classes.filter("n > 1").select("key", "key2", "cid"), ["key", "key2"]).select("cid", "id").distinct()
    for part in (F.pmod(F.xxhash64("id"), F.lit(64)), F.lit(0)):
        nth = F.row_number().over(Window.partitionBy("cid", "_part").orderBy("id"))
        many = many.withColumn("_part", part).withColumn("_nth", nth).filter(F.col("_nth") <= most).select("cid", "id")
    return materialize(many.groupBy("cid").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-members")


def _matrix(column, dims: int):
    return column.flatten().to_numpy().reshape(-1, dims)


def _made(leaf, cid, data):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(cid, pa.int64()), pa.array(data, pa.binary())], names=["leaf", "cid", "vec"])


def _part(c: int, parts: int) -> int:
    """One of so many parts, whatever regularity ids have."""
    return (c * 0x9E3779B97F4A7C15 >> 24 & 0xFFFFFFFF) % parts


def _routed(forest: Forest, dims: int, query_parts: int, vector_parts: int):
    """Index rows: each vector in its leaf of every tree, once for each part of the queries."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _matrix(part.column("vec"), dims)
                leaves = forest.leaves(x)
                leaf, cid, data = [], [], []
                for c, own, v in zip(part.column("cid").to_pylist(), leaves.tolist(), x):
                    raw = v.astype("<f8").tobytes()
                    for t, y in enumerate(own):
                        base = ((t << forest.depth) + y) * vector_parts + _part(c, vector_parts)
                        for q in range(query_parts):
                            leaf.append(base * query_parts + q)
                            cid.append(c)
                            data.append(raw)
                if leaf:
                    yield _made(leaf, cid, data)

    return run


def _asked(forest: Forest, dims: int, probes: int, query_parts: int, vector_parts: int):
    """Queries: one row for each leaf to search, and each part of its vectors."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                leaf, cid, data = [], [], []
                for c, v in zip(part.column("cid").to_pylist(), _matrix(part.column("vec"), dims)):
                    raw = v.astype("<f8").tobytes()
                    for t, y in forest.search_order(v, probes):
                        for p in range(vector_parts):
                            leaf.append((((t << forest.depth) + y) * vector_parts + p) * query_parts + _part(c, query_parts))
                            cid.append(c)
                            data.append(raw)
                if leaf:
                    yield _made(leaf, cid, data)

    return run


def _rerank(dims: int, most: int):
    """The `most` nearest of a leaf for each query that searches it, as (negated score, class)."""

    def run(asked, index):
        import numpy as np
        import pyarrow as pa

        qid, cid = asked["cid"].to_pylist(), index["cid"].to_numpy()
        out = []
        if qid and len(cid):
            x = np.frombuffer(b"".join(index["vec"].to_pylist()), "<f8").reshape(-1, dims)
            q = np.frombuffer(b"".join(asked["vec"].to_pylist()), "<f8").reshape(-1, dims)
            for at in range(0, len(q), 256):
                own = q[at : at + 256]
                some = np.arange(len(cid))[None].repeat(len(own), 0)
                if len(cid) > most + 4:
                    some = np.argpartition(-(own @ x.T), most + 3, axis=1)[:, : most + 4]
                exact = -(x[some] * own[:, None]).sum(2)  # the same for a pair wherever it is computed
                order = np.lexsort((cid[some], exact), axis=1)[:, :most]
                out.append((np.take_along_axis(exact, order, 1).ravel(), cid[np.take_along_axis(some, order, 1)].ravel()))
        else:
            qid = []
        s, c = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0), np.zeros(0, np.int64))
        cuts = np.arange(len(qid) + 1) * (len(s) // max(1, len(qid)))
        pairs = pa.StructArray.from_arrays([pa.array(s), pa.array(c)], names=["s", "c"])
        return pa.table({"cid": pa.array(qid, pa.int64()), "found": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pairs)})

    return run
