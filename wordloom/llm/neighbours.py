"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts by recursive spectral bisection with
swaps; a small classifier learns the parts and routes any vector: rows to their most probable part,
queries to as many parts as a recall measured on the sample asks for. Within the parts the scores are
exact. Parts are read in blocks of bounded size, so one vector repeated without end fills many blocks
and no task holds a part.

Bounds: the graph and the classifier are fitted on at most ``sample_rows`` vectors, taken by a hash of
their id; a part needs ``PART_SAMPLE`` of them, which bounds the number of parts. Every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

#: Rows of a block of a part, and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
#: Parts at least, and sample vectors that a part needs.
LEAST_PARTS, PART_SAMPLE = 4, 12


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product of each row."""
    found = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        found[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return found


def halve(rows: np.ndarray, graph: np.ndarray, rng: np.random.Generator, rounds: int = 60, passes: int = 4) -> np.ndarray:
    """One side of a balanced cut of the graph among ``rows``: the second eigenvector, then swaps."""
    local = np.full(len(graph), -1)
    local[rows] = np.arange(len(rows))
    a = np.repeat(np.arange(len(rows)), graph.shape[1])
    b = local[graph[rows].ravel()]
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    n = len(rows)
    degree = np.bincount(a, minlength=n) + 1e-9
    root = np.sqrt(degree)
    v = rng.standard_normal(n)
    top = root / np.linalg.norm(root)
    for _ in range(rounds):
        v -= top * (top @ v)
        v = v + np.bincount(a, weights=(v / root)[b], minlength=n) / root
        v /= np.linalg.norm(v) + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    for _ in range(passes):  # swap equally many rows that would rather be across
        here = np.bincount(a, weights=(side[a] == side[b]), minlength=n)
        gain = degree - 2 * here
        left, right = (np.flatnonzero((side == s) & (gain > 0)) for s in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right)) // 2
        if not m:
            break
        side[left[:m]], side[right[:m]] = True, False
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 11) -> np.ndarray:
    rng, label = np.random.default_rng(seed), np.zeros(len(graph), np.int64)

    def cut(rows: np.ndarray, first: int, number: int) -> None:
        if number == 1 or len(rows) < 2:
            label[rows] = first
            return
        side = halve(rows, graph, rng)
        cut(rows[~side], first, number // 2)
        cut(rows[side], first + number // 2, number - number // 2)

    cut(np.arange(len(graph)), 0, parts)
    return label


@dataclass
class Router:
    """One hidden layer; trained on how a vector's neighbours spread over the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 25, seed: int = 5) -> Router:
        rng = np.random.default_rng(seed)
        scale = 1 / max(1e-9, float(np.sqrt((x**2).mean() * x.shape[1])))
        net = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2) * scale, np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * np.sqrt(1 / hidden), np.zeros(target.shape[1])]
        m, s, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 256):
                at = order[a : a + 256]
                z = x[at] @ net[0] + net[1]
                h = np.maximum(z, 0)
                o = h @ net[2] + net[3]
                p = np.exp(o - o.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - target[at]) / len(at)
                back = (d @ net[2].T) * (z > 0)
                grads = [x[at].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    net[i] -= 0.004 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        return cls(*net)


def fit_router(x: np.ndarray, parts: int, goal: float, graph_k: int = 10, near: int = 20) -> Router:
    """Cuts, trains, and sets the probes to the least that finds ``goal`` of the sample's true neighbours.

    Probes are measured on a fifth of the sample that the classifier has not seen.
    """
    near = min(near, len(x) - 1)
    graph = neighbour_graph(x, max(near, min(graph_k, len(x) - 1)))
    label = balanced_parts(graph[:, :graph_k], parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += graph.shape[1]
    target /= target.sum(axis=1, keepdims=True)
    test = np.arange(len(x)) % 5 == 0
    router = Router.fit(x[~test], target[~test])
    part = router.logits(x).argmax(axis=1)  # as rows will be placed
    order = np.argsort(-router.logits(x[test]), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(order), 0), axis=1)
    depth = np.take_along_axis(place, part[graph[test]], axis=1)
    for probes in range(1, parts + 1):
        router.probes = probes
        if (depth < probes).mean() >= goal:
            break
    return router


def floats(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def best_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> pa.Table:
    """Exact best ``k`` rows of the block for each query, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, first, same = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    by_vector = np.argsort(same, kind="stable")
    bounds = np.searchsorted(same[by_vector], np.arange(len(first) + 1))
    kinds = x[first]
    out = []
    for a in range(0, len(q), 256):
        rough = q[a : a + 256] @ kinds.T
        top = min(k + 1, len(kinds))
        least = -np.partition(-rough, top - 1, axis=1)[:, top - 1]
        slack = 1e-9 * (1 + np.abs(rough).max(axis=1))
        for i, (row, cut) in enumerate(zip(rough, least - slack, strict=True), a):
            near = np.flatnonzero(row >= cut)
            exact = (kinds[near] * q[i]).sum(axis=1)
            # of equal vectors only the smallest ids can be in a result
            member = [by_vector[bounds[c] : bounds[c + 1]][: k + 1] for c in near]
            score, member = np.repeat(exact, [len(m) for m in member]), np.concatenate(member)
            other = ids[member] != query_ids[i]
            score, member = score[other], member[other]
            best = np.lexsort((ids[member], -score))[:k]
            out.append((np.full(len(best), query_ids[i]), ids[member[best]], score[best]))
    if not out:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = 6144, part_rows: int = 4096, goal: float = 0.97) -> DataFrame:
    """The ``k`` rows of ``vectors`` of largest inner product found for each row of ``queries``.

    Returns ``query_id, rank, vec_id, score``; a query is not its own neighbour (rows of its id are not
    candidates). Rows without an id and vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do vectors of another length than the commonest (the longest of those).
    Rows repeated under one id count once each. The table is always cut into parts, four at least; only where the
    sample has fewer than 24 different vectors is there nothing to cut. A query whose most probable parts hold
    too few rows goes on to further parts, so it has ``k`` results if there are as many candidates. An empty table gives no rows; other columns are ignored.
    """
    spark, store = vectors.sparkSession, Store(vectors.sparkSession, "neighbours")

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        fine = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(fine)

    rows = sound(vectors)
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = sizes[0]
    rows, asked = rows.where(F.size("v") == width), sound(queries).where(F.size("v") == width)
    kept = int(min(1.0, sample_rows / total) * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= kept).dropDuplicates(["v"]).orderBy("id").limit(sample_rows).collect()
    parts = max(1, min(max(LEAST_PARTS, -(-total // part_rows)), len(sample) // PART_SAMPLE))
    router = fit_router(np.array([r.v for r in sample]), parts, goal) if parts > 1 else None

    def routed(counts: np.ndarray | None):
        """Rows go to their most probable part; queries to ``probes`` parts, and on until these hold ``k`` other rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                order = np.zeros((n, 1), np.int64) if router is None else np.argsort(-router.logits(floats(batch.column(1), width)), axis=1, kind="stable")
                if counts is None:
                    part, at = order[:, 0], np.arange(n)
                else:
                    before = np.cumsum(counts[order], axis=1) - counts[order]
                    use = (np.arange(order.shape[1]) < (router.probes if router else 1)) | (before <= k)
                    part, at = order[use], np.repeat(np.arange(n), use.sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(part.astype(np.int32))], names=["id", "v", "part"])

        return run

    kind = "id long, v array<double>, part int"
    index = store.put(rows.mapInArrow(routed(None), kind), "index")
    held = np.zeros(parts, np.int64)
    for part, n in index.groupBy("part").count().collect():  # a row for each part
        held[part] = n
    probes = store.put(asked.mapInArrow(routed(held), kind), "probes")
    # blocks of a part: as many as its own counts ask for (a row per part)
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    split = blocks(index, BLOCK_ROWS, "row_blocks").join(blocks(probes, BLOCK_QUERIES, "query_blocks"), "part")
    plan = F.broadcast(split)  # at most sample_rows / PART_SAMPLE rows
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(plan, "part").select("part", block("row_blocks").alias("rb"), every("query_blocks").alias("qb"), "id", "v")
    right = probes.join(plan, "part").select("part", every("row_blocks").alias("rb"), block("query_blocks").alias("qb"), "id", "v")

    def rerank(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        get = lambda t: (t.column("id").to_numpy(), floats(t.column("v").combine_chunks(), width)) if t.num_rows else (np.zeros(0, np.int64), np.zeros((0, width)))
        (ids, x), (query_ids, q) = get(a), get(b)
        if not len(ids) or not len(q):
            q, query_ids = q[:0], query_ids[:0]
        return best_of_block(ids, x, query_ids, q, k) if len(q) else best_of_block(np.zeros(0, np.int64), np.zeros((0, width)), query_ids, q, k)

    keys = ("part", "rb", "qb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
