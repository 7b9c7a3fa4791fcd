"""Approximate nearest neighbours by inner product: one small-world graph per shard, shard results merged.

Equal vectors are one node that keeps its smallest ids, so a very common vector neither skews a shard nor fills the
graph with ties. Nodes are dealt to shards of about ``SHARD_NODES`` by a hash. A shard is one row of flat arrays: the
vectors, and for each level the neighbours of its nodes as an n x degree matrix. Levels are drawn as in any
hierarchical graph; as a shard is bounded, the candidates for a node's links come from an exact blocked product rather
than from a search, and the diversity rule then picks among them. Inner product becomes distance by one more
coordinate that gives all vectors of a shard the same length. Query blocks meet shards in bounded pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.llm.common import written

SHARD_NODES = 4096
QUERY_GROUP = 4096
LINKS = 16
CANDIDATES = 48
EF = 96
INDEX = "dim int, shard int, n int, vectors binary, ids array<array<bigint>>, members array<binary>, links array<binary>"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding double array): rows with an id and a finite vector that is not all zero, each once."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("embedding")).distinct()


def _lengthened(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in one more dimension whose inner products order as those of ``vectors`` with any query."""
    norm2 = (vectors * vectors).sum(1)
    most = norm2.max()
    return (np.hstack([vectors, np.sqrt(np.maximum(most - norm2, 0))[:, None]]) / np.sqrt(most)).astype(np.float32)


def _layer(x: np.ndarray, degree: int) -> np.ndarray:
    """n x degree neighbour numbers of one level: diverse near nodes, then links back, then the next node in a ring.

    The ring keeps every node within reach. Free places hold the node itself.
    """
    n = len(x)
    own = np.arange(n)
    out = np.repeat(own[:, None], degree, 1).astype(np.int32)
    out[:, -1] = (own + 1) % n
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return out
    half = max(1, degree // 2)
    chosen, near = np.full((n, half), -1, np.int64), np.zeros((n, half), np.float32)
    for at in range(0, n, 256):
        rows = own[at : at + 256]
        like = x[rows] @ x.T
        like[np.arange(len(rows)), rows] = -np.inf
        best = np.argpartition(-like, c - 1, 1)[:, :c]
        score = np.take_along_axis(like, best, 1)
        order = np.argsort(-score, 1, kind="stable")
        best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
        among = x[best] @ x[best].transpose(0, 2, 1)
        taken = np.zeros(best.shape, bool)
        for j in range(c):  # nearer to the node than to every neighbour taken before
            taken[:, j] = ~(taken[:, :j] & (among[:, j, :j] > score[:, j, None])).any(1)
        first = np.argsort(~taken, 1, kind="stable")[:, :half]
        k = first.shape[1]
        chosen[rows, :k] = np.take_along_axis(best, first, 1)
        near[rows, :k] = np.take_along_axis(score, first, 1)
    out[:, :half] = np.where(chosen >= 0, chosen, own[:, None])
    source, slot = np.nonzero(chosen >= 0)
    target = chosen[source, slot]
    order = np.lexsort((-near[source, slot], target))
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    fit = rank < degree - 1 - half
    out[target[fit], half + rank[fit]] = source[fit]
    return out


def _graph(vectors: np.ndarray, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Members and neighbour matrix of each level, the lowest first."""
    n = len(vectors)
    x = _lengthened(vectors)
    level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-300) / np.log(LINKS)).astype(int)
    members, links = [], []
    for l in range(level.max() + 1):
        own = np.flatnonzero(level >= l) if l else np.arange(n)
        members.append(own.astype(np.int32))
        links.append(_layer(x[own], 2 * LINKS if l == 0 else LINKS))
    return members, links


def _search(x: np.ndarray, members: list[np.ndarray], links: list[np.ndarray], q: np.ndarray, ef: int) -> np.ndarray:
    """For each query the numbers of up to ``ef`` near nodes (-1: none), by descent and then a beam on the lowest level."""
    n, rows = len(x), np.arange(len(q))
    at = np.zeros(len(q), np.int64)  # a place in the level above
    for l in range(len(members) - 1, 0, -1):
        own, table = members[l], links[l]
        level = x[own]
        score = np.einsum("ij,ij->i", level[at], q)
        while True:
            near = table[at]
            like = np.einsum("ijk,ik->ij", level[near], q)
            best = like.argmax(1)
            better = like[rows, best] > score
            if not better.any():
                break
            at = np.where(better, near[rows, best], at)
            score = np.where(better, like[rows, best], score)
        at = np.searchsorted(members[l - 1], own[at])
    ids = np.full((len(q), ef), -1, np.int64)
    like = np.full((len(q), ef), -np.inf, np.float32)
    open_ = np.zeros((len(q), ef), bool)
    seen = np.zeros((len(q), n), bool)
    ids[:, 0], like[:, 0], open_[:, 0] = at, np.einsum("ij,ij->i", x[at], q), True
    seen[rows, at] = True
    live = rows
    while len(live):
        best = np.where(open_[live], like[live], -np.inf).argmax(1)
        open_[live, best] = False
        near = links[0][ids[live, best]].astype(np.int64)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        new = np.where(fresh, np.einsum("ijk,ik->ij", x[near], q[live]), -np.inf)
        order = np.argsort(near, 1, kind="stable")  # a node that is listed twice counts once
        twice = np.zeros_like(fresh)
        ordered = np.take_along_axis(near, order, 1)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        new[twice] = -np.inf
        all_like = np.hstack([like[live], new.astype(np.float32)])
        keep = np.argpartition(-all_like, ef - 1, 1)[:, :ef]
        like[live] = np.take_along_axis(all_like, keep, 1)
        ids[live] = np.take_along_axis(np.hstack([ids[live], np.where(new > -np.inf, near, -1)]), keep, 1)
        open_[live] = np.take_along_axis(np.hstack([open_[live], new > -np.inf]), keep, 1)
        live = live[open_[live].any(1)]
    return ids


def build_index(vectors: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The index and its number of shards: one row per shard of ``usable`` vectors, written to the shared folder; each node keeps its k + 1 smallest ids."""
    spread = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(spread)).filter(F.col("r") <= k + 1)
    nodes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.select("embedding", "ids", F.size("embedding").alias("dim")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD_NODES))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by([("first", "ascending")])
        dim, number = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
        own = group.column("embedding").combine_chunks().values.to_numpy().reshape(-1, dim)
        members, links = _graph(own, number)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([number], pa.int32()), "n": pa.array([len(own)], pa.int32()),
            "vectors": pa.array([own.tobytes()], pa.binary()), "ids": pa.array([group.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "members": pa.array([[m.tobytes() for m in members]], pa.list_(pa.binary())), "links": pa.array([[m.tobytes() for m in links]], pa.list_(pa.binary())),
        })

    return written(dealt.withColumn("first", F.col("ids")[0]).groupBy("dim", "shard").applyInArrow(shard, INDEX), "index"), shards


def search(vectors: DataFrame, is_query: Column, k: int = 20, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows found, by largest inner product.

    Reads vec_id and embedding. Rows with a null id or a vector that is null, empty, zero or holds null or non-finite
    components take no part; repeated rows count once; rows with the query's id are its own. Only vectors of the
    query's length are its candidates. Scores are double products of the original vectors, ties go to the smaller
    vec_id. No usable rows give no rows.
    """
    rows = written(usable(vectors), "vectors")
    index, shards = build_index(rows, k)
    asked = rows.filter(is_query).withColumn("dim", F.size("embedding"))
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(groups)).cast("int"))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def found(key, shard: pa.Table, some: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if shard.num_rows and some.num_rows:
            dim, n = shard.column("dim")[0].as_py(), shard.column("n")[0].as_py()
            own = np.frombuffer(shard.column("vectors")[0].as_buffer(), np.float64).reshape(n, dim)
            members = [np.frombuffer(x.as_buffer(), np.int32) for x in shard.column("members")[0]]
            links = [np.frombuffer(x.as_buffer(), np.int32).reshape(len(m), -1) for m, x in zip(members, shard.column("links")[0])]
            x = _lengthened(own)
            ids = shard.column("ids")[0].as_py()
            query_ids = some.column("vec_id").to_numpy()
            asked_for = some.column("embedding").combine_chunks().values.to_numpy().reshape(-1, dim)
            for at in range(0, len(query_ids), 512):
                q = asked_for[at : at + 512]
                flat = np.hstack([q, np.zeros((len(q), 1))])
                flat = (flat / np.sqrt((flat * flat).sum(1))[:, None]).astype(np.float32)
                for query, own_id, near in zip(q, query_ids[at : at + 512].tolist(), _search(x, members, links, flat, ef)):
                    near = near[near >= 0]
                    score = (own[near] * query).sum(1)
                    # One more than k, as one may be the query itself, and all that tie with the last of them.
                    kept = score >= (np.partition(score, -k - 1)[-k - 1] if len(score) > k + 1 else -np.inf)
                    hits = [(-s, i) for s, node in zip(score[kept].tolist(), near[kept].tolist()) for i in ids[node] if i != own_id]
                    for s, i in sorted(hits)[:k]:
                        out["query_id"].append(own_id)
                        out["vec_id"].append(i)
                        out["score"].append(-s)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["dim", "shard", "part"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(found, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
