"""Nearest neighbours by inner product with one small-world graph per shard.

Every shard holds a hierarchical navigable small-world graph (published by
Malkov and Yashunin, 2018) over its distinct vectors, kept as flat arrays: the
vectors, the neighbours of the lowest layer as one ``[node, 2 * links]`` array,
and per upper layer its nodes and their ``[node, links]`` neighbours.  Vectors
get one more component that brings them all to the length of the longest, so
the largest inner product is the nearest direction and the graph is a metric
one; a query's extra component is 0.

Layers are built from the top.  Nodes enter a layer in batches, the nodes of
the layer above first: a batch finds its neighbours by a beam search over the
nodes already there, started from the nearest node above, plus the other
nodes of the batch; of those the diverse ones are linked, both ways.  Searches
of a batch advance together, so the work is array work.

Equal vectors are one node that carries its smallest ``k + 1`` ids: no other
of its rows can be among the ``k`` nearest.  They are picked before the
shuffle, so a very common vector is no hot group.  Queries meet every shard as
a stream, and the shards' results are merged by rank.

Defined cases: vectors that are null, empty, zero or hold a null or a
non-finite component, and rows without an id, take no part; rows that repeat
an id and a vector count once; vectors of different lengths never meet; ties
go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.session import cut_lineage

SHARD_ROWS = 16_384
LINKS = 16
EF_BUILD = 96
EF_SEARCH = 512
BATCH = 256
EXPAND = 4


def _pick(rows: np.ndarray, sims: np.ndarray, vec: np.ndarray, most: int) -> np.ndarray:
    """Of each line of candidates, sorted by falling similarity, up to ``most``
    diverse ones (each nearer to the node than to any one picked before),
    filled up with the nearest others; -1 where there are none."""
    n, c = rows.shape
    v = vec[np.maximum(rows, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    picked = np.zeros((n, c), bool)
    closest = np.full((n, c), -np.inf, np.float32)  # similarity of each candidate to the picked ones
    count = np.zeros(n, np.int64)
    for i in range(c):
        take = (rows[:, i] >= 0) & (sims[:, i] > closest[:, i]) & (count < most)
        picked[:, i] = take
        count += take
        closest[take] = np.maximum(closest[take], among[take, i])
    order = np.argsort(np.where(picked, 0, np.where(rows >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(rows, order, axis=1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((n, most - out.shape[1]), -1, out.dtype)], axis=1)
    return out


def _sorted(rows: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct candidates of each line by falling similarity."""
    order = np.argsort(rows, axis=1, kind="stable")
    rows, sims = np.take_along_axis(rows, order, 1), np.take_along_axis(sims, order, 1)
    again = np.zeros(rows.shape, bool)
    again[:, 1:] = rows[:, 1:] == rows[:, :-1]
    rows, sims = np.where(again, -1, rows), np.where(again | (rows < 0), -np.inf, sims)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(rows, order, 1), np.take_along_axis(sims, order, 1)


def _beam(q: np.ndarray, entry: np.ndarray, vec: np.ndarray, near: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """``ef`` nodes per query found from its entry nodes ``[query, entries]``
    over ``near``, sorted by falling similarity."""
    b = len(q)
    seen = np.zeros((b, len(vec)), bool)
    line = np.arange(b)[:, None]
    seen[line, entry] = True
    rows = np.full((b, ef), -1, np.int64)
    sims = np.full((b, ef), -np.inf, np.float32)
    e = entry.shape[1]
    rows[:, :e] = entry
    sims[:, :e] = np.einsum("bed,bd->be", vec[entry], q)
    todo = rows >= 0
    active = np.arange(b)
    while len(active):
        own = np.where(todo[active], sims[active], -np.inf)
        best = np.argpartition(-own, min(EXPAND, ef) - 1, axis=1)[:, :EXPAND]
        good = np.take_along_axis(own, best, 1) > -np.inf
        alive = good.any(axis=1)
        active, best, good = active[alive], best[alive], good[alive]
        if not len(active):
            break
        todo[active[:, None], best] = False
        from_rows = np.where(good, rows[active[:, None], best], -1)
        next_rows = np.where(from_rows[:, :, None] >= 0, near[np.maximum(from_rows, 0)], -1).reshape(len(active), -1)
        which, col = np.nonzero((next_rows >= 0) & ~seen[active[:, None], np.maximum(next_rows, 0)])
        found = next_rows[which, col]
        # one of each node per query
        key = np.unique(which * len(vec) + found)
        which, found = key // len(vec), key % len(vec)
        seen[active[which], found] = True
        value = np.einsum("id,id->i", vec[found], q[active[which]])
        counts = np.bincount(which, minlength=len(active))
        width = int(counts.max()) if len(counts) else 0
        if not width:
            continue
        at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        new_rows = np.full((len(active), width), -1, np.int64)
        new_sims = np.full((len(active), width), -np.inf, np.float32)
        new_rows[which, at], new_sims[which, at] = found, value
        all_rows = np.concatenate([rows[active], new_rows], axis=1)
        all_sims = np.concatenate([sims[active], new_sims], axis=1)
        all_todo = np.concatenate([todo[active], new_rows >= 0], axis=1)
        keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        rows[active] = np.take_along_axis(all_rows, keep, 1)
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        todo[active] = np.take_along_axis(all_todo, keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(rows, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """Flat arrays of one shard's graph."""

    def __init__(self, vec: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vec = vec          # float32, with the extra component
        self.layers = layers    # lowest first: nodes, neighbours as places among those nodes

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 0) -> Graph:
        norm = np.einsum("id,id->i", x, x)
        vec = np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)
        n = len(vec)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")  # nodes of upper layers come first everywhere
        g = cls(vec, [])
        for at in range(level[order[0]], -1, -1):
            nodes = order[:int((level >= at).sum())]
            near = cls._layer(vec[nodes], g, nodes, LINKS * (2 if at == 0 else 1))
            g.layers.insert(0, (nodes, near))
        return g

    @staticmethod
    def _layer(vec: np.ndarray, above: Graph, nodes: np.ndarray, most: int) -> np.ndarray:
        n = len(vec)
        near = np.full((n, most), -1, np.int64)
        done = 0
        while done < n:
            to = min(n, done + (BATCH if done else BATCH // 2))
            new = np.arange(done, to)
            q = vec[new]
            sims = q @ q.T
            np.fill_diagonal(sims, -np.inf)
            c = min(EF_BUILD, len(new))
            part = np.argpartition(-sims, c - 1, axis=1)[:, :c]
            rows, values = new[part], np.take_along_axis(sims, part, 1)
            rows = np.where(np.isneginf(values), -1, rows)
            if done:
                entry = above.entry(q) if above.layers else np.zeros((len(new), 1), np.int64)
                entry = np.where(entry < done, entry, 0)
                r, v = _beam(q, entry, vec[:done], near[:done], EF_BUILD)
                rows, values = np.concatenate([rows, r], 1), np.concatenate([values, v], 1)
            rows, values = _sorted(rows, values, 64)
            near[new] = _pick(rows, values, vec, most)
            near[new, LINKS:] = -1
            # links back: the nodes linked to, with what they have and the new ones
            a, b = np.repeat(new, most), near[new].reshape(-1)
            a, b = a[b >= 0], b[b >= 0]
            if not len(b):
                done = to
                continue
            order = np.lexsort((-np.einsum("id,id->i", vec[a], vec[b]), b))
            a, b = a[order], b[order]
            target, first, counts = np.unique(b, return_index=True, return_counts=True)
            place = np.arange(len(b)) - np.repeat(first, counts)
            width = min(int(counts.max()), 2 * most)
            extra = np.full((len(target), width), -1, np.int64)
            fits = place < width
            extra[np.repeat(np.arange(len(target)), counts)[fits], place[fits]] = a[fits]
            rows = np.concatenate([near[target], extra], axis=1)
            values = np.einsum("ncd,nd->nc", vec[np.maximum(rows, 0)], vec[target])
            values = np.where(rows >= 0, values, -np.inf)
            rows, values = _sorted(rows, values, rows.shape[1])
            full = (rows >= 0).sum(axis=1) > most
            near[target[~full]] = rows[~full][:, :most]
            if full.any():
                near[target[full]] = _pick(rows[full], values[full], vec, most)
            done = to
        return near

    def entry(self, q: np.ndarray) -> np.ndarray:
        """Per query the nearest node of the layers so far, as a place in the
        next lower layer (whose first nodes are those of the layers above)."""
        at = np.zeros((len(q), 1), np.int64)
        for nodes, near in reversed(self.layers):
            rows, _ = _beam(q, at, self.vec[nodes], near, 8)
            at = rows[:, :1]
        return at

    def search(self, x: np.ndarray, ef: int) -> np.ndarray:
        """``[query, ef]`` nodes found, -1 where there are fewer."""
        q = np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32)
        nodes, near = self.layers[0]
        out = []
        for i in range(0, len(q), BATCH):
            part = q[i:i + BATCH]
            upper = Graph(self.vec, self.layers[1:])
            at = upper.entry(part) if upper.layers else np.zeros((len(part), 1), np.int64)
            rows, _ = _beam(part, at, self.vec[nodes], near, ef)
            out.append(np.where(rows >= 0, nodes[np.maximum(rows, 0)], -1))
        return np.concatenate(out)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def usable_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct ``id, vec``, without nulls, zero vectors and non-finite components."""
    finite = F.forall("vec", lambda x: F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False)))
    return (df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                      F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & F.col("vec").isNotNull())
            .where(finite & F.exists("vec", lambda x: x != 0)).distinct())


def distinct_vectors(df: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """``dim, vec, ids``: usable vectors with their ``k + 1`` smallest ids."""
    rows = usable_rows(df, id_col, vec_col)
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.size("vec").alias("dim"), "vec", "ids")


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: ``dim, shard, ids, counts, vec, graph...`` as flat arrays."""
    n = nodes.count()
    shards = max(1, -(-n // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        order = pc.sort_indices(pc.list_element(t["ids"], 0))
        t = t.take(order)  # the same graph whatever order the rows come in
        x = _matrix(t["vec"])
        g = Graph.build(x)
        ids = t["ids"].combine_chunks()
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "ids": [ids.flatten().to_numpy().astype("<i8").tobytes()],
            "counts": [pc.list_value_length(ids).to_numpy().astype("<i4").tobytes()],
            "vec": [x.astype("<f8").tobytes()], "aug": [g.vec.astype("<f4").tobytes()],
            "sizes": pa.array([[len(nodes) for nodes, _ in g.layers]], pa.list_(pa.int32())),
            "nodes": [b"".join(nodes.astype("<i4").tobytes() for nodes, _ in g.layers)],
            "near": [b"".join(near.astype("<i4").tobytes() for _, near in g.layers)],
        })

    return dealt.groupBy("dim", "shard").applyInArrow(
        build, "dim int, shard int, ids binary, counts binary, vec binary, aug binary, sizes array<int>, nodes binary, near binary")


def _load(r: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    dim = r["dim"]
    sizes = r["sizes"]
    all_nodes = np.frombuffer(r["nodes"], "<i4").astype(np.int64)
    near, layers, at, to = np.frombuffer(r["near"], "<i4").astype(np.int64), [], 0, 0
    for i, n in enumerate(sizes):
        width = LINKS * (2 if i == 0 else 1)
        layers.append((all_nodes[at:at + n], near[to:to + n * width].reshape(n, width)))
        at, to = at + n, to + n * width
    g = Graph(np.frombuffer(r["aug"], "<f4").reshape(-1, dim + 1), layers)
    return (g, np.frombuffer(r["vec"], "<f8").reshape(-1, dim), np.frombuffer(r["ids"], "<i8"),
            np.frombuffer(r["counts"], "<i4").astype(np.int64))


def search(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for ``id, vec``.

    A task reads a shard once and then its queries as a stream, so neither the
    copies of a shard nor the memory grow with the queries; a shard goes to
    several tasks only while there are fewer shards than cores."""
    shards, cores = max(1, index.count()), index.sparkSession.sparkContext.defaultParallelism
    parts = -(-cores // shards)
    each_shard = F.broadcast(index.groupBy("dim").agg(F.collect_list("shard").alias("shards")))
    q = (queries.withColumn("dim", F.size("vec")).join(each_shard, "dim")
         .select("dim", F.explode("shards").alias("shard"),
                 F.pmod(F.xxhash64("id", "dim"), F.lit(parts)).cast("int").alias("part"),
                 F.lit(1).alias("after"), F.col("id").alias("query_id"), F.col("vec").alias("query")))
    every = index.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "after": F.lit(0)})
    keys = ["dim", "shard", "part"]
    dealt = (every.unionByName(q, allowMissingColumns=True).repartition(max(shards * parts, 4 * cores), *keys)
             .sortWithinPartitions(*keys, "after"))

    def find(batches):
        loaded = None
        for batch in batches:
            after = batch.column("after").to_numpy()
            at = 0
            while at < len(after):
                if after[at] == 0:
                    loaded = None  # one shard at a time
                    loaded = _load(batch.slice(at, 1).to_pylist()[0])
                    at += 1
                    continue
                to = at + int(np.argmin(np.append(after[at:], 0)))
                yield from _nearest(loaded, pa.Table.from_batches([batch.slice(at, to - at)]), k, ef).to_batches()
                at = to

    found = dealt.mapInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _nearest(loaded: tuple, own: pa.Table, k: int, ef: int) -> pa.Table:
    """The ``k`` nearest in one shard for each of some queries."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    g, vec, ids, counts = loaded
    first = np.cumsum(counts) - counts
    qid, x = own["query_id"].to_numpy(), _matrix(own["query"])
    for i, row in enumerate(g.search(x, max(ef, k + 1))):
        row = row[row >= 0]
        score = (vec[row] * x[i]).sum(axis=1)
        each = counts[row]
        member = ids[np.repeat(first[row] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        score = np.repeat(score, each)
        other = member != qid[i]
        member, score = member[other], score[other]
        best = np.lexsort((member, -score))[:k]
        out["query_id"].append(np.full(len(best), qid[i]))
        out["vec_id"].append(member[best])
        out["score"].append(score[best])
    return pa.table({n: np.concatenate(v) if v else np.zeros(0, np.float64 if n == "score" else np.int64)
                     for n, v in out.items()})


def neighbours(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id",
               vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest found, by inner product, for each row whose id is
    divisible by ``every``, among all other rows; see the module's text."""
    nodes = cut_lineage(distinct_vectors(df, k, id_col, vec_col))
    index = cut_lineage(build_index(nodes, shard_rows))
    queries = usable_rows(df, id_col, vec_col).where(F.col("id") % every == 0)
    return search(index, queries, k)
