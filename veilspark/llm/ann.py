"""Approximate nearest neighbours by inner product: one robust-pruned directed graph per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import staged

#: Vectors of a shard and queries of a block, on average.
SHARD, BLOCK = 8_192, 1_024
#: Neighbours of a node; nodes kept by a search while building and while querying.
DEGREE, BUILD_BEAM, QUERY_BEAM = 48, 96, 192
#: How much nearer a kept neighbour must be before it makes another one superfluous.
ALPHA = 1.2
#: Nodes of a beam that are expanded at once, and points inserted at once at most.
WIDTH, INSERT = 4, 512


def usable(vector: str) -> Column:
    """Neither null, zero, nor with null or non-finite components."""
    return F.expr(
        f"`{vector}` is not null and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        f" and exists(`{vector}`, x -> x <> 0)")


class Graph:
    """Distinct vectors with directed edges; nearness is largest inner product.

    One more coordinate gives all vectors the same length, so that the order by
    Euclidean distance to a query is the order by inner product.
    """

    def __init__(self, points: np.ndarray):
        norms = np.einsum("ij,ij->i", points, points, dtype=np.float64)
        extra = np.sqrt(np.maximum(norms.max() - norms, 0))
        scale = 1 / np.sqrt(norms.max())
        self.x = np.concatenate([points * scale, (extra * scale)[:, None]], axis=1).astype(np.float32)
        self.edges = np.full((len(points), DEGREE), -1, np.int32)
        self.entry = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin())

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes in the beam of each query, nearest first, their distances, and all nodes expanded."""
        n = len(q)
        ids = np.full((n, beam), -1, np.int32)
        far = np.full((n, beam), np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.x)), bool)
        ids[:, 0], open_[:, 0], seen[:, self.entry] = self.entry, True, True
        far[:, 0] = ((q - self.x[self.entry]) ** 2).sum(axis=1)
        expanded = [[] for _ in range(2)]
        live = np.arange(n)
        while len(live):
            # the beam is sorted, so the first open places are the nearest
            rank = np.cumsum(open_[live], axis=1)
            r, c = np.nonzero(open_[live] & (rank <= WIDTH))
            open_[live[r], c] = False
            node = ids[live[r], c]
            expanded[0].append(live[r])
            expanded[1].append(node)
            near = np.full((len(live), WIDTH, self.edges.shape[1]), -1, np.int32)
            near[r, rank[r, c] - 1] = self.edges[node]
            near = np.sort(near.reshape(len(live), -1), axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[live[:, None], near]
            a, b = np.nonzero(fresh)
            nodes = near[a, b]
            seen[live[a], nodes] = True
            gap = self.x[nodes] - q[live[a]]
            reach = np.full(near.shape, np.inf, np.float32)
            reach[a, b] = np.einsum("ij,ij->i", gap, gap)
            all_far = np.concatenate([far[live], reach], axis=1)
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_far, order, 1)
            ids[live] = np.take_along_axis(all_ids, order, 1)
            open_[live] = np.take_along_axis(all_open, order, 1)
            live = live[open_[live].any(axis=1)]
        who, node = np.concatenate(expanded[0]), np.concatenate(expanded[1])
        order = np.argsort(who, kind="stable")
        who, node = who[order], node[order]
        first = np.searchsorted(who, np.arange(n + 1))
        visited = np.full((n, int(np.diff(first).max())), -1, np.int32)
        visited[who, np.arange(len(who)) - first[who]] = node
        return ids, far, visited

    def prune(self, p: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """At most DEGREE diverse neighbours of each point: nearest first, dropping what a kept one is ALPHA times nearer to."""
        out = np.full((len(p), DEGREE), -1, np.int32)
        width = candidates.shape[1]
        step = max(1, 4_000_000 // (width * width))
        for s in range(0, len(p), step):
            c = np.sort(candidates[s:s + step], axis=1)
            alive = (c >= 0) & (c != p[s:s + step, None])
            alive[:, 1:] &= c[:, 1:] != c[:, :-1]
            # seen from the point itself, so that distances are exact at the scale of its neighbourhood
            x = self.x[c] - self.x[p[s:s + step], None]
            sq = np.einsum("ijk,ijk->ij", x, x)
            d = np.where(alive, sq, np.float32(np.inf))
            between = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0)
            rows = np.arange(len(c))
            for k in range(DEGREE):
                pick = np.where(alive, d, np.inf).argmin(axis=1)
                some = alive[rows, pick]
                if not some.any():
                    break
                out[s:s + step][some, k] = c[rows, pick][some]
                alive &= ALPHA * ALPHA * between[rows, pick] > d
                alive[rows, pick] = False
        return out

    def build(self, seed: int = 3) -> None:
        """Insert points in random order, in batches that double: search, prune, add edges back."""
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        done, size = 1, 1
        while done < n:
            batch = order[done:done + min(size, INSERT)]
            _, _, visited = self.search(self.x[batch], BUILD_BEAM)
            self.edges[batch] = self.prune(batch, visited)
            self._back(batch)
            done += len(batch)
            size *= 2
        self._connect()

    def _back(self, batch: np.ndarray) -> None:
        a, b = np.nonzero(self.edges[batch] >= 0)
        to, source = self.edges[batch][a, b], batch[a]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        held = (self.edges[nodes] >= 0).sum(axis=1)
        for lo, hi in ((0, 8), (8, 64), (64, len(batch))):  # alike many new edges, so that little is padded
            at = np.flatnonzero((counts > lo) & (counts <= hi))
            if not len(at):
                continue
            wide = np.full((len(at), DEGREE + int(counts[at].max())), -1, np.int32)
            wide[:, :DEGREE] = self.edges[nodes[at]]
            row = np.repeat(np.arange(len(at)), counts[at])
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts[at]) - counts[at], counts[at])
            wide[row, DEGREE + place] = source[first[at][row] + place]
            fits = held[at] + counts[at] <= DEGREE
            if fits.any():  # filled places first
                some = wide[fits]
                some = np.take_along_axis(some, np.argsort(some < 0, axis=1, kind="stable"), 1)
                self.edges[nodes[at[fits]]] = some[:, :DEGREE]
            if not fits.all():
                self.edges[nodes[at[~fits]]] = self.prune(nodes[at[~fits]], wide[~fits])

    def _connect(self) -> None:
        """Give every node that cannot be reached from the entry an edge from the nearest one that can."""
        while True:
            reached = np.zeros(len(self.x), bool)
            front = np.array([self.entry])
            while len(front):
                reached[front] = True
                front = np.unique(self.edges[front])
                front = front[front >= 0]
                front = front[~reached[front]]
            lost, kept = np.flatnonzero(~reached), np.flatnonzero(reached)
            if not len(lost):
                return
            best = np.empty(len(lost), np.int64)
            for s in range(0, len(lost), 256):
                some = self.x[lost[s:s + 256]]
                best[s:s + 256] = kept[((some @ self.x[kept].T) * -2 + (self.x[kept] ** 2).sum(axis=1)).argmin(axis=1)]
            nodes, first = np.unique(best, return_index=True)
            column = np.full((len(self.x), 1), -1, np.int32)
            column[nodes, 0] = lost[first]
            self.edges = np.concatenate([self.edges, column], axis=1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def nearest(
    vectors: DataFrame, queries: str, k: int = 20, id: str = "vec_id", vector: str = "embedding",
    beam: int = QUERY_BEAM,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the largest inner product found for each query row.

    ``queries`` is a condition on the id, in SQL.

    Rows are dealt to shards of about SHARD rows by a hash of the id; each shard
    gets a graph over its distinct vectors, written to the shared folder.  Queries
    travel in blocks to every shard, where a beam search collects candidates;
    their scores are computed in double precision from the vectors as given.
    The best k of all shards remain, ties to the smaller id.  Memory is that of one
    shard and one block.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows with a null id; vectors meet only those of their own
    length.  Rows that repeat an id count once, with the smallest vector.  Other
    columns are ignored.
    """
    kind = vectors.schema[id].dataType.simpleString()
    rows = vectors.where(usable(vector) & F.col(id).isNotNull()).groupBy(id).agg(
        F.min(F.col(vector).cast("array<double>")).alias("v"))
    rows = staged(rows.select(F.col(id).alias("id"), "v", F.size("v").alias("dim"), F.expr(queries).alias("asked")), "vectors")
    asked = rows.where("asked")
    shards = max(1, -(-rows.count() // SHARD))
    blocks = max(1, -(-asked.count() // BLOCK))
    many = min(4 * shards, 20_000)

    def build(t: pa.Table) -> pa.Table:
        points, of = np.unique(_matrix(t["v"]), axis=0, return_inverse=True)
        ids = np.array(t["id"].to_pylist(), object)
        order = np.lexsort((ids, of.ravel()))
        graph = Graph(points)
        graph.build()
        first = np.searchsorted(of.ravel()[order], np.arange(len(points) + 1)).astype(np.int64)
        return pa.table({
            "dim": t["dim"][:1], "shard": t["shard"][:1], "nodes": pa.array([len(points)]), "entry": pa.array([graph.entry]),
            "points": pa.array([points.tobytes()]), "edges": pa.array([graph.edges.tobytes()]), "first": pa.array([first.tobytes()]),
            "ids": pa.array([ids[order].tolist()], pa.list_(t.schema.field("id").type))})

    graphs = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = graphs.repartition(many, "dim", "shard").groupBy("dim", "shard").applyInArrow(
        build, f"dim int, shard int, nodes long, entry long, points binary, edges binary, first binary, ids array<{kind}>")
    graphs = staged(graphs, "graphs")

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"qdim": t["dim"][:1], "block": t["block"][:1],
                         "qids": pa.array([t["id"].to_pylist()], pa.list_(t.schema.field("id").type)),
                         "q": pa.array([_matrix(t["v"]).tobytes()])})

    packed = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).groupBy(
        "dim", "block").applyInArrow(pack, f"qdim int, block int, qids array<{kind}>, q binary")
    sent = packed.withColumn("qshard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = graphs.repartition(many, "dim", "shard").hint("merge").join(
        sent.repartition(many, "qdim", "qshard"), (F.col("dim") == F.col("qdim")) & (F.col("shard") == F.col("qshard")))

    def search(t: pa.Table) -> pa.Table:
        dim, nodes = t["dim"][0].as_py(), t["nodes"][0].as_py()
        points = np.frombuffer(t["points"][0].as_py()).reshape(nodes, dim)
        graph = Graph(points)
        graph.edges = np.frombuffer(t["edges"][0].as_py(), np.int32).reshape(nodes, -1)
        graph.entry = t["entry"][0].as_py()
        first = np.frombuffer(t["first"][0].as_py(), np.int64)
        ids, qids = t["ids"][0].as_py(), t["qids"][0].as_py()
        q = np.frombuffer(t["q"][0].as_py()).reshape(-1, dim)
        out = [], [], []
        for s in range(0, len(q), 256):
            some = q[s:s + 256]
            # the length of a query does not change the order of what it is compared with
            unit = some / np.sqrt(np.einsum("ij,ij->i", some, some))[:, None]
            found, _, _ = graph.search(np.concatenate([unit, np.zeros((len(unit), 1))], axis=1).astype(np.float32), beam)
            score = np.einsum("ik,ijk->ij", some, points[found])
            for i in range(len(some)):
                hits = []
                for node, value in zip(found[i].tolist(), score[i].tolist()):
                    if node >= 0:  # of equal vectors only the smallest ids can be among the best
                        hits += [(-value, x) for x in ids[first[node]:min(first[node + 1], first[node] + k + 1)] if x != qids[s + i]]
                for value, x in sorted(hits)[:k]:
                    out[0].append(qids[s + i])
                    out[1].append(x)
                    out[2].append(-value)
        kind = t.schema.field("ids").type.value_type
        return pa.table({"query_id": pa.array(out[0], kind), id: pa.array(out[1], kind), "score": pa.array(out[2], pa.float64())})

    found = pairs.groupBy("dim", "shard", "block").applyInArrow(search, f"query_id {kind}, {id} {kind}, score double")
    return found.withColumn("rank", F.expr(
        f"row_number() over (partition by query_id order by score desc, `{id}`)").cast("int")).where(
        F.col("rank") <= k).select("query_id", "rank", id, "score")
