"""Embedding near-dedup on hierarchical navigable small-world graphs.

Vectors are split into shards by hash; each shard is a graph of layers, built
in one task.  Every block of vectors then asks every shard: a search walks down
the layers and keeps a beam of the nearest nodes found.  A query's beam widens
while even its worst member is a link, and all beams widen until an audit against
every vector of the shard misses no more than it may; a beam as wide as the shard
is the exact scan.  The audit asks a spread of the queries and a spread of the
shard's own nodes turned half-way to the least cosine, so it always knows links.
Links are checked by cosine in double precision.

A (block, shard) task emits counts and a spanning forest of its links, never the
links themselves; connected components then unite the forests.  Equal vectors
are one node from the start; a node's number is its own, whatever the keys of
its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import saved, ship_package
from reviewlens.llm.components import components

COSINE = 0.9
DEGREE = 16                 # links of a node in a layer, twice that in the lowest
BEAM_BUILD = 48
BEAM = 48
SHARD_ROWS = 100_000        # vectors of a shard at most; never fewer shards than LEAST_SHARDS
LEAST_SHARDS = 12
BLOCK_ROWS = 100_000        # vectors of a block of queries at most
AUDIT = 64                  # audited queries per search, and as many turned nodes
RECALL = 0.999              # links found among those the audit knows


def _top(sims: np.ndarray, ids: np.ndarray, flags: np.ndarray, k: int):
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sims, ids, flags = (np.take_along_axis(a, part, 1) for a in (sims, ids, flags))
    return sims, ids, flags


def search(vecs: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int,
           n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries at once in one layer.

    graph: (nodes, degree) neighbour numbers, -1 for none; entry: (queries,
    width) starting nodes.  Returns (ids, sims), each (queries, beam), -1 and
    -inf where a beam isn't full.  Every step expands each query's four best
    nodes that are not expanded yet.
    """
    q, n = len(queries), len(vecs) if n is None else n
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    width = min(entry.shape[1], beam)
    ids[:, :width] = entry[:, :width]
    sims[:, :width] = np.einsum("qd,qwd->qw", queries, vecs[ids[:, :width]])
    done[:, :width] = False
    np.put_along_axis(seen, ids[:, :width].astype(np.int64), True, 1)
    live = rows
    while len(live):
        s = np.where(done[live], -np.inf, sims[live])
        step = min(4, beam)
        best = np.argpartition(-s, step - 1, axis=1)[:, :step] if beam > step else np.tile(np.arange(beam), (len(live), 1))
        good = np.take_along_axis(s, best, 1) > -np.inf
        some = good.any(1)
        live, best, good = live[some], best[some], good[some]
        if not len(live):
            break
        d = done[live]
        np.put_along_axis(d, best, True, 1)
        done[live] = d
        nodes = np.where(good, np.take_along_axis(ids[live], best, 1), -1)
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        target = near[r, c]
        seen[live[r], target] = True
        count = fresh.sum(1)
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        m = int(count.max())
        new_ids = np.full((len(live), m), -1, np.int32)
        new_sims = np.full((len(live), m), -np.inf, np.float32)
        new_ids[r, place] = target
        new_sims[r, place] = np.einsum("ed,ed->e", queries[live[r]], vecs[target])
        all_sims = np.concatenate([sims[live], new_sims], 1)
        all_ids = np.concatenate([ids[live], new_ids], 1)
        all_done = np.concatenate([done[live], new_ids < 0], 1)
        sims[live], ids[live], done[live] = _top(all_sims, all_ids, all_done, beam)
    return ids, sims


def _diverse(vecs: np.ndarray, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of the candidates of every node, nearest first: one is
    taken when it is nearer to the node than to all taken before; free places
    go to the nearest that were passed over."""
    n, c = cand.shape
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    out = np.full((n, degree), -1, np.int32)
    used = np.zeros(n, np.int64)
    taken = np.zeros((n, c), bool)
    cv = vecs[cand]
    between = np.einsum("ncd,ned->nce", cv, cv)
    ok = (cand >= 0) & (sims > -np.inf)
    for j in range(c):
        closer = np.where(taken[:, :j], between[:, j, :j], -np.inf).max(1) if j else np.full(n, -np.inf)
        take = ok[:, j] & (used < degree) & (sims[:, j] >= closer)
        at = np.flatnonzero(take)
        out[at, used[at]] = cand[at, j]
        used[at] += 1
        taken[at, j] = True
    for j in range(c):
        at = np.flatnonzero(ok[:, j] & ~taken[:, j] & (used < degree))
        out[at, used[at]] = cand[at, j]
        used[at] += 1
    return out


def build_layer(vecs: np.ndarray, degree: int, start: int, entries: np.ndarray) -> np.ndarray:
    """Neighbours of all nodes of one layer.  Nodes join in batches that double
    (512 at most): a batch searches the graph so far and itself, links to a
    diverse choice, and is linked back.  Nodes before ``start`` are the next
    layer's; ``entries`` has a node of them for every node."""
    n = len(vecs)
    graph = np.full((n, degree), -1, np.int32)
    at = 0
    while at < n:
        to = min(n, max(at + min(max(at, 32), 512), 1))
        new = vecs[at:to]
        own = new @ new.T
        np.fill_diagonal(own, -np.inf)
        k = min(degree, to - at)
        inner = np.argpartition(-own, k - 1, axis=1)[:, :k] if k else np.zeros((to - at, 0), int)
        cand, sims = (inner + at).astype(np.int32), np.take_along_axis(own, inner, 1)
        if at:
            first = np.minimum(entries[at:to], at - 1)[:, None].astype(np.int32)
            ids, s = search(vecs, graph, new, first, BEAM_BUILD, at)
            cand, sims = np.concatenate([cand, ids], 1), np.concatenate([sims, s], 1)
        graph[at:to] = _diverse(vecs, np.arange(at, to), cand, sims, degree)
        # link back: every node named by the batch chooses anew among old and new neighbours
        src = np.repeat(np.arange(at, to, dtype=np.int32), degree)
        dst = graph[at:to].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(node), min(int(count.max()), 2 * degree) if len(node) else 0), -1, np.int32)
        place = np.arange(len(dst)) - np.repeat(first, count)
        fits = place < extra.shape[1]
        extra[np.repeat(np.arange(len(node)), count)[fits], place[fits]] = src[fits]
        old = graph[node]
        dup = (extra[:, :, None] == old[:, None, :]).any(2)
        cand = np.concatenate([old, np.where(dup, -1, extra)], 1)
        full = (cand >= 0).sum(1) > degree
        easy = np.flatnonzero(~full)
        packed = np.sort(np.where(cand[easy] < 0, np.iinfo(np.int32).max, cand[easy]), axis=1)[:, :degree]
        graph[node[easy]] = np.where(packed == np.iinfo(np.int32).max, -1, packed)
        hard = np.flatnonzero(full)
        for a in range(0, len(hard), 1024):
            h = hard[a:a + 1024]
            s = np.where(cand[h] >= 0, np.einsum("nd,ncd->nc", vecs[node[h]], vecs[cand[h]]), -np.inf)
            graph[node[h]] = _diverse(vecs, node[h], cand[h], s, degree)
        at = to
    return graph


class Graph:
    """The layers over ``vecs`` (unit length, float32); nodes of higher layers first."""

    def __init__(self, vecs: np.ndarray, keys: np.ndarray):
        n = len(vecs)
        u = (np.argsort(np.argsort(keys * np.int64(0x9E3779B1) % np.int64(1 << 31))) + 0.5) / n
        level = np.floor(-np.log(u) / np.log(DEGREE)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.vecs = np.ascontiguousarray(vecs[self.order])
        level = level[self.order]
        self.layers = []                             # (nodes, neighbours), highest first
        upper = 0
        for lv in range(level[0], -1, -1):
            count = int((level >= lv).sum())
            part = self.vecs[:count]
            entry = np.zeros(count, np.int32) if not self.layers else self.descend(part)[:, 0]
            self.layers.append(build_layer(part, DEGREE * (2 if lv == 0 else 1), upper, entry))
            upper = count

    def descend(self, queries: np.ndarray, layers: int | None = None) -> np.ndarray:
        """The entry node of every query below the given number of layers."""
        entry = np.zeros((len(queries), 1), np.int32)
        for g in self.layers[:layers]:
            out = [search(self.vecs[:len(g)], g, queries[a:a + 1024], entry[a:a + 1024], 4)[0][:, :4]
                   for a in range(0, len(queries), 1024)]
            ids = np.concatenate(out)
            sims = np.where(ids >= 0, np.einsum("qd,qwd->qw", queries, self.vecs[ids]), -np.inf)
            entry = np.take_along_axis(ids, sims.argmax(1)[:, None], 1)
        return entry

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sims) of the ``beam`` nearest nodes found; all nodes if it is that wide."""
        n = len(self.vecs)
        if 2 * beam >= n:
            return np.tile(np.arange(n, dtype=np.int32), (len(queries), 1)), queries @ self.vecs.T
        entry = self.descend(queries, -1) if len(self.layers) > 1 else np.zeros((len(queries), 1), np.int32)
        return search(self.vecs, self.layers[-1], queries, entry, beam)


def turned(vecs: np.ndarray, cosine: float, n: int) -> np.ndarray:
    """A spread of ``n`` unit vectors, each turned in a random direction to the
    middle between ``cosine`` and 1, so that each has a link."""
    v = vecs[np.unique(np.linspace(0, len(vecs) - 1, min(n, len(vecs))).astype(int))].astype(np.float64)
    r = np.random.default_rng(11).normal(size=v.shape)
    r -= (r * v).sum(1, keepdims=True) * v
    size = np.linalg.norm(r, axis=1, keepdims=True)
    c = (1 + cosine) / 2
    # in one dimension there is nowhere to turn
    return np.where(size > 1e-9, c * v + np.sqrt(1 - c * c) * r / np.maximum(size, 1e-9), v).astype(np.float32)


def audited(graph: Graph, queries: np.ndarray, cosine: float) -> tuple[int, int, int]:
    """(beam, known, found): the first beam whose search finds ``RECALL`` of the
    links that an exact scan of the shard knows for the audited vectors, and the
    sums of both.  Vectors whose beam is full of links are left out: ``linked``
    widens theirs anyway."""
    low, n = cosine - 1e-4, len(graph.vecs)
    spread = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    asked = np.concatenate([queries[spread], turned(graph.vecs, cosine, AUDIT)])
    known = (asked @ graph.vecs.T >= low).sum(1)
    beam = BEAM
    while True:
        ids, sims = graph.nearest(asked, min(beam, n))
        hit = (sims >= low) & (ids >= 0)
        part = ~hit.all(1) | (2 * beam >= n)
        sums = int(known[part].sum()), int(hit[part].sum())
        if 2 * beam >= n or sums[1] >= RECALL * sums[0]:
            return beam, *sums
        beam *= 2


def linked(graph: Graph, queries: np.ndarray, cosine: float, beam: int):
    """Yields (query numbers, node numbers) of the pairs near ``cosine`` or above.

    Beams widen for the queries whose worst beam member is still a link.
    """
    low, n = cosine - 1e-4, len(graph.vecs)
    todo, rows = np.arange(len(queries)), max(16, (16 << 20) // n)
    while len(todo):
        again = []
        for a in range(0, len(todo), min(rows, 1024)):
            part = todo[a:a + min(rows, 1024)]
            ids, sims = graph.nearest(queries[part], min(beam, n))
            hit = (sims >= low) & (ids >= 0)
            wide = hit.all(1) & (2 * beam < n)       # there may be more links than the beam holds
            again.append(part[wide])
            hit[wide] = False
            q, c = np.nonzero(hit)
            yield part[q], ids[q, c]
        todo, beam = np.concatenate(again), beam * 2


def forest(a: np.ndarray, b: np.ndarray, n: int, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest node number that links (a, b) lead to, for nodes 0 .. n - 1."""
    root = np.arange(n) if root is None else root
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
        if (root == before).all():
            return root


def _unpack(col) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in col])


def _build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("id")
    ids, v = part["id"].to_numpy(np.int64), _unpack(part["v"])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    g = Graph(unit.astype(np.float32), ids)
    import pickle
    return pd.DataFrame({"shard": [key[0]], "graph": [pickle.dumps(
        (ids[g.order], part["copies"].to_numpy(np.int64)[g.order], unit[g.order], g.layers))]})


def _ask(cosine: float):
    def run(key: tuple, graphs: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        import pickle
        empty = pd.DataFrame({"id": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64"),
                              "root": pd.Series([], dtype="int64"), "known": pd.Series([], dtype="int64"),
                              "hits": pd.Series([], dtype="int64")})
        if not len(graphs) or not len(block):
            return empty
        ids, copies, unit, layers = pickle.loads(graphs["graph"].iloc[0])
        g = Graph.__new__(Graph)
        g.vecs, g.layers = np.ascontiguousarray(unit.astype(np.float32)), layers
        block = block.sort_values("id")
        qid, v = block["id"].to_numpy(np.int64), _unpack(block["v"])
        q = v / np.linalg.norm(v, axis=1, keepdims=True)
        both, at = np.unique(np.concatenate([ids, qid]), return_inverse=True)   # numbers grow with ids
        links, root = np.zeros(len(qid), np.int64), np.arange(len(both))
        asked = q.astype(np.float32)
        beam, known, hits = audited(g, asked, cosine)
        for i, j in linked(g, asked, cosine, beam):
            sure = np.einsum("ed,ed->e", q[i], unit[j]) >= cosine
            i, j = i[sure], j[sure]
            i, j = i[qid[i] != ids[j]], j[qid[i] != ids[j]]
            np.add.at(links, i, copies[j])
            root = forest(at[len(ids) + i], at[j], len(both), root)
        moved = np.flatnonzero(root != np.arange(len(both)))
        own = qid[links > 0]
        return pd.concat([empty, pd.DataFrame({"id": own, "links": links[links > 0], "root": own, "known": 0, "hits": 0}),
                          pd.DataFrame({"id": both[moved], "links": 0, "root": both[root[moved]], "known": 0, "hits": 0}),
                          pd.DataFrame({"id": [-1], "links": 0, "root": -1, "known": known, "hits": hits})])
    return run


def _numbers(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept, audited_recall) for every row of ``df``.

    n_links counts the other rows at ``cosine`` or more, equal vectors included;
    component_id is the smallest key that links lead to.  Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing,
    as do rows without a key; vectors of other lengths than most link among
    their own length only.  A repeated key's rows are rows of their own, with equal
    vectors or different ones: each links by its vector, and a component's id is
    the smallest key of its rows.  audited_recall is the share of the links known
    to the audits that the searches found, over all tasks (null without vectors).
    An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("key"), v.alias("v"))
    inf = float("inf")
    fine = (F.col("key").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(
        ~F.isnan(x) & (x < inf) & (x > -inf), F.lit(False))) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # scaled by the largest component, so that very large and very small vectors have a norm
    rows = saved(rows.withColumn("v", F.when(F.col("fine"), F.transform("v", lambda x: x / top)))
                 .withColumn("same", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.transform(
                     "v", lambda x: x.cast("string"))), 256))), "vectors")
    nodes = (rows.filter("fine").groupBy("same").agg(
        F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v")))
    nodes = saved(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")    # written once, so numbers stay
    cols, out = "id long, links long, root long, known long, hits long", []
    sizes = [(r.d, r.n) for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]
    for d, n in sizes:                               # as a rule one length
        shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(4, -(-n // BLOCK_ROWS))
        part = nodes.filter(F.size("v") == d)
        graphs = saved(part.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
                       .groupBy("shard").applyInPandas(_build, "shard long, graph binary"), "graphs")
        asked = (part.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)))
                 .select("block", "id", "v", _numbers(shards).alias("shard")))
        served = graphs.withColumn("block", _numbers(blocks))
        out.append(served.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
                   .applyInPandas(_ask(cosine), cols))
    found = spark.createDataFrame([], cols) if not out else out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    found = saved(found, "found")
    known, hits = found.agg(F.sum("known"), F.sum("hits")).first()
    recall = F.lit(hits / known if known else None).cast("double")
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    class_of = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_node = saved(nodes.select("same", "id", "least", "copies").join(count, "id", "left")
                     .join(class_of, F.col("id") == F.col("node"), "left")
                     .select("same", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component", "id").alias("class")), "classes")
    name = per_node.groupBy("class").agg(F.min("least").alias("component_id"))
    per_node = per_node.join(name, "class").select("same", "n_links", "component_id")
    return (rows.select("key", "same").join(per_node, "same", "left")
            .select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "key").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)))
            .withColumn("audited_recall", recall))


def op1(spark, vectors: DataFrame) -> DataFrame:
    """Query op1: links and components of all embeddings."""
    return link_vectors(vectors).withColumnRenamed("key", "vec_id")
