"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors of one length are dealt by hash to shards; each shard is a graph built by one task, and
every vector queries every shard of its length. A query walks greedily down the layers and then
keeps a beam on the ground layer. The beam widens for queries whose hits fill half of it, and
above ``EF_MOST`` a query is compared to the whole shard, which is cheaper there. Each task audits
a sample of its queries against brute force over its shard, and grows the sample until some have
links: while their mean recall (a query's hit on itself left out) is short of ``recall``, the
starting beam doubles. Hits are verified by cosine in double precision, but for those that the
error bound of single precision already decides.

Walks run in lock-step in numpy: a block of queries takes its steps together, so the cost of
a step is one gather and one product for the block. Exactly equal vectors are one class and are
counted by its size. A query that went through a whole shard returns its count there; any other
has few hits and returns them, and a link that either end found counts for both. Links unite
into components through a spanning forest of what a task saw: a group of m copies costs m rows,
never its pairs.

A shard has a sixteenth of the vectors, but 16,384 at least and 262,144 at most, and so has a part
of the queries: every task holds one graph and one part, and what is shuffled grows with
n * n / 262,144.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing, and no vector with one of another length (n_links 0, own component). Equal rows count as
one vector. Rows of one vec_id with unlike vectors each have their own n_links, in which every
other vector counts once for each id that has it; for components they are one node. Rows with a
null id have a null component, no links and are kept; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, hot_keys, spread_join, table
from .components import components

THRESHOLD = 0.9
M, M0, EF_BUILD, EF, EF_MOST = 16, 32, 64, 32, 256
SHARDS, SHARD_LEAST, SHARD_MOST = 16, 1 << 14, 1 << 18
RECALL, AUDIT_EVERY, AUDIT_LINKED = 0.995, 64, 16
QUERY_BLOCK, BATCH, BRUTE_CELLS = 256, 1024, 1 << 24
#: What a query task returns: a link that a beam found, a count over a whole shard, an edge of the
#: spanning forest, and the audit (queries with links, and the sum of their recalls).
PAIR, COUNT, EDGE, AUDIT = range(4)
SEEN = "kind int, a long, ka long, sa int, na long, b long, kb long, sb int, nb long, n double"


def units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square over- or underflows."""
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True, initial=1e-323)
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


class Graph:
    """Raw vectors (for exact cosines), their unit form in single precision, and neighbours by
    layer. Equal ids may have several vectors; ``keys`` tells their classes apart."""

    def __init__(self, raw: np.ndarray, ids: np.ndarray, sizes: np.ndarray, seed: int = 0, keys: np.ndarray | None = None):
        self.raw, self.ids, self.sizes = raw, ids.astype(np.int64), sizes.astype(np.int64)
        self.keys = (np.arange(len(ids)) if keys is None else keys).astype(np.int64)
        self._derive()
        n = len(self.ids)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / math.log(M)).astype(np.int64), 8)
        self.adj: list[np.ndarray] = []

    def _derive(self) -> None:
        self.unit = units(self.raw).astype(np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, raw=self.raw, ids=self.ids, keys=self.keys, sizes=self.sizes, level=self.level, *self.adj)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        g = cls.__new__(cls)
        g.raw, g.ids, g.keys, g.sizes, g.level = (z[x] for x in ("raw", "ids", "keys", "sizes", "level"))
        g.adj = [z[f"arr_{i}"] for i in range(sum(k.startswith("arr_") for k in z.files))]
        g._derive()
        g._index()
        return g

    def _index(self) -> None:
        """Rows of the upper layers: only nodes that reach them have one."""
        self.row = [None] + [np.cumsum(self.level >= i) - 1 for i in range(1, len(self.adj))]

    def neighbours(self, layer: int, nodes: np.ndarray) -> np.ndarray:
        return self.adj[layer][nodes if layer == 0 else self.row[layer][nodes]]

    # -- search ---------------------------------------------------------------------------
    def _greedy(self, q: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        best = np.einsum("qd,qd->q", q, self.unit[at])
        live = np.arange(len(q))
        while len(live):
            nb = self.neighbours(layer, at[live])
            sim = np.einsum("qd,qmd->qm", q[live], self.unit[np.maximum(nb, 0)])
            sim[nb < 0] = -2
            j = sim.argmax(1)
            top = sim[np.arange(len(live)), j]
            up = top > best[live] + 1e-7
            moved = live[up]
            at[moved], best[moved] = nb[up, j[up]], top[up]
            live = moved
        return at

    def _beam(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int = 0, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sims) of the beam of each query, best first; -1 fills."""
        nq, n = len(q), limit or len(self.ids)
        ids = np.full((nq, ef), -1, np.int64)
        sims = np.full((nq, ef), -2.0, np.float32)
        done = np.ones((nq, ef), bool)
        seen = np.zeros((nq, n), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("qd,qd->q", q, self.unit[entry]), False
        seen[np.arange(nq), entry] = True
        live = np.arange(nq)
        wide = 2 if ef <= 64 else 8
        while len(live):
            todo = np.where(done[live], -3.0, sims[live])
            pick = np.argpartition(-todo, min(wide, ef) - 1, axis=1)[:, : min(wide, ef)]
            ok = np.take_along_axis(todo, pick, 1) > -2.5
            some = ok.any(1)
            if not some.all():
                live, pick, ok = live[some], pick[some], ok[some]
                if not len(live):
                    break
            rows = live[:, None]
            node = np.where(ok, ids[rows, pick], 0)
            done[rows, pick] = True
            nb = self.neighbours(layer, node.ravel()).reshape(len(live), -1)
            nb = np.where(np.repeat(ok, nb.shape[1] // ok.shape[1], axis=1), nb, -1)
            nb = np.sort(nb, axis=1)
            safe = np.maximum(nb, 0)
            new = (nb >= 0) & ~seen[rows, safe]
            new[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            # Only unseen neighbours are marked and gathered.
            r, c = np.nonzero(new)
            seen[live[r], nb[r, c]] = True
            sim = np.full(nb.shape, -2.0, np.float32)
            if len(r):
                sim[r, c] = np.einsum("kd,kd->k", q[live[r]], self.unit[nb[r, c]])
            all_s = np.concatenate([sims[live], sim], 1)
            all_i = np.concatenate([ids[live], np.where(new, nb, -1)], 1)
            all_d = np.concatenate([done[live], ~new], 1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sims[live], ids[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_s, all_i, all_d))
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.entry, np.int64)
        for layer in range(len(self.adj) - 1, 0, -1):
            at = self._greedy(q, at, layer)
        return self._beam(q, at, min(ef, len(self.ids)))

    @property
    def entry(self) -> int:
        return int(np.argmax(self.level))

    # -- build ----------------------------------------------------------------------------
    def _select(self, q: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` diverse neighbours: one is taken when it is nearer to the node than to
        any taken before; places that stay free go to the nearest of the rest."""
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        nq, nc = cand.shape
        vec = self.unit[np.maximum(cand, 0)]
        cross = np.matmul(vec, vec.transpose(0, 2, 1))
        took = np.zeros((nq, nc), bool)
        count = np.zeros(nq, np.int64)
        for j in range(nc):
            near = np.where(took, cross[:, j], -2).max(1)
            ok = (cand[:, j] >= 0) & (count < most) & (near < sim[:, j])
            took[:, j] = ok
            count += ok
        rank = np.where(took, 0, 1) * nc + np.arange(nc)
        rank[cand < 0] = 3 * nc
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, first, 1)

    def build(self) -> Graph:
        n = len(self.ids)
        top = int(self.level.max()) if n else 0
        self.adj = [np.full((n, M0), -1, np.int32)] + [np.full((int((self.level >= i).sum()), M), -1, np.int32) for i in range(1, top + 1)]
        self._index()
        if not n:
            return self
        # The highest node comes first so that every walk can start there.
        order = np.concatenate([[self.entry], np.delete(np.arange(n), self.entry)])
        at, put = 1, np.zeros(n, bool)
        put[order[0]] = True
        while at < n:
            batch = order[at : at + max(1, min(BATCH, at))]
            for layer in range(top, -1, -1):
                nodes = batch[self.level[batch] >= layer]
                if len(nodes):
                    self._insert(nodes, layer, put)
            put[batch] = True
            at += len(batch)
        return self

    def _insert(self, nodes: np.ndarray, layer: int, put: np.ndarray) -> None:
        q = self.unit[nodes]
        parts_i, parts_s = [], []
        for k in range(0, len(nodes), QUERY_BLOCK):
            x = q[k : k + QUERY_BLOCK]
            e = np.full(len(x), self.entry, np.int64)
            for up in range(len(self.adj) - 1, layer, -1):
                e = self._greedy(x, e, up)
            i, s = self._beam(x, e, min(EF_BUILD, max(1, int(put.sum()))), layer)
            parts_i.append(i)
            parts_s.append(s)
        cand, sim = np.concatenate(parts_i), np.concatenate(parts_s)
        # Nodes of one batch do not find each other by walking: their nearest join the candidates.
        inner = q @ q.T
        np.fill_diagonal(inner, -2)
        k = min(M, len(nodes) - 1)
        if k > 0:
            near = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            cand = np.concatenate([cand, nodes[near]], 1)
            sim = np.concatenate([sim, np.take_along_axis(inner, near, 1)], 1)
        sim = np.where(cand >= 0, sim, -2)
        most = M if layer == 0 else M // 2
        picked = np.concatenate([self._select(q[a : a + 256], cand[a : a + 256], sim[a : a + 256], most) for a in range(0, len(nodes), 256)])
        adj, row = self.adj[layer], (lambda x: x) if layer == 0 else (lambda x: self.row[layer][x])
        adj[row(nodes), : picked.shape[1]] = picked
        # Reverse links, appended where there is room; full nodes choose again.
        src, dst = np.repeat(nodes, picked.shape[1]), picked.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        u, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = adj.shape[1]
        used = (adj[row(u)] >= 0).sum(1)
        fits = used + count <= width
        slot = np.arange(len(dst)) - np.repeat(first, count)
        okay = np.repeat(fits, count)
        adj[row(dst[okay]), (np.repeat(used, count) + slot)[okay]] = src[okay]
        full = np.nonzero(~fits)[0]
        for k in range(0, len(full), 256):
            f = full[k : k + 256]
            extra = np.full((len(f), min(int(count[f].max()), 4 * width)), -1, np.int64)
            for i, j in enumerate(f):
                c = min(count[j], extra.shape[1])
                extra[i, :c] = src[first[j] : first[j] + c]
            cand = np.concatenate([adj[row(u[f])].astype(np.int64), extra], 1)
            sim = np.einsum("kd,kcd->kc", self.unit[u[f]], self.unit[np.maximum(cand, 0)])
            adj[row(u[f])] = self._select(self.unit[u[f]], cand, np.where(cand >= 0, sim, -2), width)

    # -- range queries ----------------------------------------------------------------------
    def within(self, raw: np.ndarray, threshold: float, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(queries, r, nodes, whole) by blocks: queries[r[i]] is linked with nodes[i]; whole where
        these queries were compared to all nodes. Each query comes once."""
        wide = units(raw)
        unit = wide.astype(np.float32)
        # Twice the most that a single-precision product of unit vectors can be off.
        margin = (raw.shape[1] + 8) * 2.0**-22
        todo, n = np.arange(len(raw)), len(self.ids)
        while len(todo):
            whole = ef >= n or ef > EF_MOST
            block = max(16, BRUTE_CELLS // n) if whole else max(16, min(QUERY_BLOCK, 40_000_000 // max(1, ef * 8)))
            again = []
            for k in range(0, len(todo), block):
                part = todo[k : k + block]
                if whole:
                    sims = unit[part] @ self.unit.T
                    r, hit = np.nonzero(sims >= threshold - margin)
                    sims = sims[r, hit]
                else:
                    ids, sims = self.search(unit[part], ef)
                    near = (sims >= threshold - margin) & (ids >= 0)
                    full = near.sum(1) * 2 > ef
                    again.append(part[full])
                    near = near[~full]
                    r, c = np.nonzero(near)
                    ids, sims, part = ids[~full], sims[~full], part[~full]
                    hit, sims = ids[r, c], sims[r, c]
                unsure = np.nonzero(sims < threshold + margin)[0]
                if len(unsure):
                    exact = np.einsum("kd,kd->k", wide[part[r[unsure]]], units(self.raw[hit[unsure]]))
                    keep = np.ones(len(r), bool)
                    keep[unsure[exact < threshold]] = False
                    r, hit = r[keep], hit[keep]
                yield part, r, hit, whole
            todo, ef = np.concatenate(again) if again else np.empty(0, np.int64), ef * 4

    def _others(self, raw: np.ndarray, threshold: float, ef: int) -> list[set[int]]:
        """The nodes found for each query, without those of its own vector."""
        out: list[set[int]] = [set() for _ in raw]
        for part, r, hit, _ in self.within(raw, threshold, ef):
            ok = (self.raw[hit] != raw[part[r]]).any(1)
            for q, h in zip(part[r[ok]].tolist(), hit[ok].tolist(), strict=True):
                out[q].add(h)
        return out

    def audited(self, raw: np.ndarray, threshold: float, recall: float, ef: int = EF) -> tuple[int, int, float]:
        """The first beam whose recall on the audit sample is enough, the sampled queries that have
        links, and their mean recall at that beam."""
        order = np.random.default_rng(len(raw)).permutation(len(raw))
        linked, truth, at, step = [], [], 0, -(-len(raw) // AUDIT_EVERY)
        while len(linked) < AUDIT_LINKED and at < len(raw):
            some = order[at : at + step]
            for q, t in zip(some.tolist(), self._others(raw[some], threshold, len(self.ids)), strict=True):
                if t:
                    linked.append(q)
                    truth.append(t)
            at, step = at + step, step * 4
        while linked:
            got = self._others(raw[linked], threshold, ef)
            mean = float(np.mean([len(a & b) / len(b) for a, b in zip(got, truth, strict=True)]))
            if mean >= recall or ef > EF_MOST:
                return ef, len(linked), mean
            ef *= 2
        return ef, 0, 1.0


class Forest:
    """Union by least root over a shard's nodes; says which of a query's hits are news."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if np.array_equal(nxt, r):
                self.up[x] = r
                return r
            r = nxt

    def link(self, hits: np.ndarray) -> np.ndarray:
        """One hit for each tree among them; the trees become one."""
        if not len(hits):
            return hits
        r, first = np.unique(self.roots(hits), return_index=True)
        self.up[r] = r[0]
        return hits[first]


def _frame(kind: int, rows: int, **cols) -> pd.DataFrame:
    """Rows of SEEN; nullable integers from the start, for 64-bit keys must not pass through floats."""
    out = {}
    for c, t in (x.split() for x in SEEN.split(", ")):
        v = kind if c == "kind" else cols.get(c)
        if t == "double":
            out[c] = np.full(rows, np.nan) if v is None else np.broadcast_to(np.asarray(v, np.float64), rows)
        else:
            out[c] = pd.array(np.broadcast_to(np.asarray(0 if v is None else v, np.int64), rows).copy(), "Int64")
            if v is None:
                out[c][:] = pd.NA
    return pd.DataFrame(out)


def _digest(x, kind: type) -> tuple:
    """(raw bytes, k1, k2) of a usable vector, else nulls. Minus zero is zero."""
    if x is None:
        return None, None, None
    v = np.asarray([np.nan if c is None else c for c in x] if isinstance(x, list) else x, np.float64)
    if v.ndim != 1 or not len(v) or not np.isfinite(v).all() or not v.any():
        return None, None, None
    raw = (v + 0.0).astype(kind).tobytes()
    return raw, *np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist()


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, shard_rows: int | None = None, report: Callable[[int, float], None] | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row. ``report`` is given the number of audited
    queries with links and their mean recall."""
    shelf = Shelf(vectors.sparkSession, "hnsw")
    # Single components stay single; anything else is kept in double precision.
    kind = np.float32 if dict(vectors.select(F.col(col).alias("x")).dtypes)["x"] == "array<float>" else np.float64

    def prepare(batches):
        for batch in batches:
            raw, k1, k2 = zip(*(_digest(x, kind) for x in batch.column("x").to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["id", "raw", "k1", "k2"])

    rows = shelf.put(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("x")).mapInArrow(prepare, "id long, raw binary, k1 long, k2 long"))
    key = ["k1", "k2"]
    usable = rows.where("raw IS NOT NULL AND id IS NOT NULL")
    classes = shelf.put(usable.groupBy(*key).agg(F.min("id").alias("rep"), F.count_distinct("id").alias("size"), F.count("*").alias("c"), F.first(F.length("raw")).alias("w"), F.first("raw").alias("raw")))
    large = hot_keys(classes, key, rows.count(), "c")
    # A row for each length of vectors: its shards, and as many parts of queries.
    per = F.lit(shard_rows) if shard_rows else F.greatest(F.lit(SHARD_LEAST), F.least(F.lit(SHARD_MOST), F.ceil(F.col("n") / SHARDS)))
    widths = shelf.put(classes.groupBy("w").agg(F.count("*").alias("n")).select("w", F.ceil(F.col("n") / per).cast("int").alias("shards")))
    node = classes.select("rep", "k1", "size", "raw", "w").join(F.broadcast(widths), "w")
    reps = shelf.put(node.withColumn("shard", F.pmod(F.xxhash64("k1"), F.col("shards")).cast("int")))
    vector = lambda pdf: np.frombuffer(b"".join(pdf["raw"]), kind).reshape(len(pdf), -1)

    def grow(key_, pdf):
        pdf = pdf.sort_values(["rep", "k1"], kind="stable")
        g = Graph(vector(pdf), pdf["rep"].to_numpy(), pdf["size"].to_numpy(), seed=int(key_[1]), keys=pdf["k1"].to_numpy()).build()
        return pd.DataFrame({"w": [int(key_[0])], "shard": [int(key_[1])], "graph": [g.dump()]})

    graphs = shelf.put(reps.groupBy("w", "shard").applyInPandas(grow, "w int, shard int, graph binary"))
    # Every vector to every shard of its length; a part of the queries and a graph make a task.
    every = F.sequence(F.lit(0), F.col("shards") - 1)
    asked = reps.select("w", "rep", "k1", "size", "raw", "shard", F.pmod(F.xxhash64("k1", F.lit(1)), F.col("shards")).cast("int").alias("part"), F.explode(every).alias("to"))
    held = graphs.join(F.broadcast(widths), "w").select("w", F.col("shard").alias("to"), "graph", F.explode(every).alias("part"))

    def query(key_, left, right):
        out = []
        if len(left) and len(right):
            g, to = Graph.load(right["graph"].iloc[0]), int(key_[1])
            left = left.sort_values(["rep", "k1"], kind="stable")
            raw, reps_, keys, size, home = vector(left), *(left[c].to_numpy(np.int64) for c in ("rep", "k1", "size", "shard"))
            ef, linked, mean = g.audited(raw, threshold, recall)
            if linked:
                out.append(_frame(AUDIT, 1, na=linked, n=linked * mean))
            forest = Forest(len(g.ids))
            for part, r, hit, whole in g.within(raw, threshold, ef):
                q = part[r]
                other = (g.ids[hit] != reps_[q]) | (g.keys[hit] != keys[q])
                qo, ho = q[other], hit[other]
                if whole:
                    links = np.bincount(r[other], g.sizes[ho], len(part))
                    some = links > 0
                    out.append(_frame(COUNT, int(some.sum()), a=reps_[part[some]], ka=keys[part[some]], sb=to, n=links[some]))
                else:
                    out.append(_frame(PAIR, len(qo), a=reps_[qo], ka=keys[qo], sa=home[qo], na=size[qo], b=g.ids[ho], kb=g.keys[ho], sb=to, nb=g.sizes[ho]))
                cut = np.searchsorted(r, np.arange(len(part) + 1))
                ends = [(p, forest.link(hit[cut[i] : cut[i + 1]])) for i, p in enumerate(part.tolist()) if cut[i] < cut[i + 1]]
                a = np.repeat([reps_[p] for p, _ in ends], [len(x) for _, x in ends]).astype(np.int64)
                b = g.ids[np.concatenate([x for _, x in ends])] if ends else a
                out.append(_frame(EDGE, int((a != b).sum()), a=a[a != b], b=b[a != b]))
        return pd.concat([x for x in out if len(x)] or [_frame(EDGE, 0)])

    seen = shelf.put(asked.groupBy("w", "to", "part").cogroup(held.groupBy("w", "to", "part")).applyInPandas(query, SEEN))
    shelf.drop(graphs)
    if report:
        audit = seen.where(F.col("kind") == AUDIT).agg(F.sum("na").alias("k"), F.sum("n").alias("s")).first()
        report(int(audit["k"] or 0), float(audit["s"] / audit["k"]) if audit["k"] else 1.0)
    # A link counts for both ends, whichever found it; whole comparisons have counted theirs.
    counted = seen.where(F.col("kind") == COUNT).select("a", "ka", "sb", F.col("n").cast("long").alias("n"))
    pair = seen.where(F.col("kind") == PAIR)
    both = pair.select("a", "ka", "sb", "b", "kb", F.col("nb").alias("n")).union(pair.select("b", "kb", "sa", "a", "ka", "na")).distinct()
    links = both.join(counted, ["a", "ka", "sb"], "left_anti").select("a", "ka", "n").union(counted.select("a", "ka", "n")).groupBy(F.col("a").alias("rep"), F.col("ka").alias("k1")).agg(F.sum("n").alias("links"))
    # An id with unlike vectors may stand in several classes.
    known = classes.select(F.col("rep").alias("id")).distinct()
    several = spread_join(usable.select("id", *key), classes.select(*key, "rep"), key, "id", large).where("id <> rep").join(known, "id", "left_semi").select("id", "rep")
    comp = components(seen.where(F.col("kind") == EDGE).select("a", "b").union(several), shelf)

    label = classes.join(links, ["rep", "k1"], "left").join(comp, F.col("rep") == F.col("id"), "left")
    label = shelf.put(label.select(*key, (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    shelf.drop(seen, reps, comp)
    out = spread_join(usable.select("id", *key), label, key, "id", large).select("id", "n_links", "component_id")
    bare = rows.where("raw IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(bare).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS v, vec_id AS u FROM embeddings UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.u)
SELECT r.v AS vec_id, (SELECT count(*) FROM e WHERE e.a = r.v) AS n_links, min(r.u) AS component_id, r.v = min(r.u) AS kept FROM reach r GROUP BY r.v
"""
