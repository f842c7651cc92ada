"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

1. Nodes. Equal vectors are one node. Nodes of one dimension, of lengths within a ratio of BAND and of one cluster
   (centres are fitted on a bounded sample) make a shard; a cell that is larger is split by hash, small ones share a
   shard. So a shard's size is bounded whatever the lengths and the structure.
2. Graphs. Within a shard, vectors of one band get one more component that gives all the same length, so that the
   graph's cosine neighbourhoods are inner-product neighbourhoods; a band of few vectors is scored as a whole. A
   graph is a set of flat neighbour arrays (one int matrix per level, -1 for none), built in numpy by inserting
   batches that double in size. A shard is a file in the shared folder; the index is a table of their names.
3. Search. A query goes to the shards whose mean vectors have the largest inner products with it. How many, and
   how wide a beam, is measured: on a bounded sample of queries, brute force over all rows gives the true
   neighbours, and the smallest setting whose recall reaches WANTED is taken. A task holds a slice of queries and one
   shard at a time, reads the shards' files, and passes over bands that cannot reach a query's k-th score
   (Cauchy-Schwarz). It gives at most k rows a query; a top-k per query merges them. Scores are exact, in double precision.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches, cut, fresh_path

from .memory import released
from .warc import filesystem

#: Nodes in a shard: SHARD_SCALE times the root of their number, within these bounds and these bytes of vectors.
SHARD_SCALE, SHARD_LEAST, SHARD_MOST, SHARD_BYTES = 32, 4096, 1 << 17, 64 << 20
#: Ratio of lengths in a band; nodes of a band up to which they are scored without a graph.
BAND, FLAT = 1.25, 256
#: Queries of a slice, expected; shards that a task reads, at most.
SLICE_QUERIES, TASK_SHARDS = 4096, 64
#: The bounded samples: vectors on which the centres are fitted (per dimension), queries on which recall is measured.
FIT_ROWS, TUNE_QUERIES = 16384, 128
#: Share of true neighbours that must lie in the shards visited, and recall that the beam must reach on the sample.
REACH, WANTED = 0.99, 0.95
M, M0, EF_BUILD = 16, 32, 80
#: Beams that are tried in turn. Where none reaches WANTED, every node of the shards visited is scored: EXACT.
EF_SEARCH = (112, 192, 320, 512, 768)
EXACT, EXACT_CELLS = 1 << 62, 1 << 23
BATCH, EXPAND, SEEN_BYTES = 1024, 4, 64 << 20


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest per row, in descending order, ties to the smaller column."""
    if sims.shape[1] > 4 * k:
        part = np.sort(np.argpartition(-sims, k - 1, axis=1)[:, :k], axis=1)
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


class Graph:
    """levels[l] is the neighbour matrix of level l over all nodes; entry is a node of the highest level."""

    def __init__(self, vectors: np.ndarray):
        """vectors: float32 [n, d] of equal length. Builds the graph."""
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        rng = np.random.default_rng(17)
        top = np.minimum((-np.log(1.0 - rng.random(n)) / np.log(M)).astype(int), 6)
        self.height = top
        self.levels = [np.full((n, M0 if level == 0 else M), -1, np.int32) for level in range(top.max(initial=0) + 1)]
        self.entry = 0
        done = 0
        while done < n:
            size = min(max(done, 64), BATCH, max(64, SEEN_BYTES // n), n - done)
            self._insert(done, done + size)
            done += size

    def _sims(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.matmul(self.x[ids], q[:, :, None])[:, :, 0]

    def _walk(self, q: np.ndarray, level: int, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ef nodes (ids, similarities; -1 and -inf for none) of each query from its start nodes, in lockstep."""
        adjacent, rows = self.levels[level], np.arange(len(q))
        seen = np.zeros((len(q), len(self.x)), bool)
        beam = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -np.inf, np.float32)
        spent = np.ones((len(q), ef), bool)
        w = min(start.shape[1], ef)
        start = start[:, :w]
        beam[:, :w], sims[:, :w] = start, np.where(start >= 0, self._sims(q, start), -np.inf)
        spent[:, :w] = start < 0
        seen[rows[:, None], np.maximum(start, 0)] |= start >= 0
        active = rows
        while len(active):
            open_sims = np.where(spent[active], -np.inf, sims[active])
            pick = _top(open_sims, min(EXPAND, ef))
            chosen = np.take_along_axis(open_sims, pick, 1) > -np.inf
            more = chosen.any(axis=1)
            active, pick, chosen = active[more], pick[more], chosen[more]
            if not len(active):
                break
            found = []
            for e in range(pick.shape[1]):
                nodes = np.where(chosen[:, e], beam[active, pick[:, e]], -1)
                spent[active, pick[:, e]] |= chosen[:, e]
                near = np.where((nodes >= 0)[:, None], adjacent[np.maximum(nodes, 0)], -1)
                at = np.maximum(near, 0)
                near = np.where((near >= 0) & ~seen[active[:, None], at], near, -1)
                # a node named here is seen from now on; rows where the slot is empty keep what they had
                r, c = np.nonzero(near >= 0)
                seen[active[r], near[r, c]] = True
                found.append(near)
            ids = np.concatenate(found, axis=1).astype(np.int64)
            new = np.where(ids >= 0, self._sims(q[active], np.maximum(ids, 0)), -np.inf)
            all_ids = np.concatenate([beam[active], ids], axis=1)
            all_sims = np.concatenate([sims[active], new], axis=1)
            all_spent = np.concatenate([spent[active], ids < 0], axis=1)
            keep = _top(all_sims, ef)
            beam[active] = np.take_along_axis(all_ids, keep, 1)
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            spent[active] = np.take_along_axis(all_spent, keep, 1)
        return np.where(sims > -np.inf, beam, -1), sims

    def _choose(self, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Diverse neighbours: from the nearest on, a candidate nearer to the node than to those chosen; then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        n, c = cand.shape
        x = self.x[np.maximum(cand, 0)]
        among = np.matmul(x, x.transpose(0, 2, 1))
        chosen = np.zeros((n, c), bool)
        closest = np.full((n, c), -np.inf, np.float32)
        for j in range(c):
            ok = (cand[:, j] >= 0) & (closest[:, j] < sims[:, j]) & (chosen.sum(axis=1) < m)
            chosen[:, j] = ok
            closest = np.where(ok[:, None], np.maximum(closest, among[:, j, :]), closest)
        rank = np.where(cand < 0, 2, np.where(chosen, 0, 1))
        first = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(cand, first, 1)
        if out.shape[1] < m:
            out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
        return out

    def _insert(self, a: int, b: int) -> None:
        nodes = np.arange(a, b)
        q = self.x[a:b]
        start = np.full((b - a, 1), self.entry, np.int64)
        top = self.height[self.entry] if a else -1
        for level in range(len(self.levels) - 1, -1, -1):
            here = self.height[nodes] >= level
            if level <= top:
                wanted = EF_BUILD if here.any() else 1
                got, _ = self._walk(q, level, start, max(wanted, 4))
                start = got
            if not here.any():
                continue
            mine = nodes[here]
            # of the batch itself: the nearest that reach this level
            own = q[here] @ q[here].T
            np.fill_diagonal(own, -np.inf)
            k = min(M0, len(mine))
            inside = _top(own, k)
            cand = mine[inside]
            cand = np.where(np.take_along_axis(own, inside, 1) > -np.inf, cand, -1)
            if level <= top:
                cand = np.concatenate([start[here], cand], axis=1)
            sims = np.where(cand >= 0, self._sims(q[here], np.maximum(cand, 0)), -np.inf)
            links = self._choose(cand, sims, self.levels[level].shape[1] if level else M)
            self.levels[level][mine, : links.shape[1]] = links
            self._link_back(level, mine, links)
        best = a + int(np.argmax(self.height[a:b]))
        if not a or self.height[best] > self.height[self.entry]:
            self.entry = best

    def _link_back(self, level: int, mine: np.ndarray, links: np.ndarray) -> None:
        adjacent = self.levels[level]
        source = np.repeat(mine, links.shape[1])
        target = links.ravel()
        ok = target >= 0
        source, target = source[ok], target[ok]
        near = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        first = np.r_[True, target[1:] != target[:-1]]
        position = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
        few = position < 2 * M0  # of those that name a node, the nearest come into its choice
        source, target, position = source[few], target[few], position[few]
        owners, row = np.unique(target, return_inverse=True)
        for at in range(0, len(owners), BATCH):
            part = (row >= at) & (row < at + BATCH)
            own = owners[at : at + BATCH]
            extra = np.full((len(own), int(position[part].max()) + 1), -1, np.int64)
            extra[row[part] - at, position[part]] = source[part]
            old = adjacent[own]
            extra = np.where((extra[:, :, None] == old[:, None, :]).any(axis=2), -1, extra)
            cand = np.concatenate([old.astype(np.int64), extra], axis=1)
            sims = np.where(cand >= 0, self._sims(self.x[own], np.maximum(cand, 0)), -np.inf)
            adjacent[own] = self._choose(cand, sims, adjacent.shape[1])

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH[0]) -> np.ndarray:
        """Ids of the k nearest found per query (-1 for none)."""
        if not len(self.x):
            return np.full((len(q), k), -1)
        ef = max(ef, k)
        out = []
        block = max(1, min(512, SEEN_BYTES // max(1, len(self.x))))
        for at in range(0, len(q), block):
            part = np.ascontiguousarray(q[at : at + block], np.float32)
            start = np.full((len(part), 1), self.entry, np.int64)
            for level in range(len(self.levels) - 1, 0, -1):
                start, _ = self._walk(part, level, start, 4)
            got, _ = self._walk(part, 0, start, ef)
            out.append(got[:, :k] if got.shape[1] >= k else np.pad(got, ((0, 0), (0, k - got.shape[1])), constant_values=-1))
        return np.concatenate(out)

    def flat(self) -> tuple[bytes, bytes, bytes]:
        """(levels' neighbour arrays of their own nodes, heights, entry) as bytes."""
        parts = [m[self.height >= level].tobytes() for level, m in enumerate(self.levels)]
        return b"".join(parts), self.height.astype(np.int8).tobytes(), int(self.entry).to_bytes(8, "little")

    @classmethod
    def of(cls, vectors: np.ndarray, flat: bytes, heights: bytes, entry: bytes) -> Graph:
        g = cls.__new__(cls)
        g.x = np.ascontiguousarray(vectors, np.float32)
        g.height = np.frombuffer(heights, np.int8).astype(int)
        g.entry = int.from_bytes(entry, "little")
        data, at, g.levels = np.frombuffer(flat, np.int32), 0, []
        for level in range(g.height.max(initial=0) + 1):
            own = g.height >= level
            width = M if level else M0
            m = np.full((len(g.x), width), -1, np.int32)
            size = int(own.sum()) * width
            m[own] = data[at : at + size].reshape(-1, width)
            at += size
            g.levels.append(m)
        return g


def lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, logarithms of the lengths) of rows that are not zero; safe for huge and tiny components."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / most
    norm = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / norm, np.log(most[:, 0]) + np.log(norm[:, 0])


def equal_length(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to at most length 1, with a component added that makes it 1."""
    if not len(x):
        return np.zeros((0, x.shape[1] + 1), np.float32)
    unit, log = lengths(x)
    size = np.exp(log - log.max())[:, None]
    return np.concatenate([unit * size, np.sqrt(np.maximum(0.0, 1.0 - size * size))], axis=1).astype(np.float32)


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def band_of(v: Column) -> Column:
    """The band of a vector's length as a native expression; lengths about 1 share a band."""
    most = F.array_max(F.transform(v, F.abs))
    log = lambda m: F.log(m) + 0.5 * F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / m) * (x / m)))
    # a lambda variable, so that the largest component is found once and not for every component
    return F.floor(F.transform(F.array(most), log)[0] / float(np.log(BAND)) + 0.5).cast("int")


class Shard:
    """A shard's nodes by band, the graphs of its larger bands, and the ids of equal vectors."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, bands: list[tuple[int, int, float]], graphs: list[Graph | None]):
        self.x, self.copies, self.bands, self.graphs = x, copies, bands, graphs

    @classmethod
    def build(cls, x: np.ndarray, copies: np.ndarray, band: np.ndarray) -> Shard:
        """x double [n, d], copies long [n, c] (-1 for none), band int [n]; sorted by band, the longest first."""
        first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(band) else np.empty(0, int)
        bands, graphs = [], []
        for a, b in zip(first, np.r_[first[1:], len(band)]):
            bands.append((int(a), int(b), float(lengths(x[a:b])[1].max())))
            graphs.append(Graph(equal_length(x[a:b])) if b - a > FLAT else None)
        return cls(x, copies, bands, graphs)

    def save(self, uri: str) -> None:
        parts = {"x": self.x, "copies": self.copies, "bands": np.array(self.bands, float).reshape(-1, 3)}
        for i, g in enumerate(self.graphs):
            if g is not None:
                for name, data in zip(("flat", "heights", "entry"), g.flat()):
                    parts[f"{name}{i}"] = np.frombuffer(data, np.uint8)
        held = io.BytesIO()
        np.savez(held, **parts)
        fs, path = filesystem(uri)
        with fs.open_output_stream(path, compression=None) as f:
            f.write(held.getbuffer())

    @classmethod
    def load(cls, uri: str) -> Shard:
        fs, path = filesystem(uri)
        with fs.open_input_stream(path, compression=None) as f:
            z = np.load(io.BytesIO(f.read()))
        bands = [(int(a), int(b), float(t)) for a, b, t in z["bands"]]
        x = z["x"]
        graphs = [Graph.of(equal_length(x[a:b]), *(z[f"{n}{i}"].tobytes() for n in ("flat", "heights", "entry"))) if f"flat{i}" in z else None for i, (a, b, _) in enumerate(bands)]
        return cls(x, z["copies"], bands, graphs)

    def search(self, own: np.ndarray, q: np.ndarray, best: tuple[np.ndarray, np.ndarray], ef: int) -> tuple[np.ndarray, np.ndarray]:
        """best (scores, ids) [queries, k] of the queries (ids own, vectors q), with what this shard adds."""
        unit, log = lengths(q)
        scores, ids = best
        k = scores.shape[1]
        for (a, b, top), graph in zip(self.bands, self.graphs):
            with np.errstate(over="ignore"):
                may = np.flatnonzero(scores[:, -1] <= np.exp(log + top) * (1 + 1e-9))
            step = 512 if graph is None or ef < EXACT else max(1, min(512, EXACT_CELLS // (b - a)))
            for at in range(0, len(may), step):
                rows = may[at : at + step]
                if graph is None:
                    near = np.broadcast_to(np.arange(b - a), (len(rows), b - a))
                elif ef >= EXACT:
                    with np.errstate(over="ignore", invalid="ignore"):
                        sims = np.nan_to_num(q[rows] @ self.x[a:b].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    near = _top(sims, min(k + 1, b - a))
                else:
                    near = graph.search(np.concatenate([unit[rows], np.zeros((len(rows), 1))], axis=1).astype(np.float32), k + 1, ef)
                with np.errstate(over="ignore", invalid="ignore"):
                    found = np.matmul(self.x[a + np.maximum(near, 0)], q[rows][:, :, None])[:, :, 0]
                found = np.where(near < 0, -np.inf, np.nan_to_num(found, nan=-np.inf, posinf=np.inf, neginf=-np.inf))
                copies = self.copies[a + np.maximum(near, 0)]
                ok = (near >= 0)[:, :, None] & (copies >= 0) & (copies != own[rows][:, None, None])
                new = np.where(ok, found[:, :, None], -np.inf).reshape(len(rows), -1)
                new_ids = np.where(ok, copies, NONE).reshape(len(rows), -1)
                all_scores, all_ids = np.concatenate([scores[rows], new], axis=1), np.concatenate([ids[rows], new_ids], axis=1)
                order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                scores[rows], ids[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
        return scores, ids


NONE = np.iinfo(np.int64).max


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """n unit centres of the rows of x by spherical k-means with fixed choices."""
    unit = lengths(x)[0]
    centres = unit[np.random.default_rng(29).permutation(len(unit))[:n]]
    for _ in range(8):
        near = np.argmax(unit @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, unit)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
    return centres


def shard_size(n: int) -> int:
    return int(min(SHARD_MOST, max(SHARD_LEAST, SHARD_SCALE * np.sqrt(n))))


def dealt(rows: DataFrame, k: int, shard_rows: int | None) -> DataFrame:
    """(ids, embedding, dim, band, shard) of the distinct vectors of rows(vec_id, embedding), written.

    Equal vectors become one node with its k + 1 smallest ids, which is all that any k nearest can hold of it; the ids
    are cut to that many before their shuffle, so a vector that a third of the rows share stays small.
    """
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k + 1)
    nodes = first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes.select("ids", "embedding", F.size("embedding").alias("dim"), band_of(F.col("embedding")).alias("band")), "nodes")
    n = nodes.count()
    most = F.lit(shard_rows or shard_size(n)).cast("double")
    least = F.least(most, F.greatest(F.lit(1024.0), F.lit(float(SHARD_BYTES // 8)) / F.col("dim")))
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n")).withColumn("most", least).filter("n > most").collect()
    centres = {}
    for r in sizes:  # dimensions of more nodes than a shard holds
        wanted = min(FIT_ROWS // 16, int(-(-r["n"] // r["most"])))
        own = nodes.filter(F.col("dim") == r["dim"])
        sample = own.filter(F.pmod(F.xxhash64(F.col("ids")[0], F.lit("fit")), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / r["n"]) * (1 << 30))).select("embedding")
        x = np.array([v["embedding"] for v in sample.collect()], float)
        if len(x) >= wanted:
            centres[r["dim"]] = _centres(x, wanted)
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cluster(v: pd.Series) -> pd.Series:
        size = v.map(len).to_numpy()
        out = np.zeros(len(v), np.int32)
        for dim in np.unique(size):
            if dim in sent.value:
                at = np.flatnonzero(size == dim)
                out[at] = np.argmax(lengths(np.stack(v.iloc[at].to_numpy()).astype(float))[0] @ sent.value[dim].T, axis=1)
        return pd.Series(out)

    if centres:
        nodes = cut(nodes.withColumn("cluster", cluster(F.col("embedding"))), "clustered")
    else:
        nodes = nodes.withColumn("cluster", F.lit(0))
    # one row per cell of (dimension, band, cluster)
    cells = nodes.groupBy("dim", "band", "cluster").agg(F.count("*").alias("n")).withColumn("most", least)
    small = F.col("n") < F.col("most") / 4
    before = Window.partitionBy("dim", small).orderBy("band", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    shared = F.concat(F.lit("s"), F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.col("most")).cast("string"))
    cells = cells.withColumn("shared", F.when(small, shared)).withColumn("parts", F.ceil(F.col("n") / F.col("most")))
    part = F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts")).cast("string")
    shard = F.coalesce("shared", F.concat_ws("-", F.col("band").cast("string"), F.col("cluster").cast("string"), part))
    named = nodes.join(cells.select("dim", "band", "cluster", "shared", "parts"), ["dim", "band", "cluster"])
    return cut(named.select("ids", "embedding", "dim", "band", shard.alias("shard")), "dealt")


INDEX = "dim int, shard string, path string, n long, mean array<double>"


def build(nodes: DataFrame, k: int, folder: str) -> DataFrame:
    """The index of dealt() nodes: a row per shard, whose file below folder holds it. Each attempt writes its own name."""
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def graph(b: pd.DataFrame) -> pd.DataFrame:
        b = b.iloc[np.lexsort(([x[0] for x in b["ids"]], -b["band"].to_numpy()))]
        x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
        copies = np.full((len(b), k + 1), -1, np.int64)
        for i, ids in enumerate(b["ids"]):
            copies[i, : len(ids)] = ids
        path = f"{folder}/{uuid.uuid4().hex}.npz"
        Shard.build(x, copies, b["band"].to_numpy()).save(path)
        mean = (x / len(x)).sum(axis=0)
        row = (b["dim"].iloc[0], b["shard"].iloc[0], path, len(b), mean)
        released()
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    return cut(nodes.groupBy("dim", "shard").applyInPandas(graph, INDEX), "hnsw")


def routes(index: DataFrame) -> dict[int, dict]:
    """By dimension the shards' names, files and mean vectors: one row per shard, a hundred thousandth of the table."""
    out: dict[int, dict] = {}
    for r in index.orderBy("dim", "shard").collect():
        at = out.setdefault(r["dim"], {"shard": [], "path": [], "mean": []})
        for c in at:
            at[c].append(r[c])
    for at in out.values():
        mean = np.array(at["mean"], float)
        at["mean"] = mean / max(np.abs(mean).max(), np.finfo(float).tiny)
    return out


def _ways(at: dict, q: np.ndarray) -> np.ndarray:
    """Positions of all shards for each query, the likeliest first."""
    return np.argsort(-(lengths(q)[0] @ at["mean"].T), axis=1, kind="stable")


def search(routed: dict[int, dict], queries: DataFrame, k: int, ef: int, visits: int, slice_queries: int = SLICE_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, embedding array<double>), itself excepted.

    A query meets its `visits` likeliest shards. It is sent once to each group of shards that holds one of them.
    """
    spark = queries.sparkSession
    shards = max((len(at["shard"]) for at in routed.values()), default=1)
    slices = max(1, -(-queries.count() // slice_queries))
    groups = max(1, min(shards, max(-(-2 * spark.sparkContext.defaultParallelism // slices), -(-shards // TASK_SHARDS))))
    sent = spark.sparkContext.broadcast(routed)
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"))
    schema = "query_id long, embedding array<double>, slice int, dim int, part int"

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["embedding"].map(len).to_numpy()
            for dim in np.unique(size):
                at = sent.value.get(int(dim))
                if at is None:
                    continue
                own = b[size == dim]
                ways = _ways(at, np.stack(own["embedding"].to_numpy()).astype(float))[:, :visits]
                part = ways * groups // shards
                for g in np.unique(part):
                    yield own[(part == g).any(axis=1)].assign(dim=int(dim), part=int(g))

    def found(b: pd.DataFrame) -> pd.DataFrame:
        at, g = sent.value[int(b["dim"].iloc[0])], int(b["part"].iloc[0])
        own, q = b["query_id"].to_numpy(np.int64), np.stack(b["embedding"].to_numpy()).astype(float)
        ways = _ways(at, q)[:, :visits]
        scores, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), NONE)
        for s in range(len(at["shard"])):
            rows = np.flatnonzero((ways == s).any(axis=1)) if s * groups // shards == g else ()
            if len(rows):
                scores[rows], ids[rows] = Shard.load(at["path"][s]).search(own[rows], q[rows], (scores[rows], ids[rows]), ef)
        released()
        ok = ids != NONE
        return pd.DataFrame({"query_id": np.repeat(own, ok.sum(axis=1)), "vec_id": ids[ok], "score": scores[ok]})

    near = asked.mapInPandas(spread, schema).groupBy("dim", "part", "slice").applyInPandas(found, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def truth(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, dim, shard: the k nearest of a few queries by brute force over all nodes, for the tuning."""
    asked: dict[int, list] = {}
    for r in queries.select("vec_id", "embedding").collect():
        asked.setdefault(len(r["embedding"]), []).append((r["vec_id"], r["embedding"]))
    sent = queries.sparkSession.sparkContext.broadcast({d: (np.array([i for i, _ in v]), np.array([x for _, x in v], float)) for d, v in asked.items()})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, (own, q) in sent.value.items():
                part = b[b["dim"] == dim]
                if not len(part):
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    sims = np.nan_to_num(q @ np.stack(part["embedding"].to_numpy()).astype(float).T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                at = _top(sims, min(k + 1, len(part)))
                for row, (i, cols) in enumerate(zip(own, at)):
                    rows = [(-sims[row, c], v, part["shard"].iloc[c]) for c in cols for v in part["ids"].iloc[c] if v != i]
                    rows = sorted(rows)[:k]
                    yield pd.DataFrame({"query_id": int(i), "vec_id": [v for _, v, _ in rows], "score": [-s for s, _, _ in rows], "dim": dim, "shard": [s for _, _, s in rows]})

    found = nodes.mapInPandas(near, "query_id long, vec_id long, score double, dim int, shard string")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k).drop("__n")


def tuned(nodes: DataFrame, routed: dict[int, dict], queries: DataFrame, k: int) -> tuple[int, int, float]:
    """(visits, ef, recall on the sample): the least that reach REACH and WANTED on TUNE_QUERIES queries.

    Where no beam does, ef is EXACT: the shards visited are then scored whole, and what is missed lies in other shards only.
    """
    sample = cut(queries.orderBy(F.xxhash64("vec_id")).limit(TUNE_QUERIES), "sample")
    want = truth(nodes, sample, k).collect()
    vectors: dict[int, list] = {}
    for r in sample.collect():
        vectors.setdefault(r["vec_id"], []).append(r["embedding"])
    if not want:
        return 1, EF_SEARCH[0], 1.0
    place: dict[tuple, dict] = {}
    for (i, v) in ((i, v) for i, vs in vectors.items() for v in vs):
        at = routed[len(v)]
        for n, s in enumerate(_ways(at, np.array([v], float))[0], 1):
            held = place.setdefault((i, len(v)), {})
            held[at["shard"][s]] = max(n, held.get(at["shard"][s], 0))
    positions = np.sort([place[r["query_id"], r["dim"]][r["shard"]] for r in want])
    visits = int(positions[int(np.ceil(REACH * len(positions))) - 1])
    worst: dict[int, float] = {}
    for r in want:
        worst[r["query_id"]] = min(worst.get(r["query_id"], np.inf), r["score"])
    reached = 0.0
    for ef in (*EF_SEARCH, EXACT):
        got = search(routed, sample, k, ef, visits).collect()
        reached = sum(r["score"] >= worst[r["query_id"]] - 1e-9 * abs(worst[r["query_id"]]) for r in got if r["query_id"] in worst) / len(want)
        if reached >= WANTED:
            break
    return visits, ef, reached


def nearest(vectors: DataFrame, queries: Column, k: int = 20, shard_rows: int | None = None) -> DataFrame:
    """The k nearest rows, by inner product, of those rows (vec_id, embedding) for which queries holds.

    Rows with a null id or an unusable vector take no part. A repeated (id, vector) counts once; rows of one id are
    not each other's neighbours, and queries of one id are merged into one list. Vectors meet those of their own
    dimension only. Lengths may differ by any factor. A product that overflows is infinite; one that is not a number
    is no neighbour. Ties go to the smaller id. Empty table: empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    nodes = dealt(rows, k, shard_rows)
    routed = routes(build(nodes, k, fresh_path(spark, "hnsw-files")))
    asked = cut(rows.filter(queries), "asked")
    visits, ef, _ = tuned(nodes, routed, asked, k)
    return search(routed, asked, k, ef, visits)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
