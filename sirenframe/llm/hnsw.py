"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt to shards of bounded size. Each shard builds its graph by inserting
blocks of vectors: a block is searched in the graph so far (all its rows step by step
together, as array operations), linked to diverse neighbours, and linked back. The
graph is stored as flat neighbour arrays in one file per shard. Every query goes to
every shard, in blocks; the best of each shard are merged.

Largest inner product becomes nearest neighbour by one more dimension that gives all
vectors of a graph the same norm; queries have 0 there, so their order is unchanged.
A shard has one graph per class of norms that differ by less than a factor of 2, so a
few long vectors cannot press the others onto one point; classes whose norms are too
small for a better score are passed over. Equal vectors of a shard are one node with a list of IDs, so copies cannot crowd out
the graph.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sirenframe import shared_dir
from sirenframe.llm.common import staged

K = 20
SHARD_ROWS = 16384
QUERY_BLOCK = 512
LINKS = 16
BUILD_BEAM = 64
SEARCH_BEAM = 256
INSERT_BLOCK = 256
EXPAND = 4
SEED = 7
MANIFEST = "shard long, path string, n_rows long, n_nodes long"
FOUND = "query_row long, query_id long, vec_id long, score double"


class Graph:
    """Layers of a graph; layer i holds nodes[i] (ascending) and neighbours[i], -1 where there is none."""

    def __init__(self, vectors: np.ndarray, nodes: list[np.ndarray], neighbours: list[np.ndarray]):
        self.vectors, self.nodes, self.neighbours = vectors, nodes, neighbours

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, scores) per query, best first; -1 fills up."""
        entry = np.zeros(len(queries), dtype=np.int64)
        for layer in range(len(self.nodes) - 1, 0, -1):
            local, _ = beam_search(
                self.vectors[self.nodes[layer]], self.neighbours[layer], queries, entry, 4
            )
            entry = np.searchsorted(self.nodes[layer - 1], self.nodes[layer][local[:, 0]])
        return beam_search(self.vectors, self.neighbours[0], queries, entry, beam)


def beam_search(
    vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once in one layer; positions and scores, best first."""
    n, rows = len(queries), np.arange(len(queries))
    found = np.full((n, beam), -1, dtype=np.int64)
    scores = np.full((n, beam), -np.inf, dtype=np.float32)
    done = np.ones((n, beam), dtype=bool)
    found[:, 0], done[:, 0] = entry, False
    scores[:, 0] = np.einsum("bd,bd->b", queries, vectors[entry])
    seen = np.zeros((n, len(vectors)), dtype=bool)
    seen[rows, entry] = True
    last = np.zeros((n, len(vectors)), dtype=np.int32)
    active = rows
    while len(active):
        # Scores are sorted, so the first open places are the best ones.
        place = np.argsort(done[active], axis=1, kind="stable")[:, :EXPAND]
        open_ = ~np.take_along_axis(done[active], place, 1)
        done[active[:, None], place] = True
        going = open_.any(axis=1)
        active, place, open_ = active[going], place[going], open_[going]
        if not len(active):
            break
        at = found[active[:, None], place]
        near = neighbours[np.where(open_, at, 0)]
        near[~open_] = -1
        near = near.reshape(len(active), -1)
        safe = np.maximum(near, 0)
        line = active[:, None]
        order = np.broadcast_to(np.arange(near.shape[1], dtype=np.int32), near.shape)
        fresh = (near >= 0) & ~seen[line, safe]
        last[line, np.where(fresh, near, safe)] = np.where(fresh, order, last[line, safe])
        fresh &= last[line, safe] == order
        seen[np.broadcast_to(line, near.shape)[fresh], near[fresh]] = True
        own = np.full(near.shape, -np.inf, dtype=np.float32)
        which = np.nonzero(fresh)
        own[which] = np.einsum("ed,ed->e", queries[active[which[0]]], vectors[near[which]])
        every = np.concatenate([scores[active], own], axis=1)
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(every, best, 1), axis=1, kind="stable"), 1)
        scores[active] = np.take_along_axis(every, best, 1)
        found[active] = np.take_along_axis(np.concatenate([found[active], near], axis=1), best, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), best, 1)
        found[active] = np.where(np.isfinite(scores[active]), found[active], -1)
    return found, scores


def diverse(vectors: np.ndarray, candidates: np.ndarray, scores: np.ndarray, width: int) -> np.ndarray:
    """Up to width of the candidates per row, best first, none closer to a chosen one than to the row.

    Room that is left goes to the best of the others, so no node is poorly linked.
    """
    safe = np.maximum(candidates, 0)
    own = vectors[safe]
    between = own @ own.transpose(0, 2, 1)
    n, m = candidates.shape
    closest = np.full((n, m), -np.inf, dtype=np.float32)
    chosen = np.zeros((n, m), dtype=bool)
    count = np.zeros(n, dtype=np.int64)
    for j in range(m):
        take = (candidates[:, j] >= 0) & (count < width) & (scores[:, j] > closest[:, j])
        chosen[:, j] = take
        count += take
        closest[take] = np.maximum(closest[take], between[take, j])
    rank = np.where(candidates < 0, 2 * m, np.where(chosen, 0, m)) + np.arange(m)
    order = np.argsort(rank, axis=1)[:, :width]
    out = np.take_along_axis(candidates, order, 1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


def build(vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
    """The graph of these vectors, all of one norm; the same for the same input."""
    n = len(vectors)
    rng = np.random.default_rng(SEED)
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int64)
    nodes, neighbours = [], []
    for layer in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level >= layer)
        nodes.append(own)
        neighbours.append(_layer(vectors[own], links * (2 if layer == 0 else 1), beam, rng))
    return Graph(vectors, nodes, neighbours)


def _layer(vectors: np.ndarray, width: int, beam: int, rng: np.random.Generator) -> np.ndarray:
    """Neighbour array of one layer, by insertion of blocks. Position 0 is the entry and goes first."""
    n = len(vectors)
    neighbours = np.full((n, width), -1, dtype=np.int32)
    order = np.concatenate([[0], 1 + rng.permutation(max(0, n - 1))])[:n]
    begin = 0
    while begin < n:
        # Blocks grow with the graph, so that most neighbours are there already.
        block = order[begin : begin + max(1, min(INSERT_BLOCK, begin // 2))]
        queries = vectors[block]
        with_self = queries @ queries.T
        np.fill_diagonal(with_self, -np.inf)
        candidates = np.broadcast_to(block, with_self.shape)
        scores = with_self
        if begin:
            found, own = beam_search(
                vectors, neighbours, queries, np.zeros(len(block), dtype=np.int64), beam
            )
            candidates = np.concatenate([found, candidates], axis=1)
            scores = np.concatenate([own, scores], axis=1)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
        scores = np.take_along_axis(scores, top, 1)
        candidates = np.where(np.isfinite(scores), np.take_along_axis(candidates, top, 1), -1)
        chosen = diverse(vectors, candidates, scores, max(1, width // 2))
        neighbours[block, : chosen.shape[1]] = chosen
        _link_back(vectors, neighbours, block, chosen)
        begin += len(block)
    return neighbours


def _link_back(vectors: np.ndarray, neighbours: np.ndarray, block: np.ndarray, chosen: np.ndarray) -> None:
    """Give every chosen neighbour a link to the node that chose it; full lists are chosen anew."""
    width = neighbours.shape[1]
    source = np.repeat(block, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    own, start, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(start, count)
    for some in np.array_split(np.arange(len(own)), max(1, len(own) // 512)):
        if not len(some):
            continue
        rows = own[some]
        incoming = np.full((len(rows), int(count[some].max())), -1, dtype=np.int64)
        mine = np.isin(target, rows)
        incoming[np.searchsorted(rows, target[mine]), place[mine]] = source[mine]
        both = np.concatenate([neighbours[rows], incoming], axis=1).astype(np.int64)
        # A node may have chosen its chooser: such a link is there already.
        twice = (incoming[:, :, None] == neighbours[rows][:, None, :]).any(axis=2) & (incoming >= 0)
        both[:, width:][twice] = -1
        scores = np.einsum("bmd,bd->bm", vectors[np.maximum(both, 0)], vectors[rows])
        scores = np.where(both >= 0, scores, -np.inf).astype(np.float32)
        top = np.argsort(-scores, axis=1, kind="stable")[:, : 2 * width]
        both, scores = np.take_along_axis(both, top, 1), np.take_along_axis(scores, top, 1)
        neighbours[rows] = diverse(vectors, both, scores, width)


def log_norms(vectors: np.ndarray) -> np.ndarray:
    """Logarithms (base 2) of the norms; squares of huge or tiny numbers are not formed."""
    largest = np.abs(vectors).max(axis=1, initial=0)
    return np.log2(largest) + np.log2(np.linalg.norm(vectors / largest[:, None], axis=1))


def norm_classes(vectors: np.ndarray) -> list[np.ndarray]:
    """Positions by norm, longest class first; each class begins at its longest and ends at half of it."""
    logs = log_norms(vectors)
    order = np.argsort(-logs, kind="stable")
    out, begin = [], 0
    while begin < len(order):
        end = int(np.searchsorted(-logs[order], 1 - logs[order[begin]], side="left"))
        out.append(np.sort(order[begin:end]))
        begin = end
    return out


def one_norm(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by the largest norm, with one more dimension that fills each up to norm 1."""
    vectors = vectors / (np.abs(vectors).max(initial=0) or 1.0)
    squares = np.einsum("nd,nd->n", vectors, vectors)
    top = squares.max(initial=0) or 1.0
    rest = np.sqrt(np.maximum(0, 1 - squares / top))
    return np.concatenate([vectors / np.sqrt(top), rest[:, None]], axis=1).astype(np.float32)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row_no, vec_id, vec) of rows that take part."""
    values = F.col(vec_col).cast("array<double>")
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_col).cast("long").alias("vec_id"),
        values.alias("vec"),
    )
    good = F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("vec", lambda x: x != 0)
    rows = staged(rows.filter(F.col("vec_id").isNotNull() & good), "vectors")
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (sizes[0] if sizes else 0))


def write_index(rows: DataFrame, folder: str, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """Build and store the graph of each shard; the manifest and the number of shards.

    rows are (row_no, vec_id, vec). Files have a new name for each attempt; only those in
    the manifest count.
    """
    shards = max(1, -(-rows.count() // shard_rows))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        group = group.sort_values(["vec_id", "row_no"])
        vectors = np.stack(group["vec"].to_numpy()).astype(np.float64)
        nodes, node_of = np.unique(vectors, axis=0, return_inverse=True)
        members = np.argsort(node_of.ravel(), kind="stable")
        out = {
            "vectors": nodes,
            "starts": np.searchsorted(node_of.ravel()[members], np.arange(len(nodes) + 1)),
            "vec_ids": group["vec_id"].to_numpy(np.int64)[members],
            "rows": group["row_no"].to_numpy(np.int64)[members],
        }
        for c, own in enumerate(norm_classes(nodes)):
            graph = build(one_norm(nodes[own]))
            out[f"class{c}"] = own
            for i, (layer, links) in enumerate(zip(graph.nodes, graph.neighbours)):
                out[f"nodes{c}_{i}"], out[f"neighbours{c}_{i}"] = layer, links
        packed = io.BytesIO()
        np.savez(packed, **out)
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.npz"
        with files.open_output_stream(f"{base}/{name}") as stream:
            stream.write(packed.getbuffer())
        row = (shard, f"{folder}/{name}", len(group), len(nodes))
        return pd.DataFrame([row], columns=["shard", "path", "n_rows", "n_nodes"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards)))
    return staged(dealt.groupBy("shard").applyInPandas(run, MANIFEST), "index"), shards


class Shard:
    """A stored shard, read back."""

    def __init__(self, path: str):
        files, name = pafs.FileSystem.from_uri(path)
        with files.open_input_file(name) as stream:
            stored = np.load(io.BytesIO(stream.read()))
        self.vectors, self.starts = stored["vectors"], stored["starts"]
        self.vec_ids, self.rows = stored["vec_ids"], stored["rows"]
        self.graphs = []
        for c in range(sum(key.startswith("class") for key in stored.files)):
            own = stored[f"class{c}"]
            layers = sum(key.startswith(f"nodes{c}_") for key in stored.files)
            graph = Graph(
                one_norm(self.vectors[own]),
                [stored[f"nodes{c}_{i}"] for i in range(layers)],
                [stored[f"neighbours{c}_{i}"] for i in range(layers)],
            )
            self.graphs.append((own, log_norms(self.vectors[own]).max(), graph))

    def nearest(self, queries: np.ndarray, own_rows: np.ndarray, k: int, beam: int) -> list[list[tuple[float, int]]]:
        """Per query the k best (score, vec_id), without the row of the query itself."""
        # Searched at one length: scores of huge vectors must not overflow.
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        padded = np.concatenate([unit, np.zeros((len(unit), 1))], axis=1).astype(np.float32)
        lengths = log_norms(queries)
        hits: list[list[tuple[float, int]]] = [[] for _ in queries]
        for own, longest, graph in self.graphs:
            # No score exceeds the product of the norms.
            with np.errstate(over="ignore"):
                most = np.exp2(lengths + longest) * (1 + 1e-9)
            asked = np.flatnonzero([len(h) < k or -h[-1][0] <= m for h, m in zip(hits, most)])
            if not len(asked):
                continue
            found, _ = graph.search(padded[asked], min(max(beam, k + 1), len(own)))
            for at, places in zip(asked, found):
                nodes = own[places[places >= 0]]
                for node, score in zip(nodes, _products(self.vectors[nodes], queries[at])):
                    # IDs of a node ascend, so no more than k + 1 of them can count.
                    span = slice(self.starts[node], min(self.starts[node + 1], self.starts[node] + k + 1))
                    hits[at] += [
                        (-float(score), int(i))
                        for i, row in zip(self.vec_ids[span], self.rows[span])
                        if row != own_rows[at]
                    ]
                hits[at] = sorted(hits[at])[:k]
        return [[(-s, i) for s, i in h] for h in hits]


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; beyond the range of doubles they are infinite, never NaN."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = vectors @ query
        wrong = ~np.isfinite(scores)
        if wrong.any():
            large, top = np.abs(vectors[wrong]).max(axis=1), np.abs(query).max()
            scores[wrong] = (vectors[wrong] / large[:, None]) @ (query / top) * large * top
    return scores


_LAST: dict[str, Shard] = {}


def _shard(path: str) -> Shard:
    """The shard this worker read last, or read now."""
    if path not in _LAST:
        _LAST.clear()
        _LAST[path] = Shard(path)
    return _LAST[path]


def nearest_neighbours(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 20,
    k: int = K,
    shard_rows: int = SHARD_ROWS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """query_id, rank, vec_id, score: k nearest of each row whose ID is divisible by every.

    Candidates are all rows but the query's own; nearness is the inner product in double
    precision, ties go to the smaller ID. Rows with a null ID, and vectors that are null,
    empty, zero, hold null or non-finite numbers, or have another length than most, take
    no part. Repeated IDs are rows of their own: each is a query and a candidate. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vec_col)
    manifest, shards = write_index(rows, shared_dir(spark, "graphs"), shard_rows)
    queries = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.select(
        "row_no",
        "vec_id",
        "vec",
        F.pmod(F.xxhash64("row_no"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = _shard(group["path"].iloc[0])
        asked = np.stack(group["vec"].to_numpy()).astype(np.float64)
        found = shard.nearest(asked, group["row_no"].to_numpy(), k, beam)
        out = [
            (row, query, vec_id, score)
            for row, query, hits in zip(group["row_no"], group["vec_id"], found)
            for score, vec_id in hits
        ]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])

    found = (
        dealt.join(manifest.select("shard", "path"), "shard")
        .groupBy("shard", "block")
        .applyInPandas(run, FOUND)
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
