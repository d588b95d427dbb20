"""Near-duplicate vectors by a flat, robustly pruned graph.

Vectors are dealt to overlapping cells: each to the ``OVERLAP`` nearest of some well separated
pivots, in as many levels as the data need. In each cell every vector is linked to the neighbours
that robust pruning leaves; the adjacency lists of all cells are united. Then each vector is
searched for in each of its cells: greedily from the cell's medoid to the vector's own place, and
from there over all vectors within twice the wanted distance. Within a cell pruning takes every
vector as a candidate, so each step of a path comes nearer to its goal, and a path to a vector
within the wanted distance never leaves twice that distance: the range search misses nothing that
shares a cell. Pairs are verified in double precision. A cell that can't be divided (many near
copies of one vector) is searched in pairs of blocks. Recall is audited against brute force on a
bounded set of queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without label or id, link with nothing; vectors of unequal length aren't compared; repeated rows are
vectors of their own; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import picked, stored
from .graph import components

COSINE = 0.93
#: Vectors that a cell should hold and may hold; overlap; pivots of all cells together; levels.
CELL_AIM, CELL_MOST, OVERLAP, PIVOTS, LEVELS = 256, 1024, 3, 4096, 6
#: A cell is divided only if no pivot would draw more than this share of it.
LARGEST_SHARE = 0.5
#: Two pivots of a cell are no nearer than this cosine, so near copies never draw two.
PIVOT_COSINE = 0.5
AUDIT_QUERIES = 128


def cosines(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """All cosines of two sets of vectors, in double precision."""
    return v @ w.T / np.outer(np.sqrt((v * v).sum(1)), np.sqrt((w * w).sum(1)))


def prune(similar: np.ndarray) -> list[np.ndarray]:
    """Out-neighbours of each vector: the nearest that is left, again and again, each removing all that are nearer to it."""
    n = len(similar)
    far = 2.0 - 2.0 * similar
    open_ = far.copy()
    np.fill_diagonal(open_, np.inf)
    same = far <= 1e-15  # equal vectors: one of them leads to all
    np.fill_diagonal(same, True)
    lead = same.argmax(1)
    open_[same] = np.inf
    rows, out = np.arange(n), []
    while len(rows):
        nearest = open_[rows].argmin(1)
        on = np.isfinite(open_[rows, nearest])
        rows, nearest = rows[on], nearest[on]
        if not len(rows):
            break
        out.append((rows, nearest))
        shut = far[nearest] < far[rows]
        shut[np.arange(len(rows)), nearest] = True
        part = open_[rows]
        part[shut] = np.inf
        open_[rows] = part
    a = np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)])
    b = np.concatenate([y for _, y in out] or [np.zeros(0, np.int64)])
    copy = np.flatnonzero(lead != np.arange(n))
    a, b = np.concatenate([a, copy, lead[copy]]), np.concatenate([b, lead[copy], copy])
    order = np.argsort(a, kind="stable")
    return np.split(b[order], np.searchsorted(a[order], np.arange(1, n)))


def range_search(similar: np.ndarray, neighbours: list[np.ndarray], least: float) -> np.ndarray:
    """For every vector the vectors that the search finds within its range (a boolean matrix)."""
    n = len(similar)
    degree = np.array([len(x) for x in neighbours])
    begin, flat = np.cumsum(degree) - degree, np.concatenate([*neighbours, np.zeros(0, np.int64)]).astype(np.int64)
    similar_flat = similar.ravel()

    def spread(q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query its place's neighbours, as keys query * n + neighbour, and where those of each query begin."""
        d = degree[u]
        first = np.cumsum(d) - d
        return np.repeat(q * n, d) + flat[np.repeat(begin[u] - first, d) + np.arange(d.sum())], first

    moving = np.flatnonzero(degree > 0)
    at = np.arange(n)
    at[moving] = int(similar.sum(1).argmax())  # the medoid
    moving = moving[degree[at[moving]] > 0]
    while len(moving):
        key, first = spread(moving, at[moving])
        reach = np.maximum.reduceat(similar_flat[key], first)
        better = reach > similar[moving, at[moving]]
        hit = np.flatnonzero(similar_flat[key] == np.repeat(reach, degree[at[moving]]))
        best = key[hit[np.searchsorted(hit, first)]] % n
        at[moving[better]] = best[better]
        moving = moving[better]
    wide = (similar >= 1.0 - 4.0 * (1.0 - least) - 1e-9).ravel()  # twice the distance
    seen = np.zeros(n * n, bool)
    q, u = np.arange(n), at
    seen[q * n + u] = True
    while len(q):
        key, _ = spread(q, u)
        key = key[wide[key]]
        key = np.unique(key[~seen[key]])
        seen[key] = True
        q, u = key // n, key % n
    seen = seen.reshape(n, n)
    return seen & (similar >= least)


def _local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each vector's component within the matrix."""
    root = ids.copy()
    a, b = np.nonzero(linked)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        if (new == root).all():
            return root
        root = new


def _read(df: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(row, id, cell, v): ``cell`` is null where a vector takes no part."""
    df = picked(df, id_column, vector_column, label_column)
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0) & (F.size(v) > 0)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.when(F.coalesce(fine, F.lit(False)) & F.col(id_column).isNotNull() & F.col(label_column).isNotNull(), F.xxhash64(F.col(label_column).cast("string"), F.size(v))).alias("cell"), v.alias("v"))
    return stored(rows, "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pivots(rows: DataFrame, sizes: list, level: int) -> dict[int, np.ndarray]:
    """Well separated vectors of each cell that is too large, from a sample whose size the bounds set."""
    room, want = PIVOTS, {}
    for r in sizes:
        k = min(room, -(-r["count"] // CELL_AIM))
        if k > 1:
            want[r["cell"]] = (k, min(1.0, 4 * k / r["count"]))
            room -= k
    if not want:
        return {}
    shares = rows.sparkSession.createDataFrame([(c, s) for c, (_, s) in want.items()], "cell long, share double")
    bucket = F.pmod(F.xxhash64("row", F.lit(f"pivots {level}")), F.lit(1 << 30))
    sample = rows.join(F.broadcast(shares), "cell").where(bucket < F.col("share") * (1 << 30)).select("cell", "row", "v").orderBy("cell", "row").toArrow().to_pandas()
    out = {}
    for cell, own in sample.groupby("cell"):
        vectors = np.stack(own["v"].to_numpy())
        vectors /= np.sqrt((vectors * vectors).sum(1, keepdims=True))
        chosen: list[np.ndarray] = []
        for x in vectors:
            if len(chosen) < want[cell][0] and (not chosen or (np.stack(chosen) @ x).max() < PIVOT_COSINE):
                chosen.append(x)
        if len(chosen) > 1:
            p = np.stack(chosen)
            nearest = np.bincount((vectors @ p.T).argmax(1), minlength=len(p))
            if nearest.max() <= LARGEST_SHARE * len(vectors):  # else dividing would only repeat one tight group in several cells
                out[int(cell)] = p
    return out


def _deal(rows: DataFrame, pivots: dict[int, np.ndarray], level: int) -> DataFrame:
    """Each vector of a cell with pivots goes to the cells of its nearest ones."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    base = np.uint64(0x9E3779B97F4A7C15)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2).to_numpy()
            for cell in np.unique(cells):
                at = np.flatnonzero(cells == cell)
                own = batch.take(pa.array(at))
                v = _matrix(own.column(3))
                p = shared.value[int(cell)]
                m = min(OVERLAP, len(p))
                near = np.argpartition(-(v @ p.T), m - 1, axis=1)[:, :m]
                new = (np.int64(cell).view(np.uint64) + np.uint64(level)) * base + near.astype(np.uint64) + np.uint64(1)
                new *= base
                new ^= new >> np.uint64(29)
                again = own.take(pa.array(np.repeat(np.arange(len(at)), m)))
                yield pa.RecordBatch.from_arrays([again.column(0), again.column(1), pa.array(new.ravel().view(np.int64)), again.column(3)], names=["row", "id", "cell", "v"])

    return rows.mapInArrow(work, rows.schema)


def cells(rows: DataFrame) -> DataFrame:
    """(row, id, cell, v), each vector in one or more cells, which hold few vectors unless they can't be divided."""
    current, done = rows.where("cell IS NOT NULL"), None
    for level in range(LEVELS):
        sizes = current.groupBy("cell").count().where(F.col("count") > CELL_MOST).orderBy(F.desc("count"), "cell").limit(PIVOTS).collect()
        pivots = _pivots(current, sizes, level)
        if not pivots:
            break
        chosen = F.broadcast(current.sparkSession.createDataFrame([(c,) for c in pivots], "cell long"))
        rest = current.join(chosen, "cell", "left_anti").select("row", "id", "cell", "v")
        done = rest if done is None else done.unionByName(rest)
        current = stored(_deal(current.join(chosen, "cell", "left_semi").select("row", "id", "cell", "v"), pivots, level), "cells")
    return current if done is None else done.unionByName(current)


def links(df: DataFrame, *, least: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, id, n_links) for every vector, edges (u, v) that join linked ids, and the united graph (row, neighbours)."""
    kind = df.schema[id_column].dataType.simpleString()
    rows = _read(df, id_column, vector_column, label_column)
    member = stored(cells(rows).select("row", "id", "cell", "v").dropDuplicates(["row", "cell"]), "members")
    sizes = member.groupBy("cell").agg(F.count("*").alias("size"))
    large = stored(sizes.where(F.col("size") > CELL_MOST), "large")
    homes = member.groupBy("row").agg(F.sort_array(F.collect_list("cell")).alias("homes"))
    blocks = F.when(F.col("size").isNull(), 1).otherwise(F.ceil(F.col("size") / (CELL_MOST // 2)).cast("int"))
    dealt = member.join(homes, "row").join(large, "cell", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = stored(dealt.select("cell", "i", "j", "block", "row", "id", "v", "homes"), "dealt")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        v, row = np.stack(group["v"].to_numpy()), group["row"].to_numpy()
        return pd.DataFrame({"row": row, "neighbours": [row[x] for x in prune(cosines(v, v))]})

    lists = dealt.groupBy("cell", "i", "j").applyInPandas(build, "row long, neighbours array<long>")
    graph = stored(lists.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "graph")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        v, row, block, ids = np.stack(group["v"].to_numpy()), group["row"].to_numpy(), group["block"].to_numpy(), group["id"].to_numpy()
        cell = group["cell"].iloc[0]
        order = np.argsort(row)
        near = []
        for x in group["neighbours"]:
            at = np.searchsorted(row[order], x)
            at[at == len(row)] = 0
            near.append(order[at[row[order][at] == x]])
        similar = cosines(v, v)
        found = range_search(similar, near, least)
        np.fill_diagonal(found, False)
        found |= found.T
        counted = found.copy()
        if group["i"].iloc[0] != group["j"].iloc[0]:
            counted &= block[:, None] != block[None, :]
        lower: dict[int, list[int]] = {}
        for k, homes in enumerate(group["homes"]):
            for h in homes:
                if h >= cell:
                    break
                lower.setdefault(h, []).append(k)
        for own in lower.values():  # pairs that share a smaller cell are counted there
            counted[np.ix_(own, own)] = False
        return pd.DataFrame({"row": row, "id": ids, "n": counted.sum(1), "root": _local_roots(found, ids)})

    searched = dealt.join(graph, "row").groupBy("cell", "i", "j").applyInPandas(search, f"row long, id {kind}, n long, root {kind}")
    searched = stored(searched, "searched")
    counts = searched.groupBy("row").agg(F.sum("n").alias("n"))
    out = rows.select("row", "id", "cell", "v").join(counts, "row", "left").withColumn("n_links", F.coalesce("n", F.lit(0)))
    return out, searched.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")).distinct(), graph


def audit(found: DataFrame, least: float, queries: int = AUDIT_QUERIES) -> float:
    """Links found of a bounded set of queries, as a share of those that brute force finds among all vectors."""
    asked = found.where("cell IS NOT NULL").orderBy(F.xxhash64("row")).limit(queries).select("row", "cell", "v", "n_links").collect()
    if not asked:
        return 1.0
    by_cell: dict[int, list] = {}
    for r in asked:
        by_cell.setdefault(r["cell"], []).append((r["row"], np.array(r["v"])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            rows, home = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for cell, own in by_cell.items():
                at = np.flatnonzero(home == cell)
                if len(at):
                    near = cosines(np.stack([v for _, v in own]), _matrix(batch.column(2).take(pa.array(at)))) >= least
                    total += int((near & (np.array([r for r, _ in own])[:, None] != rows[at][None, :])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    truth = found.where("cell IS NOT NULL").select("row", "cell", "v").mapInArrow(work, "n long").agg(F.sum("n")).first()[0]
    return sum(r["n_links"] for r in asked) / truth if truth else 1.0


def clusters(df: DataFrame, *, least: float = COSINE, id_column: str = "vec_id", least_recall: float = 0.9, **columns) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; raises if the audit finds too few of the links."""
    found, edges, _ = links(df, least=least, id_column=id_column, **columns)
    found = stored(found, "links")
    if (recall := audit(found, least)) < least_recall:
        raise RuntimeError(f"the graph search found {recall:.3f} of the audited links")
    joined = found.select("id", "n_links").join(components(edges).select(F.col("node").alias("id"), "component"), "id", "left")
    out = joined.withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
