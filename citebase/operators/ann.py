"""Approximate nearest neighbours: an inverted index of vector cells.

Centroids are fitted on a bounded sample; every row of the table is then put into the cell of its nearest centroid. A query
looks into the cells whose centroids are nearest to it. Cells are cut into parts of a bounded number of rows, so one that
holds any share of the table is searched by many tasks. How many cells a query looks into is found on the sample, by brute
force among its rows: as many as it takes for the recall wanted. In the whole table neighbours are nearer, so it is as high.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows at most on which centroids are fitted, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 15
#: Cells at most: they bound the broadcast centroids. Rows of one part of a cell.
CELLS_BOUND, PART_ROWS = 4096, 20_000
#: Sampled rows used as queries to find how many cells have to be looked into, neighbours asked for, and the recall wanted.
TRIED, NEIGHBOURS, RECALL = 200, 10, 0.95


def usable(vectors: DataFrame, length: int, id_column: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a vector of the given length without nulls that is not zero."""
    ok = (F.size(vector) == length) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & F.exists(vector, lambda x: x != 0)
    return vectors.where(F.col(id_column).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))


def _matrix(column, length: int) -> np.ndarray:
    m = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, length)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@dataclass
class Cells:
    """Unit centroids and the number of cells that a query looks into."""

    centres: np.ndarray
    probes: int


def needed_probes(x: np.ndarray, centres: np.ndarray) -> int:
    """The least number of cells by which ``TRIED`` of the rows find ``RECALL`` of their nearest ones."""
    tried = x[np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int)]
    near = np.argsort(-(tried @ x.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    order = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell for each query
    cell = (x @ centres.T).argmax(axis=1)
    met = np.sort(np.take_along_axis(order, cell[near], axis=1), axis=None)
    return int(met[math.ceil(RECALL * len(met)) - 1]) + 1


def fit_cells(vectors: DataFrame, cells: int | None = None, id_column: str = "vec_id", vector: str = "embedding") -> Cells:
    """Centroids by k-means on at most ``SAMPLE`` rows, those with the least hash of their id, and the probes they need.

    The number of cells follows the root of the number of rows, up to ``CELLS_BOUND``. No usable row gives no centroid.
    """
    first = vectors.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None or first.n < 1:
        return Cells(np.zeros((0, 0)), 0)
    n, rows = vectors.count(), usable(vectors, first.n, id_column, vector)
    spread = 1 << 40
    low = F.pmod(F.xxhash64("id"), F.lit(spread))
    taken = rows.where(low < int(min(1.0, 2 * SAMPLE / max(1, n)) * spread)).orderBy(low, "id").limit(SAMPLE).select("v").collect()
    x = np.array([r.v for r in taken], dtype=np.float64).reshape(-1, first.n)
    if not len(x):
        return Cells(np.zeros((0, 0)), 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = min(cells or math.ceil(math.sqrt(n)), CELLS_BOUND, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return Cells(centres, needed_probes(x, centres))


def build_index(vectors: DataFrame, cells: Cells, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(cell, part, id, v) of every usable row: one narrow map, and a count of the cells to part them."""
    spark, length = vectors.sparkSession, cells.centres.shape[1]
    handle = spark.sparkContext.broadcast(cells.centres)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array((_matrix(b.column(1), length) @ handle.value.T).argmax(axis=1), pa.int32()), b.column(0), b.column(1)], ["cell", "id", "v"])

    found = usable(vectors, length, id_column, vector).mapInArrow(run, "cell int, id bigint, v array<float>")
    sizes = {r["cell"]: -(-r["count"] // PART_ROWS) for r in found.groupBy("cell").count().collect()}  # at most CELLS_BOUND
    parts = F.coalesce(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))[F.col("cell")], F.lit(1)) if sizes else F.lit(1)
    return found.select("cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "v")


def search(index: DataFrame, cells: Cells, queries: DataFrame, k: int, probes: int | None = None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): about the k nearest rows of each query; ties by id.

    Queries go to the parts of the cells they look into, each part keeps k rows of each query, and those are ranked. Queries
    that are not usable give no row.
    """
    length, look = cells.centres.shape[1], min(len(cells.centres), probes or cells.probes)
    handle = index.sparkSession.sparkContext.broadcast(cells.centres)

    def near(batches):
        for b in batches:
            if b.num_rows:
                score = _matrix(b.column(1), length) @ handle.value.T
                at = np.argsort(-score, axis=1, kind="stable")[:, :look].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.tolist(), pa.list_(pa.int32()))], ["q", "qv", "cells"])

    asked = usable(queries, length, id_column, vector).mapInArrow(near, "q bigint, qv array<float>, cells array<int>").select("q", "qv", F.explode("cells").alias("cell"))
    parts = index.select(F.col("cell").alias("at"), F.col("part").alias("piece")).distinct()
    asked = asked.join(parts, F.col("cell") == F.col("at")).select("q", "qv", "at", "piece")

    def best(qs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []}).astype({"query_id": "int64", "id": "int64", "distance": "float64"})
        a, x = (np.stack(c.to_numpy()).astype(np.float64) for c in (qs["qv"], rows["v"]))
        a, x, ids, out = a / np.linalg.norm(a, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True), rows["id"].to_numpy(), []
        for start in range(0, len(a), 256):
            for q, d in zip(qs["q"].iloc[start : start + 256], 1 - a[start : start + 256] @ x.T):
                some = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                some = np.flatnonzero(d <= d[some].max()) if len(d) > k else some
                keep = some[np.lexsort((ids[some], np.round(d[some], 12)))[:k]]
                out.append(pd.DataFrame({"query_id": q, "id": ids[keep], "distance": d[keep]}))
        return pd.concat(out)

    found = asked.groupBy("at", "piece").cogroup(index.groupBy("cell", "part")).applyInPandas(best, "query_id bigint, id bigint, distance double")
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
