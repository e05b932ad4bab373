"""Exact top-k by integer inner product: a Voronoi kNN join (operator 2).

Vectors become integers, and one more coordinate puts every candidate on a sphere of
the longest vector's radius R: |q|² + R² − 2·(q·v) is then the squared distance of a
query and a candidate, so the highest scores are the nearest neighbours.

1. A bounded sample of pivots (`pivots`) splits space into cells. Each row goes to the
   nearest pivot.
2. Per cell, summaries (rows, greatest distance, the smallest distances) are
   brought to the driver: one row per pivot. From them follows, for every cell of
   queries, a radius within which each of its queries has k neighbours.
3. A candidate is sent to a group of query cells only if the triangle inequality
   lets it lie within that radius of one of them.
4. Each group meets its candidates in blocks of about `block_rows` by
   `group_queries`, in tasks of their own; the best k of all blocks are the answer.

A crowded cell, be it of one repeated vector, is split into many blocks by row, so no
task holds more than one block. Nothing is dropped: the bounds keep ties.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinity take no
part, nor do rows without an id. Rows that share an id are candidates each, though not for
one another; of queries that share an id the k best of all of them are the answer. Shorter vectors count as padded with zeros. Scores are
exact while they fit in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import stored

PIVOTS = 64
GROUP_QUERIES = 512
BLOCK_ROWS = 8192
#: Rows of one id that the summary of a cell makes room for; beyond, cells are not left out.
SAME_ID = 64
#: Relative room for rounding in distances.
SLACK = 1e-6


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale · x) of each usable vector, a row each."""
    x = F.col("_v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    whole = F.transform(x, lambda e: F.floor(e * float(scale)).cast("long"))
    return rows.select("id", whole.alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array as a matrix, padded with zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - (np.cumsum(size) - size)[row]] = flat
    return out


def _lifted(v: np.ndarray, radius2: float) -> np.ndarray:
    v = v.astype(np.float64)
    rest = np.maximum(0.0, radius2 - np.einsum("ij,ij->i", v, v))
    return np.hstack([v, np.sqrt(rest)[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, square))


def _assign(pivots: np.ndarray, radius2: float, width: int):
    """Cell and distance of each row as a candidate, and as a query (without the lift)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width)
            columns = [batch.column(0), batch.column(2), pa.array([x.tobytes() for x in v.astype("<i8")], pa.binary())]
            for points in (
                _lifted(v, radius2),
                np.hstack([v.astype(np.float64), np.zeros((len(v), 1))]),
            ):
                far = _distances(points, pivots)
                cell = far.argmin(1)
                columns += [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(v)), cell])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row_no", "v", "cell", "far", "q_cell", "q_far"])

    return run


_ASSIGNED = "id long, row_no long, v binary, cell int, far double, q_cell int, q_far double"


def top_k(
    vectors: DataFrame, is_query: Column, k: int, *,
    pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, id, score: the k best other rows of each query row.

    `vectors` has (id, v) from `integer_vectors`; `is_query` is a condition on id.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors.withColumn("row_no", F.monotonically_increasing_id()), "vectors")
    squared = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e)
    whole = vectors.agg(F.max(F.size("v")).alias("width"), F.max(squared).alias("radius2")).first()
    answer = "query_id long, rank int, id long, score long"
    if not whole.width:
        return spark.createDataFrame([], answer)
    width, radius2 = whole.width, whole.radius2
    chosen = vectors.orderBy(F.xxhash64("id", "row_no"), "row_no").limit(pivots).toArrow()
    points = _lifted(_matrix(chosen["v"].combine_chunks(), width), radius2)
    cells = stored(vectors.select("id", "v", "row_no").mapInArrow(_assign(points, radius2, width), _ASSIGNED), "cells")
    queries = cells.where(is_query)

    same = vectors.groupBy("id").count().agg(F.max("count").alias("n")).first().n
    held_rows = k + min(same, SAME_ID)
    near = Window.partitionBy("cell").orderBy("far")
    closest = (
        cells.withColumn("n", F.row_number().over(near)).where(F.col("n") <= held_rows)
        .groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("closest"))
    )
    held = cells.groupBy("cell").agg(F.count("*").alias("n")).join(closest, "cell").toPandas()
    asked = queries.groupBy("q_cell").agg(F.count("*").alias("n"), F.max("q_far").alias("far")).toPandas()
    if asked.empty:
        return spark.createDataFrame([], answer)
    groups, sends = _plan(points, held, asked, k + same, group_queries, block_rows)

    of_cell = spark.createDataFrame(groups, "q_cell int, grp int, chunks int, blocks int")
    sent = spark.createDataFrame(sends, "cell int, grp int, least double, chunks int, blocks int")
    spread = lambda n, seed: F.pmod(F.xxhash64("row_no", F.lit(seed)), F.col(n)).cast("int")
    to_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    to_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    left = queries.join(F.broadcast(of_cell), "q_cell").select(
        "grp", spread("chunks", 1).alias("chunk"), to_block, F.col("id").alias("id"), F.col("v").alias("v")
    )
    right = cells.join(F.broadcast(sent), "cell").where(F.col("far") >= F.col("least")).select(
        "grp", to_chunk, spread("blocks", 2).alias("block"), F.col("id").alias("id"), F.col("v").alias("v")
    )
    key = ["grp", "chunk", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        _solve(k), "query_id long, id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _plan(points, held: pd.DataFrame, asked: pd.DataFrame, rows: int, group_queries: int, block_rows: int):
    """From summaries alone: groups of query cells, and what each group must see.

    Returns rows (q_cell, group, chunks, blocks) and (cell, group, least distance to
    its pivot, chunks, blocks). All sizes here are numbers of pivots.
    """
    apart = _distances(points, points)
    room = SLACK * (1.0 + float(np.abs(points).max()) * np.sqrt(points.shape[1]))
    data, closest = held["cell"].to_numpy(), held["closest"].to_list()
    bound = {}
    for cell, reach in zip(asked["q_cell"], asked["far"], strict=True):
        # So many rows this near exist for each query: k, and those with its own id.
        upper = np.sort(np.concatenate([reach + apart[cell, c] + d for c, d in zip(data, closest, strict=True)]))
        radius = upper[rows - 1] if len(upper) >= rows else np.inf
        bound[cell] = apart[cell] - reach - radius - room
    # Neighbouring cells share a group up to its size; a larger cell is cut in chunks.
    order = sorted(zip(apart[0, asked["q_cell"]], asked["q_cell"], asked["n"], strict=True))
    grouped: list[list] = []
    for _, cell, n in order:
        if not grouped or grouped[-1][0] + n > group_queries:
            grouped.append([0, []])
        grouped[-1][0] += n
        grouped[-1][1].append(int(cell))
    groups, sends = [], []
    for g, (n, members) in enumerate(grouped):
        least = np.min([bound[c] for c in members], axis=0)
        reached = [
            (int(c), float(least[c]), int(m))
            for c, d, m in zip(data, closest, held["n"], strict=True)
        ]
        chunks = -(-int(n) // group_queries)
        blocks = max(1, -(-sum(m for _, _, m in reached) // block_rows))
        groups += [(c, g, chunks, blocks) for c in members]
        sends += [(c, g, low, chunks, blocks) for c, low, _ in reached]
    return groups, sends


def _solve(k: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or data.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
        q, v = (np.frombuffer(b"".join(x["v"]), "<i8").reshape(len(x), -1) for x in (queries, data))
        most = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1]
        kind = np.float64 if most < 2.0**53 else np.int64  # exact either way; floats are faster
        ids, right = data["id"].to_numpy(), v.astype(kind).T
        out = []
        for at in range(0, len(q), 128):
            own = queries["id"].to_numpy()[at : at + 128]
            score = q[at : at + 128].astype(kind) @ right
            other = own[:, None] != ids[None, :]
            low = np.where(other, score, score.min() - 1)
            least = np.partition(low, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
            row, col = np.nonzero((low >= least[:, None]) & other)
            order = np.lexsort((ids[col], -score[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, row)
            kept = np.arange(len(row)) - first < k
            out.append(
                pd.DataFrame(
                    {"query_id": own[row[kept]], "id": ids[col[kept]],
                     "score": score[row[kept], col[kept]].astype(np.int64)}
                )
            )
        return pd.concat(out)

    return run
