"""Exact top-k search as a Voronoi kNN join (operator 7).

Vectors fall into the cells of pivots. Per cell a summary holds its size and radius, and
per cell of queries its radius and largest norm. For a cell pair these bound every inner
product of a query and a vector (|q.f| <= |q||f| around the pivot), which gives each group
of queries a score that its k-th best surely reaches, and the cells that may reach it.
Queries, the small side, are sent to those cells alone; each cell part solves its own, and
the partial answers are merged per query. A large cell is split into parts of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlure.llm.tables import keep

#: Most pivots, so that summaries and cell pairs stay bounded on the driver.
MOST_PIVOTS = 1024
#: Vectors in one part of a cell at most (about), and queries held against it at a time.
PART_ROWS = 20_000
QUERY_BLOCK = 512
#: Relative slack of the floating-point bounds.
SLACK = 1e-9
SOLVED = "query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v, array of floor(scale * x); vectors that are NULL or hold NULL or non-finite components go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return usable.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: floating point while sums stay below 2**53, else integers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    return (q @ x.T).astype(np.int64) if most < 2**53 else q.astype(np.int64) @ x.astype(np.int64).T


def _best(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of ``x`` per query, ties to the smaller vec_id, the query's own id left out."""
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    out = []
    for a in range(0, len(q_ids), QUERY_BLOCK):
        ids, scores = q_ids[a: a + QUERY_BLOCK], _products(q[a: a + QUERY_BLOCK], x)
        own = ids[:, None] == x_ids[None, :]
        top = np.argsort(np.where(own, np.iinfo(np.int64).max, -scores), axis=1, kind="stable")[:, : k + own.sum(axis=1).max(initial=0)]
        row = np.repeat(np.arange(len(ids)), top.shape[1])
        top = top.ravel()
        free = ~own[row, top]
        frame = pd.DataFrame({"query_id": ids[row[free]], "vec_id": x_ids[top[free]], "score": scores[row[free], top[free]]})
        out.append(frame.groupby("query_id", sort=False).head(k))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products.

    ``vectors`` has vec_id and v (integer arrays; shorter ones count as padded with zeros).
    Candidates are all rows but those of the query's own vec_id; ties go to the smaller
    vec_id; a query with fewer candidates gets all; an empty table gives no rows. Of queries
    alike in vec_id the one with the least vector asks for all, so ranks stay unique; as
    candidates each of them counts.
    """
    spark = vectors.sparkSession
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = stats["n"], max(stats["width"] or 0, 1)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MOST_PIVOTS, max(1, math.isqrt(n)))).toPandas()
    pivots, place = np.unique(_matrix(chosen["v"], width), axis=0, return_index=True)
    pivot_ids = chosen["vec_id"].to_numpy()[place]
    square = (pivots**2).sum(axis=1)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _matrix(f["v"], width)
            far = square - 2 * (x @ pivots.T)
            cell = far.argmin(axis=1)
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "query": f["query"], "cell": cell.astype("int32"),
                                "away": np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)), "norm": np.sqrt((x**2).sum(axis=1))})

    marked = vectors.select("vec_id", "v", is_query.alias("query"))
    cells = keep(marked.mapInPandas(assign, "vec_id long, v array<long>, query boolean, cell int, away double, norm double"), "cells")
    summary = cells.groupBy("cell").agg(
        F.count("*").alias("size"), F.max("away").alias("radius"),
        F.max(F.when(F.col("query"), F.col("away"))).alias("q_radius"), F.max(F.when(F.col("query"), F.col("norm"))).alias("q_norm"),
    ).toPandas().sort_values("cell")  # at most MOST_PIVOTS rows
    asking = cells.where("query").groupBy("vec_id").agg(F.min(F.struct("v", "cell", "norm")).alias("least"), F.count("*").alias("copies"))
    own = asking.agg(F.max("copies")).first()[0] or 1  # rows that a query leaves out, at most
    plan = _cell_pairs(pivots, summary, k + own)
    parts = {int(c): max(1, -(-int(s) // PART_ROWS)) for c, s in zip(summary["cell"], summary["size"])}
    needs = {int(g): [int(j) for j in js] for g, js in plan.items()}
    radius = dict(zip(summary["cell"].astype(int), summary["radius"]))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _matrix(f["v"], width)
            middle, reach = x @ pivots.T, f["norm"].to_numpy()
            # Pivots are candidates themselves: the k-th best of them is a floor, too.
            seen = np.sort(np.where(pivot_ids == f["vec_id"].to_numpy()[:, None], -np.inf, middle), axis=1)
            floor = seen[:, -k] * (1 - SLACK * np.sign(seen[:, -k])) - 1 if len(pivots) >= k else np.full(len(f), -np.inf)
            for i, (g, vec_id, v) in enumerate(zip(f["cell"], f["vec_id"], f["v"])):
                js = needs[int(g)]
                low = max(needed_floor[int(g)], floor[i])
                js = [j for j in js if middle[i, j] + reach[i] * radius[j] * (1 + SLACK) + 1 >= low]
                rows = [(j, p) for j in js for p in range(parts[j])]
                yield pd.DataFrame({"vec_id": vec_id, "v": [v] * len(rows), "cell": [r[0] for r in rows], "part": [r[1] for r in rows]})

    needed_floor = _floors(pivots, summary, k + own)
    queries = asking.select("vec_id", "least.*").mapInPandas(send, "vec_id long, v array<long>, cell int, part int")
    sizes = F.create_map(*[F.lit(x) for c, p in parts.items() for x in (c, p)])
    data = cells.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), sizes[F.col("cell")].cast("long")).cast("int").alias("part"))

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return _best(q["vec_id"].to_numpy(), _matrix(q["v"], width), x["vec_id"].to_numpy(), _matrix(x["v"], width), k)

    solved = queries.groupBy("cell", "part").cogroup(data.groupBy("cell", "part")).applyInPandas(solve, SOLVED)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _cell_bounds(pivots: np.ndarray, summary: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    groups = summary[summary["q_norm"].notna()]
    middle = pivots[groups["cell"]] @ pivots[summary["cell"]].T
    norms = np.sqrt((pivots[summary["cell"]] ** 2).sum(axis=1))
    spread = groups["q_radius"].to_numpy()[:, None] * norms + groups["q_norm"].to_numpy()[:, None] * summary["radius"].to_numpy()
    spread = spread * (1 + SLACK) + 1
    return groups, middle, spread, summary["size"].to_numpy()


def _floors(pivots: np.ndarray, summary: pd.DataFrame, rows: int) -> dict[int, float]:
    """Per cell of queries, a score that ``rows`` vectors surely reach, a query's own ones among them (-inf: fewer rows)."""
    groups, middle, spread, size = _cell_bounds(pivots, summary)
    out = {}
    for i, g in enumerate(groups["cell"]):
        low = middle[i] - spread[i]
        order = np.argsort(-low)
        reached = np.flatnonzero(np.cumsum(size[order]) >= rows)
        out[int(g)] = float(low[order[reached[0]]]) if len(reached) else -math.inf
    return out


def _cell_pairs(pivots: np.ndarray, summary: pd.DataFrame, rows: int) -> dict[int, np.ndarray]:
    groups, middle, spread, _ = _cell_bounds(pivots, summary)
    floors = _floors(pivots, summary, rows)
    cells = summary["cell"].to_numpy()
    return {int(g): cells[middle[i] + spread[i] >= floors[int(g)]] for i, g in enumerate(groups["cell"])}
