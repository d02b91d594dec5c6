"""Near-duplicate vectors by an inverted multi-index.

The halves of the unit vectors have a codebook each, and pairs of codes form a grid of cells.
Every vector lies in the cell of its two nearest codes. As a query it visits cells in the order
of their distance, which the multi-sequence algorithm yields from the two sorted lists of
half distances, until so many cells are visited as the target recall asks for: their number is
measured on a sample of queries whose true neighbours are known. Whatever lies in the cells is
then compared in full, in double precision.

Equal vectors form a class, and only classes are compared. Members and queries of a column of
cells are dealt into blocks of bounded size, so a crowded cell is many tasks; each of them tells how
many links every vector has there and, of the links, as many as hold their components together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likewise.llm.graph import components
from likewise.sources.staging import stage

#: Cosine from which two vectors link.
LINK = 0.93

#: Vectors that the codebooks are fitted on, and those of them whose neighbours are looked up
#: in full to measure recall.
SAMPLE = 16_384
PROBES = 1_024

#: Probes with neighbours that it takes; more are drawn from the sample until there are so many.
ENOUGH = 64

#: Recall asked for, measured on the probes, before pairs found from either side are joined.
RECALL = 0.995

#: Vectors that a cell holds on average; the codebooks grow with the table to keep it so.
PER_CELL = 8
CODES = (4, 256)

#: Rows of one column of cells that are compared with as many queries in one task.
BLOCK = 4_096


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very large or small ones neither over- nor underflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = max(1, rows.shape[1] // 2)
    return rows[:, :cut], rows[:, cut:]


def codebook(points: np.ndarray, k: int, seed: int, turns: int = 12) -> np.ndarray:
    """k centres by Lloyd's algorithm, from points spread out at random."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(turns):
        near = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]
    return np.maximum(square, 0)


def nearest_cells(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n cells whose two half distances have the smallest sums, nearest first.

    Multi-sequence: both lists are sorted; a cell is a candidate once its neighbours that are
    nearer in one half have been visited.
    """
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    a, b = left[by_left].tolist(), right[by_right].tolist()
    out: list[tuple[int, int]] = []
    heap, seen = [(a[0] + b[0], 0, 0)], [-1] * len(a)
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append((int(by_left[i]), int(by_right[j])))
        seen[i] = j
        if i + 1 < len(a) and (j == 0 or seen[i + 1] == j - 1):
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or seen[i - 1] >= j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


class Grid:
    def __init__(self, sample: np.ndarray, k: int) -> None:
        left, right = halves(sample)
        self.left, self.right = codebook(left, k, 1), codebook(right, k, 2)

    def half_distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = halves(rows)
        return distances(left, self.left), distances(right, self.right)

    def cell(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = self.half_distances(rows)
        return left.argmin(axis=1), right.argmin(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def classes(vectors: DataFrame) -> DataFrame:
    """(label, size, embedding, node, n): vectors that can link, equal ones once.

    The node is the class's smallest vec_id.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(x, lambda v: v != 0)
    return (
        vectors.where("label IS NOT NULL AND vec_id IS NOT NULL")
        .where(F.coalesce(fine & some, F.lit(False)))
        .groupBy(F.col("label").cast("int").alias("label"), x.alias("embedding"))
        .agg(F.min(F.col("vec_id").cast("bigint")).alias("node"), F.count(F.lit(1)).alias("n"))
        .withColumn("size", F.size("embedding"))
    )


def _grid(rows: DataFrame, n_rows: int) -> tuple[Grid, pd.DataFrame]:
    """The grid, and the sample that it was fitted on (rows with the smallest hashed ids)."""
    sample = rows.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(SAMPLE)
    sample = sample.select("node", "label", "embedding").toPandas()
    n_labels = max(1, sample["label"].nunique())
    k = int(np.clip(np.sqrt(n_rows / n_labels / PER_CELL), *CODES))
    return Grid(unit(np.array(sample["embedding"].tolist(), float)), k), sample


def _met(rows: DataFrame, grid: Grid, probes: pd.DataFrame, link: float) -> pd.DataFrame:
    """(probe, rank, n): how many neighbours a probe meets in the cell that it visits as rank-th."""
    points = unit(np.array(probes["embedding"].tolist(), float))
    labels, nodes = probes["label"].to_numpy(), probes["node"].to_numpy()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = unit(_matrix(batch.column("embedding")))
            label, node = batch.column("label").to_numpy(), batch.column("node").to_numpy()
            left, right = grid.cell(found)
            cells = len(grid.left) * len(grid.right)
            out: dict[tuple[int, int], int] = {}
            for at in range(0, len(points), PROBES):
                own = slice(at, at + PROBES)
                hit = (points[own] @ found.T >= link) & (labels[own, None] == label)
                hit &= nodes[own, None] != node
                probe, row = np.nonzero(hit)
                for p in np.unique(probe):
                    a, b = grid.half_distances(points[at + p : at + p + 1])
                    place = {c: n for n, c in enumerate(nearest_cells(a[0], b[0], cells))}
                    met = row[probe == p]
                    for cell in zip(left[met].tolist(), right[met].tolist(), strict=True):
                        key = (int(nodes[at + p]), place[cell])
                        out[key] = out.get(key, 0) + 1
            columns = list(zip(*((p, r, n) for (p, r), n in out.items()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["probe", "rank", "n"]
            )

    met = rows.select("node", "label", "embedding").mapInArrow(of, "probe long, rank long, n long")
    return met.groupBy("probe", "rank").agg(F.sum("n").alias("n")).toPandas()


def _planted(grid: Grid, probes: pd.DataFrame, link: float) -> pd.DataFrame:
    """The same for one neighbour of each probe that is made up: at ``link``, in any direction."""
    points = unit(np.array(probes["embedding"].tolist(), float))
    aside = np.random.default_rng(3).normal(size=points.shape)
    aside -= (aside * points).sum(axis=1, keepdims=True) * points
    size = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    aside = np.divide(aside, size, out=np.zeros_like(aside), where=size > 1e-9)
    left, right = grid.cell(unit(link * points + np.sqrt(max(0.0, 1 - link * link)) * aside))
    a, b = grid.half_distances(points)
    rows = np.arange(len(points))
    reach = a[rows, left] + b[rows, right]
    rank = [int((x[:, None] + y[None] < d).sum()) for x, y, d in zip(a, b, reach, strict=True)]
    return pd.DataFrame({"probe": probes["node"].to_numpy(), "rank": rank, "n": 1})


def _reach(met: pd.DataFrame, recall: float) -> int:
    """Cells until the share ``recall`` of a probe's neighbours is met on average."""
    share = met["n"] / met.groupby("probe")["n"].transform("sum")
    by = share.groupby(met["rank"]).sum().sort_index().cumsum()
    return int(by.index[(by >= recall * by.iloc[-1] - 1e-9).argmax()]) + 1


def _depth(rows: DataFrame, grid: Grid, sample: pd.DataFrame, link: float, recall: float) -> int:
    """Cells to visit so that the share ``recall`` of a probe's neighbours is met on average.

    Every probe that has neighbours counts the same, however many it has. Probes are drawn until
    enough have some; where the whole sample has too few, made-up neighbours at ``link``, the
    farthest there can be, are to be met as well.
    """
    parts, at, n = [], 0, PROBES
    while at < len(sample):
        parts.append(_met(rows, grid, sample.iloc[at : at + n], link))
        at, n = at + n, 4 * n
        if sum(x["probe"].nunique() for x in parts) >= ENOUGH:
            return _reach(pd.concat(parts), recall)
    met = pd.concat(parts)
    planted = _reach(_planted(grid, sample.head(PROBES), link), recall)
    return max(planted, _reach(met, recall)) if len(met) else planted


def _entries(rows: DataFrame, grid: Grid, depth: int) -> DataFrame:
    """Every vector as a member of its cell, and as a query of the columns of cells it visits.

    (label, col, node, n, is_member, home, cells, embedding): a column holds the cells of one left
    code, ``home`` is the vector's own cell, ``cells`` are all that it visits for a member and those
    of the column for a query.
    """
    width = len(grid.right)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = unit(_matrix(batch.column("embedding")))
            left, right = grid.half_distances(points)
            label, node = batch.column("label").to_pylist(), batch.column("node").to_pylist()
            size = batch.column("n").to_pylist()
            names = ("label", "col", "node", "n", "is_member", "home", "cells", "row")
            out: dict[str, list] = {k: [] for k in names}
            for i in range(len(points)):
                cells = nearest_cells(left[i], right[i], depth)
                visits: dict[int, list[int]] = {}
                for a, b in cells:
                    visits.setdefault(a, []).append(a * width + b)
                home = cells[0][0] * width + cells[0][1]
                every = [x for xs in visits.values() for x in xs]
                for a, own in [(cells[0][0], None), *visits.items()]:
                    row = (label[i], a, node[i], size[i], own is None, home, every if own is None else own, i)
                    for k, v in zip(names, row, strict=True):
                        out[k].append(v)
            vectors = points[out.pop("row")]
            ends = np.arange(len(vectors) + 1, dtype=np.int32) * points.shape[1]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)],
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel())),
                ],
                names=[*out, "embedding"],
            )

    return rows.select("label", "node", "n", "embedding").mapInArrow(
        of,
        "label int, col int, node long, n long, is_member boolean, home int, cells array<int>, "
        "embedding array<double>",
    )


def _visited(cells: pd.Series, homes: np.ndarray) -> np.ndarray:
    """Whether each row's cells hold each of the homes."""
    known, which = np.unique(homes, return_inverse=True)
    out = np.zeros((len(cells), len(known)), bool)
    for i, own in enumerate(cells):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        out[i, at[known[at] == own]] = True
    return out[:, which]


def _compare(link: float):
    """Links between queries and members of one pair of blocks, as edges (a, b, 0) that join what
    links join, and how many rows each vector links with, as (a, a, n).

    A link that is found from both sides counts where the query is the smaller node.
    """

    def of(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 3), np.int64)]
        if not members.empty and not queries.empty:
            held = np.array(members["embedding"].tolist())
            home, node = members["home"].to_numpy(), members["node"].to_numpy()
            rows_of, of_member = members["n"].to_numpy(), np.zeros(len(members), np.int64)
            joined = np.arange(len(members))
            for first in range(0, len(queries), 512):
                part = queries.iloc[first : first + 512]
                own = part["node"].to_numpy()
                close = np.array(part["embedding"].tolist()) @ held.T >= link
                close &= _visited(part["cells"], home) & (own[:, None] != node)
                back = _visited(members["cells"], part["home"].to_numpy()).T
                close &= ~(back & (own[:, None] > node))
                n, size = close @ rows_of, part["n"].to_numpy()
                of_member += size @ close
                some = np.flatnonzero(n)
                out.append(np.stack([own[some], own[some], n[some]], axis=1))
                for i in some:
                    met = np.flatnonzero(close[i])
                    names, at = np.unique(joined[met], return_index=True)
                    ends = node[met[at]]
                    out.append(np.stack([np.full(len(ends), own[i]), ends, np.zeros_like(ends)], axis=1))
                    if len(names) > 1:
                        joined[np.isin(joined, names)] = names[0]
            some = np.flatnonzero(of_member)
            out.append(np.stack([node[some], node[some], of_member[some]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b", "n"])

    return of


def links(
    rows: DataFrame, link: float = LINK, recall: float = RECALL
) -> DataFrame:
    """(a, b, n): edges a != b that join all classes found to link, with n = 0, and rows a = b
    whose n add up to the rows that class a links with. ``rows`` are classes with vectors of one size.
    """
    spark, n_rows = rows.sparkSession, rows.count()
    if not n_rows:
        return spark.createDataFrame([], "a long, b long, n long")
    grid, sample = _grid(rows, n_rows)
    depth = _depth(rows, grid, sample, link, recall)
    entries = stage(_entries(rows, grid, depth), "vector-entries")
    blocks = lambda x: F.ceil(F.count(F.when(x, 1)) / F.lit(BLOCK)).cast("int")
    crowd = entries.groupBy("label", "col").agg(
        blocks(F.col("is_member")).alias("n_members"), blocks(~F.col("is_member")).alias("n_queries")
    )
    dealt = entries.join(crowd.where("n_members > 0 AND n_queries > 0"), ["label", "col"])
    # Every block of members meets every block of queries.
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key, columns = ["label", "col", "block", "query_block"], ["node", "n", "home", "cells", "embedding"]
    # Under names of its own, so that Spark can tell the two sides apart.
    members = (
        dealt.where("is_member")
        .withColumn("block", own("n_members"))
        .withColumn("query_block", every("n_queries"))
        .select(*[F.col(c).alias(c) for c in key + columns])
    )
    queries = (
        dealt.where("NOT is_member")
        .withColumn("query_block", own("n_queries"))
        .withColumn("block", every("n_members"))
        .select(*key, *columns)
    )
    return (
        members.groupBy(*key)
        .cogroup(queries.groupBy(*key))
        .applyInPandas(_compare(link), "a long, b long, n long")
    )


def near_vectors(vectors: DataFrame, link: float = LINK, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine in double precision
    reaches ``link``; a null or zero vector, or one with a null or non-finite component, links
    with nothing, nor do vectors of different lengths. Rows that repeat a vec_id are separate
    vectors with one name. ``n_links`` counts other rows linked directly; the component's name
    is the smallest vec_id reachable; a row is kept when it has that vec_id. A null vec_id
    links with nothing, has no component and is kept. An empty table gives an empty one.
    """
    rows = stage(classes(vectors), "vector-classes")
    sizes = [r["size"] for r in rows.select("size").distinct().collect()]
    pairs = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    for size in sorted(sizes):
        pairs = pairs.unionByName(links(rows.where(F.col("size") == size), link, recall))
    pairs = stage(pairs, "vector-links")
    count = pairs.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_other"))
    named = (
        rows.join(count, "node", "left")
        .join(components(pairs.select("a", "b")), "node", "left")
        .select(
            F.col("label").alias("_label"),
            F.col("embedding").alias("_embedding"),
            (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    own = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    same = (
        (own["label"] == named["_label"])
        & (own["embedding"] == named["_embedding"])
        & own["vec_id"].isNotNull()
    )
    component = F.coalesce("root", "vec_id")
    return own.join(named, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
