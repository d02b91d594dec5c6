"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit universe make every coordinate of the signature: the first one
scatters the shingles, the second one, shifted by k places, orders them for coordinate k.

Documents with equal shingle sets form a class, and only classes are compared. Classes that
share a band meet in a bucket. A group of thousands is never expanded into its pairs: every
bucket is compared with one of its members, and what links is joined into components. Buckets
that still hold several components are compared with other members, then the rest is settled
in full: a class with more than its share of shingles that no other such class has cannot link
with any of them, and the classes left over are compared block by block, components against
components. So every two classes that meet in a bucket end up in one component, or are known
not to link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.llm.graph import components
from likewise.llm.shingling import blocks
from likewise.llm.text import bound_batches
from likewise.llm.workers import begin, give_back
from likewise.sources.staging import stage

#: Words in a shingle.
WIDTH = 5

#: Documents link at this similarity, in hundredths.
LINK = 85

#: Signature: so many bands of so many coordinates. Two sets at the linking similarity miss
#: each other in all bands once in 2.5 million cases.
BANDS, ROWS = 20, 4

#: Near copies in a corpus link from this similarity, in hundredths, and are looked for with so
#: many bands, which miss a pair at it as seldom.
COPY_LINK, COPY_BANDS = 80, 28

#: Members that each bucket is compared with before the rest is settled in full.
ROUNDS = 2

#: Classes of one cluster that are compared with as many others in one task.
SIDE = 256

#: Nodes of classes whose ids are all null lie above all ids.
NO_ID = 1 << 62

_U = np.uint32


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, of the 32-bit universe."""
    x = (x ^ (x >> _U(16))) * _U(0x85EBCA6B)
    x = (x ^ (x >> _U(13))) * _U(0xC2B2AE35)
    return x ^ (x >> _U(16))


def order(x: np.ndarray) -> np.ndarray:
    """The second permutation; all coordinates use it, each at another shift."""
    x = (x ^ (x >> _U(16))) * _U(0x7FEB352D)
    x = (x ^ (x >> _U(15))) * _U(0x846CA68B)
    return x ^ (x >> _U(16))


def signatures(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n coordinates of every set; ``starts`` are the sets' offsets, none of them empty."""
    places = scatter((shingles >> np.uint64(32)).astype(np.uint32))
    out = np.empty((n, len(starts)), np.uint32)
    for k in range(n):
        out[k] = np.minimum.reduceat(order(places + _U(k)), starts)
    return out.T


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key of every band of every signature."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        key = (key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


_PRINTS = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _prints(width: int, bands: int, rows: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("minhash")
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, shingles, at in blocks(batch.column("text"), width):
                size = np.diff(at)
                full = np.flatnonzero(size)
                flat = np.zeros(0, np.int64)
                if len(full):
                    flat = band_keys(
                        signatures(shingles, at[:-1][full], bands * rows), bands, rows
                    ).ravel()
                keys = [
                    hashlib.blake2b(shingles[at[i] : at[i + 1]].tobytes(), digest_size=16).digest()
                    for i in range(b - a)
                ]
                ends = np.concatenate(([0], np.cumsum((size > 0) * bands))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(size, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )
            give_back()

    return of


def _sets(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("minhash")
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, shingles, at in blocks(batch.column("text"), width):
                keys = [
                    hashlib.blake2b(shingles[at[i] : at[i + 1]].tobytes(), digest_size=16).digest()
                    for i in range(b - a)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(at.astype(np.int32)), pa.array(shingles.view(np.int64))
                        ),
                    ],
                    names=["doc_id", "set_key", "shingles"],
                )
            give_back()

    return of


def _node() -> Column:
    hashed = F.xxhash64("set_key").bitwiseAND(F.lit(NO_ID - 1))
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID) + hashed)


def _links(link: int, both: Column, n_a: Column, n_b: Column) -> Column:
    return 100 * both >= link * (n_a + n_b - both)


def _verified(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b, label_a, label_b) that link, by their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(_links(link, both, F.size("of_a"), F.size("of_b")))
        .select("a", "b", "label_a", "label_b")
    )


def _near(link: int, n_a: Column, n_b: Column) -> Column:
    """Whether two sets of these sizes can link at all."""
    return 100 * F.least(n_a, n_b) >= link * F.greatest(n_a, n_b)


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    several = (
        members.groupBy("bucket")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo != hi")
        .select("bucket")
    )
    return members.join(several, "bucket")


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with their components after these links between components (label_a, label_b).

    Only components that a link joins are looked at, not what they are made of.
    """
    roots = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    roots = roots.withColumnRenamed("node", "label")
    moved = members.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label"))
    return stage(moved.select("bucket", "node", "n", "label"), "minhash-members")


def _open(members: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """Members that may still link with a member of another component.

    A shingle that only one of the members has is in no intersection. A member that has too
    many of them links with none.
    """
    nodes = members.select("node").distinct()
    shingles = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    alone = shingles.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    alone = alone.where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("n_alone"))
    left = (
        members.join(alone, "node", "left")
        .withColumn("n_alone", F.coalesce("n_alone", F.lit(0)))
        .where(100 * (F.col("n") - F.col("n_alone")) >= link * F.col("n"))
        .drop("n_alone")
    )
    return _mixed(left)


def _compare(link: int):
    """Links between the two sides of one pair of blocks, members of different components."""

    def of(group: pd.DataFrame) -> pd.DataFrame:
        begin("minhash")
        found: list[tuple[int, int, int, int]] = []
        a = group[group["side"] != 1]
        b = group[group["side"] != 0]
        tokens = np.concatenate([np.asarray(x, np.int64) for x in b["shingles"]] or [np.zeros(0, np.int64)])
        size_b = np.array([len(x) for x in b["shingles"]], np.int64)
        owner = np.repeat(np.arange(len(b)), size_b)
        label_b, node_b = b["label"].to_numpy(), b["node"].to_numpy()
        for node, label, own in zip(a["node"], a["label"], a["shingles"], strict=True):
            own = np.sort(np.asarray(own, np.int64))
            n = len(own)
            may = (label_b != label) & (
                100 * np.minimum(size_b, n) >= link * np.maximum(size_b, n)
            )
            if not may.any():
                continue
            at = np.minimum(np.searchsorted(own, tokens), n - 1)
            both = np.bincount(owner[own[at] == tokens], minlength=len(b))
            linked = may & (100 * both >= link * (size_b + n - both))
            others = zip(node_b[linked], label_b[linked], strict=True)
            found += [(int(node), int(x), int(label), int(y)) for x, y in others]
        return pd.DataFrame(found, columns=["a", "b", "label_a", "label_b"], dtype="int64")

    return of


def _rest(members: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """All links between members of different components that share a bucket, directly or not."""
    hubs = members.groupBy("bucket").agg(F.min("node").alias("b"))
    clusters = components(members.join(hubs, "bucket").select(F.col("node").alias("a"), "b"))
    found = (
        members.select("node", "label")
        .distinct()
        .join(clusters.withColumnRenamed("root", "cluster"), "node")
    )
    sizes = found.groupBy("cluster").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(SIDE)).cast("int").alias("n_blocks")
    )
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    rows = found.join(sizes, "cluster").withColumn("block", block)
    # Every block meets every block of its cluster once, itself included.
    sided = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "node",
        "label",
        "cluster",
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
        F.when(F.col("block") == F.col("other"), 2)
        .when(F.col("block") < F.col("other"), 0)
        .otherwise(1)
        .alias("side"),
    )
    return (
        sided.join(sets, "node")
        .groupBy("cluster", "lo", "hi")
        .applyInPandas(_compare(link), "a long, b long, label_a long, label_b long")
    )


def near_groups(
    docs: DataFrame,
    width: int = WIDTH,
    link: int = LINK,
    bands: int = BANDS,
    rows: int = ROWS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    The component is named by the smallest doc_id reachable over links. A document without
    words links with nothing and is its own component, as is one with fewer words than
    ``width``, unless another has the same words. Rows that repeat a doc_id are one document.
    Null ids come after all others: ``component_id`` is null only where no member has an id.
    A row is kept when its id is the component's, null ids being equal. An empty table gives
    an empty one. Other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = stage(texts.mapInArrow(_prints(width, bands, rows), _PRINTS), "minhash")
    classes = stage(
        prints.where("n_shingles > 0")
        .withColumn("node", _node())
        .groupBy("set_key")
        .agg(
            F.min("node").alias("node"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        ),
        "minhash-classes",
    )
    banded = classes.select("node", "n", F.posexplode("bands").alias("band", "key")).select(
        F.xxhash64("band", "key").alias("bucket"), "node", "n"
    )
    shared = (
        banded.groupBy("bucket")
        .agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
        .where("lo != hi")
        .select("bucket")
    )
    members = stage(banded.join(shared, "bucket"), "minhash-members")

    nodes = members.select("node").distinct()
    wanted = texts.join(nodes, texts["doc_id"] == nodes["node"], "left_semi").unionByName(
        texts.where("doc_id IS NULL")
    )
    sets = stage(
        wanted.mapInArrow(_sets(width), "doc_id long, set_key binary, shingles array<long>")
        .withColumn("node", _node())
        .select("node", "shingles")
        .join(nodes, "node", "left_semi"),
        "minhash-sets",
    )

    members = members.withColumn("label", F.col("node"))
    for turn in range(rounds):
        mixed = _mixed(members)
        rank = F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "node")
        pivots = mixed.groupBy("bucket").agg(
            F.min(F.struct(rank.alias("rank"), "node", "label", "n")).alias("pivot")
        )
        pairs = (
            mixed.join(pivots, "bucket")
            .where("label != pivot.label")
            .where(_near(link, F.col("n"), F.col("pivot.n")))
            .select(
                F.col("node").alias("a"),
                F.col("pivot.node").alias("b"),
                F.col("label").alias("label_a"),
                F.col("pivot.label").alias("label_b"),
            )
            .distinct()
        )
        members = _relabelled(members, stage(_verified(pairs, sets, link), "minhash-links"))
    mixed = stage(_open(stage(_mixed(members), "minhash-mixed"), sets, link), "minhash-open")
    if not mixed.isEmpty():
        members = _relabelled(members, stage(_rest(mixed, sets, link), "minhash-links"))

    roots = members.select("node", F.col("label").alias("root")).distinct()
    named = classes.join(roots, "node", "left").select(
        "set_key", F.coalesce("root", "node").alias("root")
    )
    component = F.coalesce("root", "doc_id")
    component = F.when(component < NO_ID, component)
    return prints.join(named, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, link: int = COPY_LINK, bands: int = COPY_BANDS
) -> DataFrame:
    """The rows of ``docs`` whose document stays, all their columns as they are.

    Documents are near copies from a similarity of ``link`` hundredths. Rows that repeat a doc_id stay or go together. Rows without one name no document: they stay.
    """
    groups = near_groups(docs, link=link, bands=bands)
    gone = groups.where(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = stage(gone.select(F.col("doc_id").alias("_gone")).distinct(), "minhash-dropped")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
