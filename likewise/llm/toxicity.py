"""Toxicity by the nearest labelled examples.

The examples are a bounded sample of the labelled rows. Every word of theirs is a term; its
document frequency is counted over all documents, and its weight grows with what it says about
the label (G statistic among the examples) but is never 0, so every text that shares a word with
an example has neighbours. Examples lie in blocks of an inverted index that holds, for every term
and block, the largest weight: a block whose bound cannot reach the nearest examples found so far
isn't looked at, so the nearest examples by weighted TF-IDF cosine are exact. Their distance-weighted vote is calibrated by
what such votes have meant for the examples themselves, each one left out in turn.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.llm.text import bound_batches
from likewise.llm.workers import begin, give_back, remembered
from likewise.sources.staging import stage

#: Labelled rows of either label that serve as examples; this bounds the fit and the index.
EXAMPLES = 3000

#: Nearest examples that vote.
NEAREST = 15

#: Examples in a block of the index, and blocks that are looked at first.
BLOCK, FIRST = 64, 8

#: A term is frequent if more than one in so many examples hold it.
FREQUENT = 16

#: Texts whose neighbours are searched at once.
TOGETHER = 64

#: Rows whose id falls into remainder 0 of so many are held out from learning.
FOLDS = 5

# A-Z become a-z, ASCII letters, digits and all other scripts form words.
_WORD = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 or 48 <= i <= 57 else 32
    for i in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    begins = np.cumsum(sizes) - sizes
    return np.repeat(starts - begins, sizes) + np.arange(int(sizes.sum()))


@dataclass
class Index:
    """Postings of the examples, which lie in blocks.

    A term that few examples hold has its postings; one that many hold, a frequent one, has a
    weight for every place, and the largest of every block. ``row`` is its row there, -1 for others.
    """

    ids: np.ndarray
    toxic: np.ndarray
    first: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    row: np.ndarray = field(init=False)
    frequent: np.ndarray = field(init=False)
    largest: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n_blocks = -(-len(self.ids) // BLOCK)
        held = np.diff(self.first)
        many = np.flatnonzero(held > max(BLOCK, len(self.ids) // FREQUENT))
        self.row = np.full(len(held), -1, np.int64)
        self.row[many] = np.arange(len(many))
        self.frequent = np.zeros((len(many), n_blocks * BLOCK))
        at = _ranges(self.first[many].astype(np.int64), held[many])
        self.frequent[np.repeat(np.arange(len(many)), held[many]), self.place[at]] = self.weight[at]
        self.largest = self.frequent.reshape(len(many), n_blocks, BLOCK).max(axis=2)

    def __reduce__(self) -> tuple:
        return Index, (self.ids, self.toxic, self.first, self.place, self.weight)

    @classmethod
    def of(cls, ids: np.ndarray, toxic: np.ndarray, vectors: list, n_terms: int) -> Index:
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        # Examples with the same heaviest terms, of those that others have too, share a block,
        # which keeps its bound low.
        shared = np.bincount(term, minlength=n_terms) > 1
        lead = []
        for t, w in vectors:
            own = np.flatnonzero(shared[t])
            best = own[np.argsort(-w[own], kind="stable")[:2]]
            lead.append(tuple(t[best].tolist()) or (n_terms,))
        order = np.array(sorted(range(len(ids)), key=lambda i: (lead[i], int(ids[i]))), np.int64)
        place_of = np.empty(len(ids), np.int64)
        place_of[order] = np.arange(len(ids))
        place = np.repeat(place_of, sizes)
        by_term = np.lexsort((place, term))
        first = np.searchsorted(term[by_term], np.arange(n_terms + 1))
        return cls(
            ids[order],
            toxic[order],
            first.astype(np.int32),
            place[by_term].astype(np.int32),
            weight[by_term],
        )

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and cosines of the k examples nearest to a vector, cosines above 0 only."""
        return next(self.all_nearest(np.array([len(t)]), t, w, k))

    def all_nearest(
        self, sizes: np.ndarray, t: np.ndarray, w: np.ndarray, k: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for many vectors, of ``sizes`` terms each, one after another.

        What the rarer terms contribute to every example is summed for all vectors at once, as are
        the bounds of all blocks: the largest such sum of a block, and the frequent terms' largest
        weights there. The blocks of the highest bounds are finished first; then all examples
        whose own bounds reach the k-th cosine found there. Equal cosines are ordered by example id.
        """
        n_places = self.frequent.shape[1]
        n_blocks = n_places // BLOCK
        vector = np.repeat(np.arange(len(sizes)), sizes)
        row = self.row[t]
        rare = row < 0
        held = self.first[t[rare] + 1] - self.first[t[rare]]
        at = _ranges(self.first[t[rare]].astype(np.int64), held)
        known = np.bincount(
            np.repeat(vector[rare] * n_places, held) + self.place[at],
            np.repeat(w[rare], held) * self.weight[at],
            minlength=len(sizes) * n_places,
        ).reshape(len(sizes), n_places)
        asked = np.zeros((len(sizes), len(self.frequent)))
        asked[vector[~rare], row[~rare]] = w[~rare]
        more = asked @ self.largest
        bounds = known.reshape(len(sizes), n_blocks, BLOCK).max(axis=2, initial=0.0) + more
        ends = np.cumsum(sizes)
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            own = ~rare[a:b]
            rows, weights = row[a:b][own], w[a:b][own]
            yield self._best(known[i], bounds[i], more[i], rows, weights, k)

    def _best(
        self, known: np.ndarray, bound: np.ndarray, more: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        best, place = np.zeros(0), np.zeros(0, np.int64)
        first = np.argsort(-bound, kind="stable")[:FIRST]
        first = first[bound[first] > 0]
        slots = np.arange(BLOCK)
        for wave in range(2):
            least = best[-1] - 1e-11 if len(best) == k else 0.0
            if wave == 0:
                looked_at = (first[:, None] * BLOCK + slots).ravel()
            else:
                bound[first] = 0.0
                blocks = np.flatnonzero((bound > 0) & (bound >= least))
                looked_at = (blocks[:, None] * BLOCK + slots).ravel()
                looked_at = looked_at[known[looked_at] + np.repeat(more[blocks], BLOCK) >= least]
            if not len(looked_at):
                continue
            cosine = known[looked_at] + weights @ self.frequent[rows[:, None], looked_at]
            found = np.flatnonzero((cosine > 0) & (cosine >= least))
            best = np.concatenate((best, cosine[found]))
            place = np.concatenate((place, looked_at[found]))
            if len(best) > k:  # those below the k-th by more than what rounding can change go first
                high = best >= np.partition(best, -k)[-k] - 1e-11
                best, place = best[high], place[high]
            top = np.lexsort((self.ids[place], -np.round(best, 12)))[:k]
            best, place = best[top], place[top]
        return place, best


def _held(table: DataFrame) -> str:
    """The name under which every executor holds a staged table of one file.

    Executors fetch the file themselves; the driver knows no more of it than where it lies.
    """
    path = next(f for f in table.inputFiles())
    table.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _column(name: str, column: str) -> pa.ChunkedArray:
    return pq.read_table(SparkFiles.get(name), columns=[column]).column(column)


@remembered("toxicity")
def _numbers(name: str) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(_column(name, "word").to_pylist())}


@remembered("toxicity")
def _weights(name: str) -> np.ndarray:
    return _column(name, "weight").to_numpy()


@remembered("toxicity")
def _index(name: str) -> Index:
    return pickle.loads(_column(name, "index")[0].as_py())


@dataclass
class Model:
    """What a score follows from: names of files that executors hold, and the calibration."""

    #: The terms, in order; what each counts: its inverse document frequency times what it says about
    #: the label; the index of the examples. None without examples.
    term_file: str | None = None
    weight_file: str | None = None
    index_file: str | None = None
    #: Votes and the score that each of them, up to the next, stands for.
    votes: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(1))
    #: The score where no example shares a term.
    unknown: float = 0.0

    @property
    def terms(self) -> list[bytes]:
        return [] if self.term_file is None else _column(self.term_file, "word").to_pylist()

    @property
    def number(self) -> dict[bytes, int]:
        return _numbers(self.term_file)

    @property
    def index(self) -> Index | None:
        return None if self.index_file is None else _index(self.index_file)

    def vectors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many terms each text has, all terms, and their TF-IDF weights, of length 1 per text."""
        get, none, n_terms = self.number.get, repeat(-1), len(self.number)
        found = [list(map(get, words(text), none)) for text in texts]
        text = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        term = np.fromiter(chain.from_iterable(found), np.int64, len(text))
        known = term >= 0
        key, count = np.unique(text[known] * n_terms + term[known], return_counts=True)
        text, term = np.divmod(key, max(1, n_terms))
        weight = (1 + np.log(count)) * _weights(self.weight_file)[term]
        norm = np.sqrt(np.bincount(text, weight * weight, minlength=len(texts)))
        return np.bincount(text, minlength=len(texts)), term, weight / norm[text]

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (1.05 - np.minimum(cosine, 1))
        return float(weight @ self.index.toxic[place] / weight.sum())

    def score(self, place: np.ndarray, cosine: np.ndarray) -> float:
        if not len(place):
            return self.unknown
        at = np.searchsorted(self.votes, self.vote(place, cosine), side="right") - 1
        return float(self.scores[max(at, 0)])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best never-falling step function of x, by pooling neighbours that fall."""
    at, which = np.unique(x, return_inverse=True)
    w = np.bincount(which, weight)
    means = np.bincount(which, weight * y) / w
    pools: list[list[float]] = []
    for x0, mean, w0 in zip(at, means, w, strict=True):
        pools.append([x0, mean, w0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            _, m, v = pools.pop()
            p = pools[-1]
            p[1], p[2] = (p[1] * p[2] + m * v) / (p[2] + v), p[2] + v
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def _examples(docs: DataFrame, labelled: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, toxic, text): of each label the rows whose hashed ids are smallest."""
    known = labelled.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    order = F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(7))
    some = [
        known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_label) for y in (0, 1)
    ]
    chosen = stage(some[0].unionByName(some[1]), "toxicity-chosen")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id"  # at most 2 * per_label rows
    )
    # Equal texts with the same label say the same thing once; any others speak for themselves.
    one = texts.where("text IS NOT NULL").groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return stage(one, "toxicity-examples")


def _example_words(examples: DataFrame) -> DataFrame:
    """(word, a, b): every word of the examples, in how many toxic and other ones it is found."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            texts = batch.column("text").cast(pa.binary())
            for text, toxic in zip(texts, batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(set(words(text.as_py() or b"")))
            held = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(held, pa.binary()),
                    pa.array([counts[1][x] for x in held], pa.int64()),
                    pa.array([counts[0][x] for x in held], pa.int64()),
                ],
                names=["word", "a", "b"],
            )
            give_back()

    counted = examples.select("toxic", "text").mapInArrow(of, "word binary, a long, b long")
    return counted.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _frequencies(docs: DataFrame, model: Model) -> DataFrame:
    """(term, n): in how many documents each term is found, counted in every task, then summed."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        get = model.number.get
        n = np.zeros(len(model.number), np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                found = set(map(get, set(words(text.as_py() or b""))))
                found.discard(None)
                n[list(found)] += 1
            give_back()
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array(n[held], pa.int64())], names=["term", "n"]
        )

    counted = docs.select("text").mapInArrow(of, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def _weighted(terms: DataFrame, frequencies: DataFrame, n_docs: int, n1: int, n0: int) -> DataFrame:
    """(weight): what the terms count, in their order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy().astype(float) for c in ("a", "b", "n"))
            idf = np.log((n_docs + 1) / (n + 1)) + 1
            weight = idf * np.sqrt(1 + g_statistic(a, b, n1, n0))
            yield pa.RecordBatch.from_arrays([pa.array(weight)], names=["weight"])

    found = terms.drop("word").join(frequencies, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.repartition(1).sortWithinPartitions("term").mapInArrow(of, "weight double")


def _numbered(found: DataFrame) -> DataFrame:
    """(term, word, a, b): the words in order and their numbers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 0
        for batch in batches:
            number = pa.array(np.arange(first, first + len(batch)), pa.int64())
            first += len(batch)
            columns = [number, *(batch.column(c) for c in ("word", "a", "b"))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "word", "a", "b"])

    # the words of a bounded number of examples
    ordered = found.repartition(1).sortWithinPartitions("word")
    return ordered.mapInArrow(of, "term long, word binary, a long, b long")


def g_statistic(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log-likelihood ratio of words found in a of n1 toxic and b of n0 other examples."""
    n = n1 + n0

    def part(seen: np.ndarray, total: int, row: np.ndarray) -> np.ndarray:
        expected = np.maximum(row * total / n, 1e-300)
        return seen * np.log(np.where(seen > 0, seen / expected, 1.0))

    held = a + b
    ratio = part(a, n1, held) + part(b, n0, held) + part(n1 - a, n1, n - held) + part(n0 - b, n0, n - held)
    return np.maximum(2 * ratio, 0.0)


def fit(
    docs: DataFrame,
    labelled: DataFrame,
    per_label: int = EXAMPLES,
    nearest: int = NEAREST,
) -> Model:
    """Learn from the labelled rows given, texts being looked up in ``docs`` by doc_id.

    The examples' terms, weights and index are written by executors and read by executors; the
    driver receives a vote for each of at most ``2 * per_label`` examples. Without labelled rows of both
    kinds every score is the share of toxic ones among those there are, 0 if there are none.
    """
    bound_batches(docs.sparkSession)
    examples = _examples(docs, labelled, per_label)
    share = {
        r["toxic"]: r["n"]
        for r in labelled.where("toxic IS NOT NULL")
        .groupBy(F.col("toxic").cast("int").alias("toxic"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    model = Model()
    total = share.get(0, 0) + share.get(1, 0)
    model.unknown = share.get(1, 0) / total if total else 0.0
    terms = stage(_numbered(_example_words(examples)), "toxicity-terms")
    if terms.isEmpty():
        return model
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model.term_file = _held(terms)
    frequencies = _frequencies(docs, model)
    weights = _weighted(terms, frequencies, docs.count(), sizes.get(1, 0), sizes.get(0, 0))
    model.weight_file = _held(stage(weights, "toxicity-weights"))
    vectors = stage(_vectors(examples, model), "toxicity-vectors")
    # At most 2 * per_label rows, so one task can take them.
    packed = vectors.coalesce(1).mapInArrow(_indexed(model), "index binary")
    model.index_file = _held(stage(packed, "toxicity-index"))
    # What a vote means: the examples' own, each without itself, weighted back to all rows.
    rows = _own_votes(vectors, model, nearest).toArrow()
    truth = rows["toxic"].to_numpy().astype(float)
    stands_for = np.array([share.get(y, 0) / max(1, sizes.get(y, 0)) for y in (0, 1)])
    weight = stands_for[truth.astype(int)]
    vote = rows["vote"].to_numpy()
    lone = np.isnan(vote)
    if not lone.all():
        model.votes, model.scores = isotonic(vote[~lone], truth[~lone], weight[~lone])
    if lone.any():
        model.unknown = float(truth[lone] @ weight[lone] / weight[lone].sum())
    return model


def _indexed(model: Model):
    """The index of all vectors that a task is given, as one row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
        made = [
            (t.values.to_numpy().astype(np.int64), w.values.to_numpy())
            for t, w in zip(rows["t"], rows["w"], strict=True)
        ]
        toxic = rows["toxic"].to_numpy().astype(np.float64)
        index = Index.of(rows["doc_id"].to_numpy(), toxic, made, len(model.number))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(index)], pa.binary())], names=["index"])
        give_back()

    return of


def _vectors(examples: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxic, t, w): the examples' terms and weights."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sizes, t, w = model.vectors([x or b"" for x in texts])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("toxic"),
                    pa.ListArray.from_arrays(offsets, pa.array(t.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(w)),
                ],
                names=["doc_id", "toxic", "t", "w"],
            )
            give_back()

    plain = examples.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", "text")
    return plain.mapInArrow(of, "doc_id long, toxic int, t array<int>, w array<double>")


def _own_votes(vectors: DataFrame, model: Model, nearest: int) -> DataFrame:
    """(toxic, vote): what the other examples say about every example; NaN if none shares a term."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = []
            ids = batch.column("doc_id").to_pylist()
            for begin in range(0, len(batch), TOGETHER):
                part = batch.slice(begin, TOGETHER)
                t, w = part.column("t"), part.column("w")
                sizes = pc.list_value_length(t).to_numpy().astype(np.int64)
                flat = t.flatten().to_numpy().astype(np.int64), w.flatten().to_numpy()
                found = model.index.all_nearest(sizes, *flat, nearest + 1)
                for doc_id, (place, cosine) in zip(ids[begin:], found, strict=False):
                    other = model.index.ids[place] != doc_id
                    place, cosine = place[other][:nearest], cosine[other][:nearest]
                    votes.append(model.vote(place, cosine) if len(place) else math.nan)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(votes, pa.float64())], names=["toxic", "vote"])

    return vectors.mapInArrow(of, "toxic int, vote double")


def _nearest(texts: pa.Array, model: Model, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and cosines of every text's nearest examples; a null text is an empty one."""
    texts = texts.cast(pa.binary())
    for begin in range(0, len(texts), TOGETHER):
        part = [x or b"" for x in texts.slice(begin, TOGETHER).to_pylist()]
        if model.index is None:
            yield from [(np.zeros(0, np.int64), np.zeros(0))] * len(part)
        else:
            yield from model.index.all_nearest(*model.vectors(part), k)


def score(docs: DataFrame, model: Model, nearest: int = NEAREST) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, evidence (examples and cosines, best first).

    The score depends on the text alone. A null text is an empty one; it and any text without
    a word of any example have the score that examples without neighbours have on average, and no
    evidence. An empty table gives an empty one. Other columns are not looked at.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            scores, ids, cosines = [], [], []
            for place, cosine in _nearest(batch.column("text"), model, nearest):
                scores.append(model.score(place, cosine))
                ids.append(model.index.ids[place].tolist() if len(place) else [])
                cosines.append(cosine.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array(ids, pa.list_(pa.int64())),
                    pa.array(cosines, pa.list_(pa.float64())),
                ],
                names=["doc_id", "score", "ids", "cosines"],
            )
            give_back()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = rows.mapInArrow(of, "doc_id long, score double, ids array<long>, cosines array<double>")
    evidence = F.arrays_zip(F.col("ids").alias("example_id"), F.col("cosines").alias("cosine"))
    return found.select("doc_id", "score", evidence.alias("evidence"))


def drop_toxic(docs: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, all their columns as they are.

    Every row is judged by its own text, whatever its id; nothing is shuffled.
    """
    model = fit(docs, labelled.where(~held_out()))
    place = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            found = _nearest(batch.column(place), model, NEAREST)
            low = [model.score(*x) < threshold for x in found]
            yield batch.filter(pa.array(low, pa.bool_()))
            give_back()

    return docs.mapInArrow(of, docs.schema)
