"""Stretches of words that repeat with a period.

The words of a text go into a suffix automaton. Its suffix links are a tree in which the path from
a prefix to the root holds all its suffixes; a link-cut tree keeps the path's pieces that last
occurred at the same place. As each word is appended, its path is accessed: every piece met says
that its longest suffix, of L words, ended d words before. Where d <= L the last 2d words are a
square, and the square, extended to both sides, is a run. The path is then recoloured with the new
place. All pieces of all words are met in O(n log n) steps.

Only words that can be in a run are appended. A run of at least ``exponent`` periods repeats every
few words of its own inside it, so what isn't covered by a group of words that its text repeats cuts
the text, without loss: the stretches between the cuts hold all runs whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.llm import text as tx
from likewise.llm.bpe import blocks
from likewise.llm.workers import give_back

MIN_LENGTH = 6
EXPONENT = 4

_NO = -1


def _automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """The longest suffix's length and the suffix link of every state, and every prefix's state."""
    after: list[dict[int, int]] = [{}]
    link, length = [_NO], [0]
    prefixes = []
    last = 0
    for n, word in enumerate(words, 1):
        state = len(length)
        after.append({})
        length.append(n)
        link.append(0)
        p = last
        while p != _NO and word not in after[p]:
            after[p][word] = state
            p = link[p]
        if p != _NO:
            q = after[p][word]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                split = len(length)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[state] = split
                while p != _NO and after[p].get(word) == q:
                    after[p][word] = split
                    p = link[p]
        last = state
        prefixes.append(state)
    return length, link, prefixes


class _Paths:
    """A link-cut tree over the suffix links; the pieces of paths are splay trees by depth.

    ``colour`` is kept at the root of a splay tree and holds for all of it.
    """

    def __init__(self, link: list[int]):
        self.up = list(link)
        self.left = [_NO] * len(link)
        self.right = [_NO] * len(link)
        self.colour = [_NO] * len(link)

    def _is_root(self, x: int) -> bool:
        p = self.up[x]
        return p == _NO or (self.left[p] != x and self.right[p] != x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner != _NO:
            up[inner] = p
        if g != _NO:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p] = x
        up[x] = g

    def _splay(self, x: int) -> None:
        up, left = self.up, self.left
        while not self._is_root(x):
            p = up[x]
            if self._is_root(p):
                self.colour[x] = self.colour[p]
                self._rotate(x)
                return
            g = up[p]
            if self._is_root(g):
                self.colour[x] = self.colour[g]
            self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, node: int, place: int) -> list[tuple[int, int]]:
        """(colour, deepest node) of the pieces on the path to the root, which gets ``place``."""
        met = []
        below, x = _NO, node
        while x != _NO:
            self._splay(x)
            colour = self.colour[x]
            if colour != _NO:
                met.append((colour, x))
            cut = self.right[x]
            if cut != _NO:
                self.colour[cut] = colour
            self.right[x] = below
            below = x
            x = self.up[x]
        self.colour[below] = place
        self._splay(node)
        return met


def runs_of(words: Sequence[int], min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of so many words and periods, by start."""
    length, link, prefixes = _automaton(words)
    paths = _Paths(link)
    n = len(words)
    reach: dict[int, int] = {}
    runs: dict[tuple[int, int], int] = {}
    for end, state in enumerate(prefixes):
        for before, suffix in paths.access(state, end):
            period = end - before
            if length[suffix] < period or reach.get(period, _NO) >= end:
                continue
            first, last = end - 2 * period + 1, end
            while first and words[first - 1] == words[first - 1 + period]:
                first -= 1
            while last + 1 < n and words[last + 1] == words[last + 1 - period]:
                last += 1
            reach[period] = last
            # Multiples of the smallest period extend to the same ends.
            runs[first, last] = min(period, runs.get((first, last), period))
    found = ((a, b - a + 1, q) for (a, b), q in runs.items())
    return sorted(r for r in found if r[1] >= max(min_length, exponent * r[2]))


def _repeated(ids: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Which words are in a group of ``width`` neighbours that their text holds elsewhere, too.

    Groups are told apart by a hash; where two of them have the same, words are kept in vain.
    """
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    key = text[:n].astype(np.uint64) + np.uint64(1)
    for k in range(width):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key += ids[k : k + n].astype(np.uint64)
    starts = np.flatnonzero(text[:n] == text[width - 1 :])
    order = starts[np.argsort(key[starts])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(ids) + 1, np.int32)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    ends = np.zeros(len(ids) + 1, np.int32)
    ends[width:] = twice[:-width]
    return np.cumsum(twice - ends)[:-1] > 0


def _stretches(kept: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of neighbouring kept words of the same text."""
    if not kept.any():
        return
    step = (kept[1:] != kept[:-1]) | (text[1:] != text[:-1])
    cuts = np.concatenate([[0], np.flatnonzero(step) + 1, [len(kept)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if kept[a]:
            yield a, b


Runs = list[tuple[int, int, int]]


def find(texts: list[list[bytes]], min_length: int, exponent: int) -> list[Runs]:
    """The runs of every text, given as its words, in order of start and period."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.array([number[w] for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    # The fewest words that a run and the run shifted by its period have in common.
    width = min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))
    found: list[Runs] = [[] for _ in texts]
    for a, b in _stretches(_repeated(ids, text, width), text):
        if b - a >= min_length:
            own = int(text[a])
            offset = a - int(begin[own])
            runs = runs_of(ids[a:b].tolist(), min_length, exponent)
            found[own] += [(start + offset, size, period) for start, size, period in runs]
    return found


def _collapsed(words: list[bytes], runs: Runs) -> bytes:
    """The words outside of runs and in the first period of every run that no other run drops."""
    gone = np.zeros(len(words) + 1, np.int32)
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)


_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs array<struct<start, length, period>>, collapsed: one row per row of ``docs``.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch of words
    whose smallest period is ``period`` (words that far apart are equal), of at least
    ``min_length`` words and ``exponent`` periods (2 or more), that no neighbouring word extends.
    Runs are sorted by start and period, so ties have an order. ``collapsed`` joins, with one space,
    the words that no run holds after its first period. A null or empty text has no runs and
    collapses to the empty text; a null doc_id and repeated rows are rows like any other; only
    ``doc_id`` and ``text`` are looked at. Texts are whole however long they are: a very long one is
    handled by itself and takes about half a kilobyte for each of its words that can be in a run.
    An empty table gives no rows. Nothing is shuffled.
    """
    if exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two words and two periods")
    tx.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    arrow = spark.createDataFrame([], _SCHEMA).limit(0).toArrow().schema
    run = arrow.field("runs").type

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = [(t or "").encode().split() for t in part.column(1).to_pylist()]
                runs = find(texts, min_length, exponent)
                sizes = np.array([0, *map(len, runs)], np.int32)
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                columns = [pa.array(np.ascontiguousarray(c)) for c in flat.T]
                rows = pa.StructArray.from_arrays(columns, fields=list(run.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), rows, type=run)
                collapsed = [
                    _collapsed(words, own) if own else b" ".join(words)
                    for words, own in zip(texts, runs, strict=True)
                ]
                strings = pa.array(collapsed, pa.binary()).cast(arrow.field("collapsed").type)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, strings], schema=arrow)
            give_back()

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(of, _SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document, by a hash of its id, repeats a part of itself.

    Of its n words those from the a-th on become words a, a+1, ..., a+p-1 and again from a, where
    h = crc32(doc_id), g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8), if h % 10 = 0.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    gaps = r"[\x20\x09-\x0D]+"
    split = F.filter(F.split(tx.whole(F.col("text")), gaps), lambda w: w != "")
    chosen = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.floor(h / 10).alias("g"),
        F.when(h % 10 == 0, split).alias("words"),
    )
    n = F.size("words")
    at = chosen.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rest: Column = n - F.col("a")
    period = (F.floor(rest / (F.lit(3) + F.col("g") % 8)) + 1).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, period), F.ceil(rest / period).cast("int")))
    words = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest))
    return at.select(
        "doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text")
    )


def run_report(found: DataFrame) -> DataFrame:
    """What op11 returns of ``periodic_runs``: counts, the longest run, hashes of all runs and of the rest."""
    longest = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r["length"].alias("length"),
                (-r["start"]).alias("back"),
                (-r["period"]).alias("minus"),
            ),
        )
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return (
        found.withColumn("best", longest)
        .select(
            "doc_id",
            F.size("runs").cast("bigint").alias("n_runs"),
            (-F.col("best.back")).alias("start"),
            F.col("best.length").alias("length"),
            (-F.col("best.minus")).alias("period"),
            F.expr("best.length * 1000 div -best.minus").alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
