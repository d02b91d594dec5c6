"""Byte-level BPE by replaying merges over a corpus of distinct words.

A batch of texts is split into words; the distinct words that the task hasn't seen yet are
laid out in one array of tokens. An inverted index holds, for every token that a pair of
neighbours would make, the places of such pairs in all words. Merges are then applied in rank
order, each to all its places at once, and only the pairs beside a merge are looked at again.
Documents are the concatenation of their words' tokens. Nothing is shuffled: every text stays
in its row, and memory is bounded by a batch and by the number of words remembered.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.llm import text as tx
from likewise.llm.workers import begin, give_back, remembered

#: Distinct words that a task remembers; with more, it starts to remember afresh.
REMEMBERED = 1 << 17

#: Bytes of text whose new words are replayed together.
BLOCK = 1 << 22

_NONE = np.int32(np.iinfo(np.int32).max)


class Vocabulary:
    """A rank file: lines of a token's bytes in base 64 and its rank, which is also its id."""

    def __init__(self, path: str) -> None:
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.bytes = {rank: token for token, rank in self.rank.items()}
        self.of_byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        pairs, made, early = [], [], set()
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    made.append(rank)
                early.update(x for x in (left, right) if x is not None and x > rank)
        by_pair = np.argsort(pairs)
        self.pairs = np.array(pairs, np.int64)[by_pair]
        self.made = np.array(made, np.int32)[by_pair]
        #: Tokens from which a merge of a lower rank than their own may follow.
        self.early = early

    def made_by(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that neighbours merge into, or _NONE."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.made[at], _NONE)


@remembered("bpe")
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _first_of_overlaps(places: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of pairs that share a token, the first, the third, ... from the left."""
    chained = np.zeros(len(places), bool)
    chained[1:] = follows[places[:-1]] == places[1:]
    n = np.arange(len(places), dtype=np.int32)
    begin = np.maximum.accumulate(np.where(chained, 0, n))
    return places[(n - begin) % 2 == 0]


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all words after all merges, and the offset at which each word's start.

    Of two places of equal rank that overlap, the left one merges. Where a merge could make a
    pair of a lower rank than its own, only the leftmost place of each word is merged before
    the ranks are looked at again. A word that is a token is that token.
    """
    whole = np.array([vocab.rank.get(w, -1) for w in words], np.int32)
    size = np.array([len(w) for w in words], np.int64)
    token = vocab.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    last = np.cumsum(size) - 1
    follows = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    follows[last[size > 0]] = -1
    before[(last - size + 1)[size > 0]] = -1
    made = np.full(n, _NONE, np.int32)
    pair = np.flatnonzero((follows >= 0) & (whole[word] < 0)).astype(np.int32)
    made[pair] = vocab.made_by(token[pair], token[pair + 1])

    index: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def note(places: np.ndarray) -> None:
        """Enter places into the index under the token that each would make."""
        places = places[made[places] != _NONE]
        by_rank = np.argsort(made[places], kind="stable")
        places = places[by_rank]
        rank = made[places]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        starts = [0, *cuts.tolist(), len(places)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a < b:
                r = int(rank[a])
                if r not in index:
                    index[r] = []
                    heapq.heappush(ranks, r)
                index[r].append(places[a:b])

    note(pair)
    while ranks:
        now = heapq.heappop(ranks)
        found = index.pop(now)
        places = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        places = places[made[places] == now]
        if not len(places):
            continue
        if now in vocab.early:
            first = np.ones(len(places), bool)
            first[1:] = word[places[1:]] != word[places[:-1]]
            later, places = places[~first], places[first]
            if len(later):
                index[now] = [later]
                heapq.heappush(ranks, now)
        else:
            places = _first_of_overlaps(places, follows)
        second = follows[places]
        after = follows[second]
        token[places], token[second], made[second] = now, -1, _NONE
        follows[places] = after
        before[after[after >= 0]] = places[after >= 0]
        left = before[places]
        touched = np.unique(np.concatenate((places, left[left >= 0])))
        right = follows[touched]
        made[touched] = _NONE
        touched, right = touched[right >= 0], right[right >= 0]
        made[touched] = vocab.made_by(token[touched], token[right])
        note(touched)

    keep = (token >= 0) & (whole[word] < 0)
    tokens_of = np.bincount(word[keep], minlength=len(words))
    tokens_of[whole >= 0] = 1
    ends = np.concatenate(([0], np.cumsum(tokens_of)))
    out = np.empty(ends[-1], np.int32)
    out[ends[:-1][whole >= 0]] = whole[whole >= 0]
    rest = np.ones(len(out), bool)
    rest[ends[:-1][whole >= 0]] = False
    out[rest] = token[keep]
    return out, ends


class _Codes(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def pick(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number ``which`` of a list array one after the other, and their sizes."""
    sizes = ends[which + 1] - ends[which]
    shift = np.repeat(ends[which] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return flat[shift + np.arange(len(shift))], sizes


class Encoder:
    """Words to token ids, remembering the words it has met."""

    def __init__(self, vocab: Vocabulary, pattern: str, remembered: int = REMEMBERED) -> None:
        self.vocab, self.remembered = vocab, remembered
        self.split = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.codes = _Codes()
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Every text's ids; null and empty texts have none."""
        if len(self.codes) > self.remembered:
            self._forget()
        old, code, parts = len(self.codes), self.codes.__getitem__, []
        for text in texts:
            words = self.split(text.as_py() or "")
            parts.append(np.fromiter(map(code, words), np.int32, len(words)))
        fresh = [w.encode() for w in list(self.codes)[old:]]
        flat, ends = replay(fresh, self.vocab)
        self.flat = np.concatenate((self.flat, flat))
        self.ends = np.concatenate((self.ends, self.ends[-1] + ends[1:]))
        offsets, out = [0], []
        for part in parts:
            ids, _ = pick(self.flat, self.ends, part)
            out.append(ids)
            offsets.append(offsets[-1] + len(ids))
        values = np.concatenate(out) if out else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about BLOCK bytes; a longer text is a range of its own."""
    first, total = 0, 0
    for row, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if total and total + size > BLOCK:
            yield first, row
            first, total = row, 0
        total += size
    if first < len(texts):
        yield first, len(texts)


def _share(docs: DataFrame, path: str) -> str:
    """Make the rank file, which the driver can read, reach every executor."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _schema(docs: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), extra])


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with a column of the token ids of the whole text, array<int>.

    With ``decoded`` there is also a binary column of that name, what the ids stand for: the
    way back is taken where the ids are, which saves moving them to another process. A null or
    empty text has no tokens. Special tokens are ordinary text. All other columns
    stay as they are, but for one that has the name of the new column. An empty table gives an
    empty one.
    """
    name = _share(docs, path)
    added = [ids] if decoded is None else [ids, decoded]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in map(str.lower, added)])
    tx.bound_batches(docs.sparkSession)
    names = [*docs.columns, *added]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        vocab = vocabulary(SparkFiles.get(name))
        encoder = Encoder(vocab, pattern)
        for batch in batches:
            for a, b in blocks(batch.column(names.index(text))):
                part = batch.slice(a, b - a)
                found = [encoder.encode(part.column(names.index(text)))]
                if decoded is not None:
                    found.append(_decoded(found[0], vocab))
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=names)
            give_back()

    kinds = f"`{ids}` array<int>" + (f", `{decoded}` binary" if decoded is not None else "")
    return docs.mapInArrow(of, _schema(docs, kinds))


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids stand for, a binary column.

    Null ids give no bytes. An id that the vocabulary doesn't have is an error. Other columns
    are treated as by ``encode``.
    """
    name = _share(docs, path)
    docs = docs.select(*[c for c in docs.columns if c.lower() != decoded.lower()])
    tx.bound_batches(docs.sparkSession)
    names = [*docs.columns, decoded]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _decoded(batch.column(names.index(ids)), vocabulary(SparkFiles.get(name)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=names)
            give_back()

    return docs.mapInArrow(of, _schema(docs, f"`{decoded}` binary"))


def _decoded(lists: pa.Array, vocab: Vocabulary) -> pa.Array:
    get = vocab.bytes.__getitem__
    return pa.array([b"".join(map(get, row)) for row in _rows(lists)], pa.binary())


def _rows(lists: pa.Array) -> Iterator[list[int]]:
    ends = lists.offsets.to_numpy()
    for n, ok in enumerate(lists.is_valid().to_pylist()):
        yield lists.values[ends[n] : ends[n + 1]].to_numpy().tolist() if ok else []


def id_text(ids: str = "ids") -> Column:
    """The ids as decimal numbers, joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
