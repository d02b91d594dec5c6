"""Language-model scores from a probabilistic suffix tree.

The tree's states are contexts of up to two tokens. A context is tried if it occurs ``LEAST`` times
and the shorter context, without its first token, is in the tree; it is retained if its own
next-token distribution diverges from the shorter one's: the log-likelihood that it gains on the
training tokens, each left out of its own estimate, must pay for the state, log N nats. Distributions
are smoothed towards the shorter context's, down to single tokens. A token is scored in the
state of the longest suffix of what precedes it.

Documents are gathered in blocks of about two million tokens, one row each, with the
tokens as numbers local to the block. What a block needs to know of the whole corpus it asks for:
keys of its distinct n-grams, with its own counts, are dealt out by key, summed over all blocks,
and the totals come back in the order in which they were asked. Counts, gains of contexts and
longer n-grams go that way, each round with what the rounds before have told. So a
frequent n-gram costs one key per block, not one row per occurrence, no model is collected or
broadcast, and what is counted grows with the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.llm import text as tx
from likewise.llm.workers import give_back
from likewise.sources.staging import stage

#: Tokens of a block; a longer document is a block by itself.
BLOCK = 1 << 21
#: Tokens whose keys one task sums.
SHARE = 1 << 20
#: Occurrences of a context from which its divergence is tested.
LEAST = 32
#: How many observations the shorter context's distribution counts as.
WEIGHT = (64.0, 16.0)

_END = 0  # local number of the token that ends a document, and precedes its first word


# Packing: bytes of equal weight stand together, so that zeros and slow changes compress.


def _packed(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int(n)  # beside nulls, pandas has numbers as floats
    planes = pa.decompress(data, n * size, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, np.uint8).reshape(size, n).T.copy().view(kind).reshape(n)


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two numbers."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b) if isinstance(b, int) else a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Keys are 56 bits; single tokens' have the lowest bit set, so that they can be told apart.
_TOKEN, _PAIR, _CONTEXT, _TRIPLE, _LONG_CONTEXT = range(1, 6)


def _keys(hashes: np.ndarray, kind: int) -> np.ndarray:
    keys = _mixed(hashes, kind) >> np.uint64(8)
    return keys | np.uint64(1) if kind == _TOKEN else keys & ~np.uint64(1)


# Blocks


_BLOCKS = "block long, n_docs int, n_tokens int, n_words int, n_train long, documents binary, sizes binary, held binary, named binary, tokens binary, words binary"


def blocks_of(docs: DataFrame, held_out: Column, size: int = BLOCK) -> DataFrame:
    """The documents' tokens, in one row for each block."""
    tx.bound_batches(docs.sparkSession)
    schema = docs.sparkSession.createDataFrame([], _BLOCKS).limit(0).toArrow().schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        parts: list[np.ndarray] = []
        rows: list[tuple[int | None, int, bool]] = []
        first = None
        total = 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate(parts).astype(np.uint32)
            # The more frequent, the smaller the number: it compresses better.
            counts = np.bincount(tokens, minlength=len(number) + 1)
            counts[_END] = np.iinfo(np.int64).max
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = np.empty(len(number), object)
            words[:] = list(number)
            hashes = np.concatenate([np.zeros(1, np.uint64), hash_array(words, categorize=False)])[order]
            ids = np.array([r[0] or 0 for r in rows], np.int64)
            sizes = np.array([r[1] for r in rows], np.int64)
            held = np.array([r[2] for r in rows], np.uint8)
            values = [
                first, len(rows), len(tokens), len(hashes), int(sizes[held == 0].sum()),
                *map(_packed, (ids, sizes, held, np.array([r[0] is not None for r in rows], np.uint8), rank[tokens], hashes)),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            columns = (batch.column(i) for i in range(4))
            ids, texts, held, place = (c.to_pylist() if i != 1 else c for i, c in enumerate(columns))
            for own, text, apart, at in zip(ids, texts, held, place, strict=True):
                words = (text.as_py() or "").encode().lower().split()
                if rows and total + len(words) >= size:
                    yield block()
                    number, parts, rows, first, total = defaultdict(count(1).__next__), [], [], None, 0
                first = at if first is None else first
                tokens = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                parts += [tokens, np.zeros(1, np.int32)]
                rows.append((own, len(words) + 1, apart))
                total += len(words) + 1
            give_back()
        if rows:
            yield block()

    chosen = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.coalesce(held_out, F.lit(False)).alias("held"),
        F.monotonically_increasing_id().alias("place"),
    )
    return chosen.mapInArrow(of, _BLOCKS)


@dataclass
class _Block:
    """The arrays of a block's row, and what the rounds have told it."""

    row: pd.Series
    told: list[np.ndarray]

    def __post_init__(self) -> None:
        r = self.row
        self.ids = _unpacked(r.documents, r.n_docs, np.int64)
        self.sizes = _unpacked(r.sizes, r.n_docs, np.int64)
        self.held = _unpacked(r.held, r.n_docs, np.uint8).astype(bool)
        self.named = _unpacked(r.named, r.n_docs, np.uint8).astype(bool)
        self.tokens = _unpacked(r.tokens, r.n_tokens, np.uint32).astype(np.int64)
        self.words = _unpacked(r.words, r.n_words, np.uint64)
        self.train = np.repeat(~self.held, self.sizes)
        self.before = np.concatenate([[_END], self.tokens[:-1]])
        n = len(self.words)
        # Distinct pairs, and the pair of every place.
        pairs, self.pair = np.unique(self.before * n + self.tokens, return_inverse=True)
        self.context, self.next = pairs // n, pairs % n
        self.pair_hash = _mixed(self.words[self.context], self.words[self.next])
        self.n_pair = np.bincount(self.pair[self.train], minlength=len(pairs)).astype(float)

    # Round 1: counts of tokens and pairs.

    def ask_counts(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.bincount(self.tokens[self.train], minlength=len(self.words))
        keys = [_keys(self.words, _TOKEN), _keys(self.pair_hash, _PAIR)]
        return np.concatenate(keys), np.concatenate([own, self.n_pair])

    def hear_counts(self, model: Model) -> None:
        n = len(self.words)
        self.c, self.c_pair = self.told[0][:n], self.told[0][n:]
        self.p = (self.c + 0.5) / model.scale
        prior = self.p[self.next]
        seen = self.c[self.context]
        self.p_pair = (self.c_pair + model.weight[0] * prior) / (seen + model.weight[0])
        self.gain = self.n_pair * _gain(self.c_pair, seen, prior, model.weight[0])

    def long_places(self, model: Model) -> np.ndarray:
        """Places that two tokens of their document precede which form a context to try."""
        long = self.before != _END
        long[0] = False
        at = np.flatnonzero(long)
        return at[self.c_pair[self.pair[at - 1]] >= model.least]

    # Round 2: what contexts of one token gain, counts of triples.

    def find_triples(self, model: Model) -> None:
        at = self.long_places(model)
        n = len(self.words)
        triples, place = np.unique(self.pair[at - 1] * n + self.tokens[at], return_inverse=True)
        self.at, self.triple = at, place
        self.long_context, last = triples // n, triples % n
        self.triple_hash = _mixed(self.pair_hash[self.long_context], self.words[last])
        self.n_triple = np.bincount(place[self.train[at]], minlength=len(triples)).astype(float)
        # The pair that a triple ends in.
        self.ends_in = np.empty(len(triples), np.int64)
        self.ends_in[place] = self.pair[at]

    def ask_gains(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        self.hear_counts(model)
        self.find_triples(model)
        gains = np.bincount(self.context, self.gain, minlength=len(self.words))
        keys = [_keys(self.words, _CONTEXT), _keys(self.triple_hash, _TRIPLE)]
        return np.concatenate(keys), np.concatenate([gains, self.n_triple])

    def hear_gains(self, model: Model) -> None:
        n = len(self.words)
        self.state = (self.c >= model.least) & (self.told[1][:n] >= model.price)
        self.c_triple = self.told[1][n:]
        prior, seen = self.p_pair[self.ends_in], self.c_pair[self.long_context]
        self.p_triple = (self.c_triple + model.weight[1] * prior) / (seen + model.weight[1])
        self.long_gain = self.n_triple * _gain(self.c_triple, seen, prior, model.weight[1])

    # Round 3: what contexts of two tokens gain.

    def long_contexts(self) -> np.ndarray:
        return np.unique(self.long_context)

    def ask_long_gains(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        self.hear_counts(model)
        self.find_triples(model)
        self.hear_gains(model)
        contexts = self.long_contexts()
        gains = np.bincount(np.searchsorted(contexts, self.long_context), self.long_gain, minlength=len(contexts))
        return _keys(self.pair_hash[contexts], _LONG_CONTEXT), gains

    def scores(self, model: Model) -> pd.DataFrame:
        """The documents' rows, once all rounds are over."""
        self.ask_long_gains(model)
        contexts = self.long_contexts()
        # A context is only tried where the shorter one is a state.
        fit = (self.told[2] >= model.price) & self.state[self.next[contexts]]
        p = self.p[self.tokens]
        base = np.log10(p)
        one = self.state[self.before]
        p = np.where(one, self.p_pair[self.pair], p)
        two = np.zeros(len(p), bool)
        two[self.at] = fit[np.searchsorted(contexts, self.long_context)][self.triple]
        p[self.at] = np.where(two[self.at], self.p_triple[self.triple], p[self.at])
        starts = np.cumsum(self.sizes) - self.sizes

        def summed(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, starts)

        return pd.DataFrame(
            {
                "doc_id": pd.array(self.ids, "Int64").copy(),
                "held_out": self.held,
                "n_tokens": self.sizes,
                "n_known": summed((self.c[self.tokens] > 0).astype(np.int64)),
                "train_tokens": np.full(len(self.ids), model.n_tokens),
                "base_score": summed(base),
                "score": summed(np.log10(p)),
                "n_short_states": summed((one & ~two).astype(np.int64)),
                "n_long_states": summed(two.astype(np.int64)),
            }
        ).assign(doc_id=lambda d: d.doc_id.where(self.named, None))


def _gain(own: np.ndarray, seen: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
    """What a context's distribution gains over the shorter one's for one occurrence, left out."""
    left = np.maximum(own - 1, 0) + weight * prior
    return np.log(left / (np.maximum(seen - 1, 0) + weight)) - np.log(prior)


@dataclass(frozen=True)
class Model:
    """Totals and parameters."""

    n_tokens: int
    n_distinct: int
    least: int
    weight: tuple[float, float]

    @property
    def scale(self) -> float:
        return self.n_tokens + 0.5 * (self.n_distinct + 1)

    @property
    def price(self) -> float:
        """Nats that a state must gain."""
        return float(np.log(max(self.n_tokens, 2)))


# Rounds


_ASKED = "block long, share int, n int, `keys` binary, own binary"
_TOLD = "block long, round int, share int, n int, total binary, n_distinct long"

Ask = Callable[[_Block], tuple[np.ndarray, np.ndarray]]


def _dealt(keys: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where each share begins in it."""
    order = np.argsort(keys, kind="stable")
    bounds = (np.arange(1, shares, dtype=np.float64) * (2.0**56 / shares)).astype(np.uint64)
    cuts = np.searchsorted(keys[order], bounds)
    return order, np.concatenate([[0], cuts, [len(keys)]])


def _questions(block: _Block, ask: Ask, shares: int) -> pd.DataFrame:
    keys, own = ask(block)
    order, cuts = _dealt(keys, shares)
    keys, own = keys[order], own[order]
    rows = []
    for share, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            steps = np.diff(keys[a:b], prepend=np.uint64(0))
            rows.append((int(block.row.block), share, b - a, _packed(steps), _packed(own[a:b])))
    return pd.DataFrame(rows, columns=["block", "share", "n", "keys", "own"])


def _answers(asked: pd.DataFrame, number: int) -> pd.DataFrame:
    """The totals of one share's keys, for every block that asked."""
    keys = [np.cumsum(_unpacked(k, n, np.uint64)) for k, n in zip(asked["keys"], asked["n"], strict=True)]
    own = [_unpacked(v, n, np.float64) for v, n in zip(asked["own"], asked["n"], strict=True)]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(own), minlength=len(found))
    cuts = np.concatenate([[0], np.cumsum(asked["n"].to_numpy())])
    rows = [
        (block, number, share, n, _packed(total[place[a : a + n]]), 0)
        for block, share, n, a in zip(asked["block"], asked["share"], asked["n"], cuts[:-1].tolist(), strict=True)
    ]
    told = pd.DataFrame(rows, columns=["block", "round", "share", "n", "total", "n_distinct"])
    told.loc[0, "n_distinct"] = int(((found & np.uint64(1)) == 1)[total > 0].sum())
    return told


def _heard(rows: pd.DataFrame, asks: list[Ask], shares: int) -> _Block:
    """A block with the answers of all rounds so far, each in the order of its questions."""
    block = _Block(rows[rows["round"] == 0].iloc[0], [])
    for number, ask in enumerate(asks, 1):
        own = rows[rows["round"] == number].sort_values("share")
        keys, _ = ask(block)
        order, _ = _dealt(keys, shares)
        total = np.empty(len(keys))
        if len(keys):
            total[order] = np.concatenate(
                [_unpacked(t, n, np.float64) for t, n in zip(own["total"], own["n"], strict=True)]
            )
        block.told.append(total)
    return block


def score(
    docs: DataFrame,
    held_out: Column,
    least: int = LEAST,
    weight: tuple[float, float] = WEIGHT,
    block: int = BLOCK,
    share: int = SHARE,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_short_states, n_long_states.

    ``held_out`` is a column over ``docs``; the tree is learned from the rows where it isn't true, and all
    rows are scored. A-Z are lower-cased, tokens are runs of anything but ASCII white space and then
    one end. ``n_known`` tokens occur among the ``train_tokens`` training tokens. ``base_score`` is
    the sum of log10((c + 0.5) / (N + 0.5 (V + 1))), ``score`` the sum of the tree's log10
    probabilities; ``n_short_states`` and ``n_long_states`` say how many tokens were scored in
    states of one and of two tokens, the others in the root.

    A null or empty text is its end alone; a null doc_id is a document like any other; repeated
    rows are learned from and scored each for itself; only ``doc_id``, ``text`` and what ``held_out``
    names are looked at. A very long text is a block by itself, never cut. Without training rows all
    counts are zero; an empty table gives no rows. Sums over blocks come in no fixed
    order, so scores may differ in their last digits from run to run.
    """
    blocks = stage(blocks_of(docs, held_out, block), "lm-blocks")
    sums = blocks.agg(F.sum("n_train"), F.sum("n_tokens")).first()
    n_tokens, all_tokens = int(sums[0] or 0), int(sums[1] or 0)
    shares = max(1, -(-all_tokens // share))
    model = Model(n_tokens, 0, least, tuple(weight))

    def round_of(number: int, asked: DataFrame) -> DataFrame:
        def answered(rows: pd.DataFrame) -> pd.DataFrame:
            made = _answers(rows.reset_index(drop=True), number)
            give_back()
            return made

        return stage(asked.groupBy("share").applyInPandas(answered, _TOLD), f"lm-round-{number}")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                yield _questions(_Block(row, []), _Block.ask_counts, shares)
                give_back()

    told = [round_of(1, blocks.mapInPandas(first, _ASKED))]
    model = Model(n_tokens, int(told[0].agg(F.sum("n_distinct")).first()[0] or 0), least, tuple(weight))

    def gains(b: _Block) -> tuple[np.ndarray, np.ndarray]:
        return b.ask_gains(model)

    def long_gains(b: _Block) -> tuple[np.ndarray, np.ndarray]:
        return b.ask_long_gains(model)

    def together() -> DataFrame:
        """Blocks and all that they were told, by block."""
        answers = told[0]
        for more in told[1:]:
            answers = answers.unionByName(more)
        mark = F.lit(0).alias("round")
        return blocks.select("*", mark).unionByName(answers, allowMissingColumns=True).groupBy("block")

    def asking(asks: list[Ask], ask: Ask) -> DataFrame:
        def of(rows: pd.DataFrame) -> pd.DataFrame:
            made = _questions(_heard(rows, asks, shares), ask, shares)
            give_back()
            return made

        return together().applyInPandas(of, _ASKED)

    told.append(round_of(2, asking([_Block.ask_counts], gains)))
    told.append(round_of(3, asking([_Block.ask_counts, gains], long_gains)))

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        made = _heard(rows, [_Block.ask_counts, gains, long_gains], shares).scores(model)
        give_back()
        return made

    return together().applyInPandas(
        scored,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, n_short_states long, n_long_states long",
    )
