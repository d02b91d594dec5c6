"""Scores of the suffix tree against counting everything in one place."""

import math
import random
import zlib
from collections import Counter

import pytest
import samples
from pyspark.sql import functions as F

from likewise.llm import queries, suffixes

SF = "/root/testdata/sf0.001"
END = None


def apart(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def by_loop(rows, least, weight):
    """The rows of ``suffixes.score`` from (doc_id, text), with plain counters."""
    docs = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().lower().split()]
        docs.append((i, apart(i), [*words, END]))
    one, two, three = Counter(), Counter(), Counter()
    for _, held, tokens in docs:
        if held:
            continue
        padded = [END, *tokens]
        one.update(tokens)
        two.update(zip(padded, tokens, strict=False))
        three.update(zip(padded, tokens, tokens[1:], strict=False))
    total, distinct = sum(one.values()), len(one)
    price = math.log(max(total, 2))

    def root(w):
        return (one[w] + 0.5) / (total + 0.5 * (distinct + 1))

    def short(v, w):
        return (two[v, w] + weight[0] * root(w)) / (one[v] + weight[0])

    def long(u, v, w):
        return (three[u, v, w] + weight[1] * short(v, w)) / (two[u, v] + weight[1])

    gain, long_gain = Counter(), Counter()
    for (v, w), n in two.items():
        left = (n - 1 + weight[0] * root(w)) / (one[v] - 1 + weight[0])
        gain[v] += n * math.log(left / root(w))
    for (u, v, w), n in three.items():
        if two[u, v] >= least:
            left = (n - 1 + weight[1] * short(v, w)) / (two[u, v] - 1 + weight[1])
            long_gain[u, v] += n * math.log(left / short(v, w))
    states = {v for v in gain if one[v] >= least and gain[v] >= price}
    pairs = {(u, v) for (u, v), g in long_gain.items() if v in states and g >= price}
    want = []
    for i, held, tokens in docs:
        padded = [None, END, *tokens]
        score, used = 0.0, [0, 0]
        for n, w in enumerate(tokens):
            v, u = padded[n + 1], padded[n]
            if n and (u, v) in pairs:
                used[1] += 1
                score += math.log10(long(u, v, w))
            elif v in states:
                used[0] += 1
                score += math.log10(short(v, w))
            else:
                score += math.log10(root(w))
        known = sum(one[w] > 0 for w in tokens)
        base = sum(math.log10(root(w)) for w in tokens)
        want.append((i, held, len(tokens), known, total, base, score, *used))
    return want


def close(got, want):
    def key(r):
        return tuple(-1.0 if v is None else round(float(v), 6) for v in r)

    got, want = sorted(map(key, got)), sorted(map(key, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[7:] for r in got] == [r[7:] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:7] == pytest.approx(b[5:7], rel=1e-6)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


@pytest.mark.parametrize("block,share", [(1 << 21, 1 << 20), (3_000, 7_000), (1, 50_000)])
def test_given_documents_in_blocks_of_any_size(spark, block, share):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    if block == 1:
        docs = docs.where("doc_id < 40")
        rows = [r for r in rows if r[0] < 40]
    got = suffixes.score(docs.repartition(3), held_out(), least=8, weight=(16.0, 4.0), block=block, share=share)
    got = [tuple(r) for r in got.collect()]
    want = by_loop(rows, 8, (16.0, 4.0))
    close(got, want)
    if block > 1:
        assert sum(r[7] for r in got) > 1000 and sum(r[8] for r in got) > 100


def test_query_beats_single_tokens_on_held_out_documents(spark):
    rows = queries.QUERIES["op12_suffix_tree"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    close([tuple(r) for r in rows], by_loop([tuple(r) for r in docs], suffixes.LEAST, suffixes.WEIGHT))
    held = [r for r in rows if r.held_out]
    assert len(held) > 20
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_awkward_rows(spark):
    rng = random.Random(2)
    rows = [*samples.TEXTS, *((i, " ".join(rng.choice(["A b c", "d E", "f"]) for _ in range(60))) for i in range(50, 80))]
    got = suffixes.score(samples.docs(spark, rows), held_out(), least=4, weight=(4.0, 2.0))
    close([tuple(r) for r in got.collect()], by_loop(rows, 4, (4.0, 2.0)))
    none = samples.docs(spark, rows).limit(0)
    assert suffixes.score(none, held_out()).count() == 0
    only = samples.docs(spark, [(1, "all held out"), (2, None)])
    got = suffixes.score(only, F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(4, 0, 0), (1, 0, 0)}
    assert all(math.isfinite(r.score) for r in got)
