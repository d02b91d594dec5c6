"""Periodic runs against trying every period at every place."""

import hashlib
import random
import zlib

import pytest
import samples

from likewise.llm import periods, queries

SF = "/root/testdata/sf0.001"


def by_loop(words, min_length=6, exponent=4):
    """All (start, length, period), by looking at every period's stretches of equal words."""
    n = len(words)
    best = {}
    for period in range(1, n // exponent + 1):
        first = None
        for i in range(period, n + 1):
            if i < n and words[i] == words[i - period]:
                first = i if first is None else first
            elif first is not None:
                a, b = first - period, i
                if b - a >= max(min_length, exponent * period):
                    best.setdefault((a, b), period)
                first = None
    # A multiple of a period has the same ends, the smallest comes first.
    return sorted((a, b - a, q) for (a, b), q in best.items())


def collapse(words, runs):
    gone = {i for start, size, q in runs for i in range(start + q, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def row(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = by_loop(words)
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    return (
        doc_id,
        len(runs),
        start,
        length,
        period,
        None if length is None else 1000 * length // period,
        hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs)).encode()).hexdigest(),
        hashlib.sha256(collapse(words, runs).encode()).hexdigest(),
    )


@pytest.mark.parametrize("exponent,min_length", [(4, 6), (2, 2), (2, 5), (3, 4)])
def test_runs_of_small_alphabets(exponent, min_length):
    rng = random.Random(exponent * 10 + min_length)
    texts = []
    for _ in range(400):
        words = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5 and words:
            piece = words[: rng.randrange(1, 6)]
            words += piece * rng.randrange(2, 8) + piece[: rng.randrange(len(piece) + 1)] + words[:3]
        texts.append(words)
    got = periods.find([[w.encode() for w in t] for t in texts], min_length, exponent)
    assert got == [by_loop(t, min_length, exponent) for t in texts]


def test_automaton_finds_squares_without_the_cutting():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        assert periods.runs_of(words, 2, 2) == by_loop(words, 2, 2)


def test_long_texts_with_few_words():
    for words in (["a"] * 20_000, ["a", "b", "c"] * 7_000, ["x"] + ["a", "b"] * 5_000 + ["y"] * 9):
        got = periods.find([[w.encode() for w in words]], 6, 4)
        assert got == [sorted(got[0])]
        assert got[0][0][1] >= 10_000
    assert [r[2] for r in got[0]] == [2, 1]


def test_query_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert got == {row(r.doc_id, r.text) for r in docs}
    assert sum(r[1] > 0 for r in got) > 5


def test_awkward_rows(spark):
    rows = [
        *samples.TEXTS,
        (20, "la " * 40),
        (21, "a b a b a b a b x c c c c c c"),
        (22, "ü ü ü ü ü ü ü ü ü ü ü ü"),
        (23, "one"),
        (24, " \t\n"),
        *((i, " ".join(f"w{k % 7}" for k in range(50))) for i in range(30, 60)),
    ]
    table = samples.docs(spark, rows)
    got = periods.run_report(periods.periodic_runs(periods.planted(table))).collect()
    want = [row(i, t) for i, t in rows]

    def key(r):
        return tuple(-1 if v is None else v for v in r)

    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert periods.periodic_runs(table.limit(0)).count() == 0
    assert samples.docs(spark, []).count() == 0 == periods.periodic_runs(samples.docs(spark, [])).count()
