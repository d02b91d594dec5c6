"""Exact copies, near copies, repeated lines."""

import random
from collections import defaultdict

import pytest
import samples
from pyspark.sql import functions as F

import corpus_pipeline
from likewise.llm import exact, lines, minhash

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def exact_by_loop(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(-1 if i is None else i)
    return sorted(
        (i, max(g), len(g)) for g in groups.values() for i in g
    )


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_even_where_digests_collide(spark, weak):
    docs = samples.docs(spark)
    digest = (lambda t: (F.length(t) % 3).cast("string")) if weak else exact.tx.digest
    rows = exact.exact_groups(docs, digest, batch_bytes=1).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, -1 if r.keep_id is None else r.keep_id, r.group_size) for r in rows)
    assert got == exact_by_loop(samples.TEXTS)
    assert sum(r.kept for r in rows) == len({t or "" for _, t in samples.TEXTS})


def test_state_survives_several_batches(spark):
    docs = spark.read.parquet(DOCUMENTS)
    want = {tuple(r) for r in exact.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept").collect()}
    small = exact.exact_groups(docs.repartition(5), batch_bytes=1)
    assert {tuple(r) for r in small.select("doc_id", "keep_id", "group_size", "kept").collect()} == want


def test_drop_copies_keeps_all_columns(spark):
    docs = samples.docs(spark)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({t or "" for _, t in samples.TEXTS})
    assert 2 in {r.doc_id for r in rows} and 1 not in {r.doc_id for r in rows}


def test_empty_tables(spark):
    none = samples.docs(spark).limit(0)
    assert exact.exact_groups(none).count() == 0
    assert minhash.near_groups(none).count() == 0
    assert lines.drop_repeated_lines(none).count() == 0


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    """A base with copies of 0 to 12 edits, a chain, a second base, loners and short texts."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    rows = [(100 + i, edited(rng, base, i % 13)) for i in range(80)]
    chain = list(base)
    for i in range(20):
        chain[7 * i] = f"link{i}"
        rows.append((300 + i, " ".join(chain)))
    rows += [(400 + i, edited(rng, base[:60] + [f"z{j}" for j in range(90)], 1)) for i in range(10)]
    rows += [(500 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))) for i in range(10)]
    rows += [(600, "one two"), (601, "ONE  two"), (602, "one two three"), (603, ""), (604, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_groups_are_those_of_all_pairs(spark, rounds):
    rows = near_rows()
    got = minhash.near_groups(samples.docs(spark, rows), rounds=rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == samples.near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_the_near_copy_stage_links_from_four_fifths(spark):
    rng = random.Random(8)
    rows = []
    for i in range(0, 120, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        copy = list(base)
        for at in range(10, 10 + 30 * (2 + i // 2 % 3), 30):  # Jaccard 0.87, 0.81, 0.76
            copy[at] = "edit"
        rows += [(i, " ".join(base)), (i + 1, " ".join(copy))]
    rows += [(1000 + i, t) for i, t in near_rows() if t]
    want = {i for i, (_, c) in samples.near(rows, 80).items() if i == c}
    assert want != {i for i, (_, c) in samples.near(rows, 85).items() if i == c}
    kept = corpus_pipeline.near_stage(spark, samples.docs(spark, rows), "")
    assert {r.doc_id for r in kept.collect()} == want


def test_near_groups_over_a_table(spark):
    docs = spark.read.parquet(DOCUMENTS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs).collect()}
    assert got == samples.near([(r.doc_id, r.text) for r in docs.collect()])


def test_near_groups_with_awkward_rows(spark):
    rows = minhash.near_groups(samples.docs(spark)).collect()
    assert len(rows) == len(samples.TEXTS)
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    assert [r.component_id for r in of[2]] == [1, 1]
    assert of[6][0].component_id == 5 and of[10][0].component_id == 9
    assert (of[3][0].n_shingles, of[3][0].component_id, of[3][0].kept) == (0, 3, True)
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in of[None] if r.n_shingles) == [(8, 1, False)]
    assert [(r.component_id, r.kept) for r in of[None] if not r.n_shingles] == [(None, True)]
    kept = minhash.drop_near_copies(samples.docs(spark))
    assert kept.columns == samples.docs(spark).columns


def lines_by_loop(rows):
    strip = " \t\n\x0b\x0c\r"
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[samples.lower(line.strip(strip))].add(float("inf") if i is None else i)
    out = []
    for i, t in rows:
        own = float("inf") if i is None else i
        kept = [
            line
            for line in (t or "").split("\n")
            if not (
                len(k := samples.lower(line.strip(strip))) >= 10
                and len(held[k]) >= 2
                and own != min(held[k])
            )
        ]
        n = len((t or "").split("\n"))
        out.append((str(i), n, n - len(kept), "\n".join(kept)))
    return sorted(out)


def test_repeated_lines_with_awkward_rows(spark):
    got = lines.drop_repeated_lines(samples.docs(spark)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == lines_by_loop(samples.TEXTS)


def test_a_line_that_most_documents_share(spark):
    rows = [(i, f"a very common line indeed\nown line number {i}\nA very common line indeed ") for i in range(300)]
    got = lines.drop_repeated_lines(samples.docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == lines_by_loop(rows)


