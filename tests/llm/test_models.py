"""Encoding, mixing, vectors, rollups and the pipeline."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import samples
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from likewise.llm import bpe, exact, mixing, rollup, vectors
from likewise.sources.staging import staged_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def odd_texts():
    rng = random.Random(3)
    return [
        "a" * 20_000, "ab" * 5_000, "<|endoftext|> it's we'LL", "\r\n\n  \t x\x1c\x85y", "aaaa " * 3,
        *("".join(rng.choice("abcdeinstrou gh") for _ in range(300)) for _ in range(40)),
        *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(200)) for _ in range(40)),
    ]


def test_encoding_is_that_of_the_library(spark, tokenizer):
    rows = [*samples.TEXTS, *((1000 + i, t) for i, t in enumerate(odd_texts()))]
    docs = samples.docs(spark, rows)
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(encoded.columns) == sorted(docs.columns)
    got = bpe.decode(encoded, PATH).select("doc_id", "text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == tokenizer.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_encoding_when_words_are_forgotten(tokenizer):
    import pyarrow as pa

    texts = pa.array(odd_texts())
    encoder = bpe.Encoder(bpe.vocabulary(PATH), public_tokenizers.PATTERN, remembered=5)
    for _ in range(2):
        for i in range(0, len(texts), 9):
            part = texts.slice(i, 9)
            assert encoder.encode(part).to_pylist() == [tokenizer.encode_ordinary(t) for t in part.to_pylist()]


def test_pick_and_empty_words():
    flat, ends = bpe.replay([], bpe.vocabulary(PATH))
    assert len(flat) == 0 and ends.tolist() == [0]


def vectors_by_loop(rows, link=0.93):
    union, links = samples.Union([i for i, _, _ in rows]), {i: 0 for i, _, _ in rows}
    by = {}
    for i, e, label in rows:
        if e is None or label is None or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        x = np.array(e, float)
        by.setdefault((label, len(e)), []).append((i, x / np.linalg.norm(x)))
    for group in by.values():
        for n, (i, x) in enumerate(group):
            for j, y in group[:n]:
                if x @ y >= link:
                    links[i] += 1
                    links[j] += 1
                    union.join(i, j)
    return {i: (links[i], union.find(i)) for i, _, _ in rows}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((n, (base + rng.normal(size=16) * 0.08).tolist(), label))
                n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(300)]
    want = vectors_by_loop(rows)
    got = {
        r.vec_id: (r.n_links, r.component_id)
        for r in vectors.near_vectors(
            spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        ).collect()
    }
    assert sum(x for x, _ in got.values()) >= 0.9 * sum(x for x, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i] == want[i] for i in want]) > 0.9


def test_vectors_with_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0),
        (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [2.0, 0.0], 0),
        (11, [-1.0, 0.0], 0), (12, [1.0, 0.0, 0.0], 0), (13, [], 0), (14, [1e-30, 0.0], 0), (15, [1e300, 1.0], 0),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    docs = docs.withColumn("node", F.lit("x")).withColumn("n", F.lit(0)).withColumn("root", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(docs).collect()}
    want = vectors_by_loop([r for r in rows if r[0] != 15])
    linked = {1, 2, 10, 14, 15}
    for i, *_ in rows:
        expected = (4, 1) if i in linked else want[i]
        assert got[i] == (*expected, i == expected[1])
    twice = docs.where("vec_id = 1").unionByName(docs.where("vec_id = 1")).unionByName(
        docs.where("vec_id = 2").withColumn("vec_id", F.lit(None).cast("long"))
    )
    assert sorted(map(str, vectors.near_vectors(twice).select("vec_id", "n_links", "component_id", "kept").collect())) == sorted(
        map(str, spark.createDataFrame([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)], "vec_id long, n_links long, component_id long, kept boolean").collect())
    )
    assert vectors.near_vectors(docs.limit(0)).count() == 0


def test_a_crowd_of_near_copies_is_dealt_into_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rng.normal(size=16).tolist(), 0) for i in range(300)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = vectors_by_loop(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(given).collect()}
    assert np.mean([got[i] == want[i] for i in want]) > 0.95 and all(got[i][0] <= want[i][0] for i in want)
    found = vectors.links(vectors.classes(given)).where("a != b")
    assert found.count() < 10_000 < sum(n for n, _ in want.values()) // 2


def test_depth_is_measured_where_no_probe_has_a_neighbour(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=32).tolist(), 0) for i in range(4000)]
    base = np.array(rows[0][1])
    rows += [(9000, (base + rng.normal(size=32) * 0.2).tolist(), 0)]
    given = vectors.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).cache()
    grid, sample = vectors._grid(given, 100_000)
    alone = sample[~sample["node"].isin([0, 9000])]
    depth = vectors._depth(given.where("node NOT IN (0, 9000)"), grid, alone, 0.93, 0.995)
    planted = vectors._planted(grid, alone, 0.93)
    assert depth != 64 and (planted["rank"] < depth).mean() >= 0.98


def test_cells_come_nearest_first():
    rng = np.random.default_rng(2)
    left, right = rng.random(7), rng.random(5)
    sums = left[:, None] + right[None]
    got = vectors.nearest_cells(left, right, 35)
    assert len(set(got)) == 35
    assert np.allclose([sums[c] for c in got], np.sort(sums.ravel()))


def test_mixing_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    weights = {"good": 0.7, "poor": 0.2, "toxic": 0.1}
    mixed = mixing.mix(docs, labels.select("doc_id", domain.alias("domain")), weights).cache()
    p = F.col("posterior")
    sums = mixed.agg(
        F.sum("tokens"), *[F.sum(F.col("tokens") * p[i] * F.col("rate")) for i in range(3)], F.min("rate"),
        F.max(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1)),
    ).first()
    assert mixed.count() == docs.count() and sums[4] >= 0 and sums[5] < 1e-6
    assert np.allclose(np.array(sums[1:4]) / sums[0], list(weights.values()), atol=2e-4)


def test_mixing_learns_domains(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.where("doc_id % 5 > 0").select("doc_id", F.col("lang").alias("domain"))
    mixed = mixing.mix(docs, known, {"en": 1, "de": 1, "fr": 1, "es": 1})
    best = F.array_position("posterior", F.array_max("posterior"))
    rows = mixed.select("doc_id", best.alias("best")).join(docs, "doc_id").where("doc_id % 5 = 0")
    right = [["en", "de", "fr", "es"][int(r.best) - 1] == r.lang for r in rows.select("best", "lang").collect()]
    assert np.mean(right) > 0.9


def test_mixing_with_awkward_rows(spark):
    docs = samples.docs(spark)
    known = spark.createDataFrame([(1, "a"), (5, "b"), (7, "b"), (9, None), (None, "a")], "doc_id long, domain string")
    mixed = mixing.mix(docs, known, {"a": 0.5, "b": 0.5}).collect()
    assert len(mixed) == len(samples.TEXTS) and {r.tokens for r in mixed if r.doc_id in (3, 4)} == {0}
    assert all(r.rate >= 0 for r in mixed)
    more = mixing.resample(docs, known, {"a": 0.6, "b": 0.4})
    assert more.columns == docs.columns and more.count() >= len(samples.TEXTS)
    assert {r.doc_id for r in more.select("doc_id").collect()} == {i for i, _ in samples.TEXTS}
    even = mixing.mix(docs, known.limit(0), {"a": 0.5, "b": 0.5}).collect()
    assert {tuple(r.posterior) for r in even} == {(0.5, 0.5)}
    assert mixing.mix(docs.limit(0), known, {"a": 0.5, "b": 0.5}).count() == 0


CHANGE = "doc_id long, version string, source string, lang string, n_tokens long, seq int, docs string"


def test_rollup_against_a_loop(spark):
    store = rollup.Rollup(spark, staged_path(spark, "rollup-test"))
    assert store.totals().count() == 0
    batches = [
        [(1, "v", "s", "en", 10, 0, ""), (2, "v", "s", "en", 5, 0, ""), (None, "v", None, None, 7, 0, "")],
        [(1, "v", "s", "en", 12, 0, ""), (1, "v", "s", "en", 11, 1, ""), (2, "v", "t", "de", 5, 0, "")],
        [(2, "v", "s", "en", None, 0, ""), (9, "v", "s", "en", None, 0, ""), (1, "w", "s", "en", 3, 0, "")],
        [],
        [(None, "v", None, None, None, 0, "")],
    ]
    state = {}
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, CHANGE)
        assert store.apply(n, rows) is True
        assert store.apply(n, rows) is False
        for i, v, s, lang, tokens, *_ in sorted(batch, key=lambda r: r[5]):
            state.pop((i, v), None)
            if tokens is not None:
                state[i, v] = (s, lang, tokens)
        want = {}
        for (_, v), (s, lang, tokens) in state.items():
            docs, total = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = (docs + 1, total + tokens)
        got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in store.totals().collect()}
        assert got == want
    broken = f"{store.folder}/ledger/batch=7"
    spark.createDataFrame([(5, "v", "s", "en", 1, 99)], rollup._LEDGER).write.parquet(broken)
    assert store.committed() == [0, 1, 2, 3, 4] and got == {
        (r.source, r.lang, r.version): (r.docs, r.tokens) for r in store.totals().collect()
    }


def test_snapshots_change_no_total_and_bound_what_a_batch_reads(spark):
    schema = "doc_id long, version string, source string, lang string, n_tokens long, seq int"

    def batch(n):
        return spark.createDataFrame([(i, "v", "s", "en", 10 * n + i, 0) for i in range(n % 3, 40, 3)], schema)

    kept = rollup.Rollup(spark, staged_path(spark, "rollup-kept"), compact_every=3)
    plain = rollup.Rollup(spark, staged_path(spark, "rollup-plain"), compact_every=1000)
    ledger = []
    for n in range(10):
        assert kept.apply(n, batch(n)) and plain.apply(n, batch(n))
        assert kept.committed() == plain.committed() == list(range(n + 1))
        assert {tuple(r) for r in kept.totals().collect()} == {tuple(r) for r in plain.totals().collect()}
        ledger.append(kept._read("ledger", rollup._LEDGER).count())
    assert {tuple(r) for r in kept.counts().collect()} == {tuple(r) for r in plain.counts().collect()}
    assert max(ledger[3:]) <= 40 + 2 * 2 * 14  # as many documents as there are, and two batches of changes
    assert kept.apply(4, batch(99)) is False
    # A snapshot without its list of batches doesn't count.
    plain.counts().write.parquet(f"{kept.folder}/snapshot=99/ledger")
    assert {tuple(r) for r in kept.totals().collect()} == {tuple(r) for r in plain.totals().collect()}


def test_sieve_loses_no_member_and_moves_few_others(spark):
    from likewise.llm.sieve import sieve

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 't' AS text"))
    members = spark.range(0, 20_000, 97).select(F.col("id").alias("m"))
    kept = sieve(rows, [F.col("doc_id")], members, [F.col("m")], bits=1 << 20)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == ["doc_id", "text"] and set(range(0, 20_000, 97)) <= ids and len(ids) < 260
    assert sieve(rows, [F.col("doc_id")], members.limit(0), [F.col("m")]).count() == 0
    assert "Exchange hashpartitioning(doc_id" not in kept._jdf.queryExecution().executedPlan().toString()


def test_rollup_counts_are_those_of_the_library(spark, tokenizer):
    from likewise.llm import queries

    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in queries.op10(spark, SF).collect()}
    import re

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = {}
    for i, r in rows.items():
        known = labels.get(i)
        if known is not None and known.toxic == 1:
            continue
        text = r.text or ""
        if known is not None and known.quality == 0:
            text = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        sizes = {"words": len(re.findall(r"[^\x20\x09-\x0D]+", text)), "byte_bpe_50k": len(tokenizer.encode_ordinary(text))}
        for version, n in sizes.items():
            docs, total = want.get((r.source, r.lang, version), (0, 0))
            want[r.source, r.lang, version] = (docs + 1, total + n)
    assert got == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = staged_path(spark, "stage")
        stage(spark, seen[-1], SF).write.parquet(path)
        seen.append(spark.read.parquet(path))
        assert seen[-1].columns == columns
    toxic, exact, near, mixed = seen[1:]
    assert exact.count() == toxic.select("text").distinct().count()
    groups = samples.near([(r.doc_id, r.text) for r in exact.collect()], link=80)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in groups.items() if i == c}
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in near.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, SF).collect()
    assert len(last) == mixed.count() and all(r.round_trip for r in last)


def test_helper_columns_take_no_name_that_is_there(spark):
    extra = {"_n": "n", "_turn": "turn", "_id": "id", "_place": "place", "__place": "more"}
    docs = samples.docs(spark)
    docs = docs.withColumns({name: F.lit(value) for name, value in extra.items()})
    known = spark.createDataFrame([(1, "a"), (5, "b"), (7, "b")], "doc_id long, domain string")
    for rows in (exact.drop_copies(docs), mixing.resample(docs, known, {"a": 0.6, "b": 0.4})):
        assert rows.columns == docs.columns
        found = rows.collect()
        assert {tuple(r[name] for name in extra) for r in found} == {tuple(extra.values())}
    assert len(found) >= docs.count()
    assert exact.exact_groups(docs).count() == docs.count()


def test_pipeline_stages_with_awkward_rows(spark):
    docs = samples.docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            path = staged_path(spark, "stage")
            stage(spark, rows, SF).write.parquet(path)
            assert (spark.read.parquet(path).count() > 0) == (rows is docs)


def test_the_classifier_runs_once_a_document(spark):
    """Its functions lie in no lambda, which would run them again for each domain."""
    rows = [(i, "spam now" if i % 2 else "calm text") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labelled = docs.selectExpr("doc_id", "if(doc_id % 2 = 1, 'a', 'b') AS domain")
    domains = ["a", "b", "none"]
    members = mixing.memberships(docs, mixing.learn(docs, labelled, domains), domains)
    assert "lambda" not in members._jdf.queryExecution().optimizedPlan().toString()
    for row in members.collect():
        assert len(row.posterior) == 3 and row.posterior[2] == 0.0
        assert row.posterior[row.doc_id % 2 == 0] > 0.5 and abs(sum(row.posterior) - 1) < 1e-9
