"""Sums of matches, by lists of places and by single matches."""

import random

from likewise.operators import scoring as sc

TERMS = "query_id bigint, sig bigint, field string, term string, boost double, bit bigint"


def tables(spark):
    rng = random.Random(4)
    lists = {t: rng.sample(range(1, 200), rng.randrange(1, 60)) for t in "abcdefgh"}
    postings = [("f", t, 1.0 + i, b, p[b::2]) for i, (t, p) in enumerate(lists.items()) for b in (0, 1) if p[b::2]]
    terms = [(q, q % 2, "f", t, 0.5, 1) for q in range(12) for t in rng.sample("abcdefghxy", 1 + q % 7)]
    taken = [(q, q % 2, p) for q in range(12) for p in rng.sample(range(1, 200), 9)]
    want = {}
    for q, sig, f, t, boost, _ in terms:
        for _, _, idf, _, places in (x for x in postings if x[1] == t):
            for p in places:
                want[q, sig, p] = want.get((q, sig, p), 0.0) + boost * idf
    for gone in taken:
        want.pop(gone, None)
    return (
        spark.createDataFrame(terms, TERMS),
        spark.createDataFrame(postings, "field string, term string, idf double, block bigint, places array<bigint>"),
        spark.createDataFrame(taken, "query_id bigint, sig bigint, pos bigint"),
        want,
    )


def test_long_and_other_queries_add_up_the_same(spark, monkeypatch):
    terms, postings, taken, want = tables(spark)
    for most in (0, 13, 4096):
        monkeypatch.setattr(sc, "LONG", most)
        found = sc.term_sums(terms, postings, taken).collect()
        assert len(found) == len(want)
        assert {(r.query_id, r.sig, r.pos): round(r.score, 9) for r in found} == want


def test_matches_are_made_in_the_query_s_task(spark):
    """What is shuffled is a row per term and list of places, not one per match."""
    terms, postings, _, _ = tables(spark)
    text = sc.term_sums(terms, postings)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode(places") < text.index("RepartitionByExpression [query_id")
