"""License statements, personal data, toxicity: against plain loops and held-out labels."""

import re
from collections import defaultdict

import numpy as np
import samples
from pyspark.sql import functions as F

from likewise.llm import licenses, pii, toxicity
from likewise.llm import text as tx

def licenses_by_loop(text):
    split = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", samples.lower(s)) if w]
    words = split(text)
    places = sorted(
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    best = {}
    for at in range(0, max(1, len(words)), licenses.WINDOW // 2):
        block = set(words[at : at + licenses.WINDOW])
        for label, template in licenses.TEMPLATES.items():
            want = set(template.split())
            share = len(want & block) / len(want)
            if share >= licenses.THRESHOLD:
                best[label] = max(best.get(label, 0), share)
    base = sorted({label for _, label in places})
    return (
        len(words),
        len(places),
        places[0][0] if places else None,
        places[-1][0] if places else None,
        ",".join(base),
        ",".join(sorted({*base, *best})),
        1.0 if places else max(best.values(), default=0.0),
    )


LICENSES = [
    *samples.TEXTS,
    (20, "cc by cc-by CC  BY\nacc by; all rights\nreserved. General Public License"),
    (21, "pad " * 200 + "released under the MIT license " + "pad " * 200 + "cc by"),
    (22, "license mit the under released"),
    (23, "under the license of mit"),
    (24, "worK licensed under the Apache license"),
    (25, "Permission is hereby granted, free of charge,\nto any person obtaining a copy"),
    (26, " *  Redistribution and use in source\n *  and binary forms, with or\n *  without modification,\n"),
    (27, "pad\n" * 70 + "Provided\nas is,\nwithout warranty\nof any kind,\nexpress or implied\n" + "pad\n" * 70),
]


def test_licenses_with_awkward_rows(spark):
    rows = licenses.scan(samples.docs(spark, LICENSES)).collect()
    got = sorted(
        (str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels, round(r.score, 9))
        for r in rows
    )
    want = []
    for i, t in LICENSES:
        n, k, lo, hi, base, labels, score = licenses_by_loop(t)
        want.append((str(i), n, k, str(lo), str(hi), base, labels, round(score, 9)))
    assert got == sorted(want)
    wrapped = {r.doc_id: r.labels for r in rows if r.doc_id in (25, 26, 27)}
    assert wrapped == {25: "mit-text", 26: "bsd", 27: "no-warranty"}
    assert licenses.scan(samples.docs(spark).limit(0)).count() == 0


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii_by_loop(text):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"\D", "", m.group())
            fine = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


PII = [
    *samples.TEXTS,
    (30, "😀 x@y.z@q.r.s a@b a@b.c_d@e.f -x@-.- ü@ü.de user.name+tag@mail-1.example.co.uk."),
    (31, "1.2.3.4.5.6.7.8 01.002.0003.255 256.1.1.1 1.1.1.256 1..2.3.4 00000000000000255.0.0.0"),
    (32, "4539-1488-0343-6467 4539 1488 0343 6468 " + "9" * 5000 + " 0 00 000000000000 4539  1488"),
    (33, "+1 (555) 123-4567 +1.2 +12345678 +123456789 +1234567890123456 ++1 555 123 4567("),
    (34, "a" * 50_000 + "@" + "b" * 50_000 + " " + "1." * 20_000),
    (35, 'token = "04dbebab91ab85687d33eeaaf9ac699e" password: hunter2hunter2'),
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = pii.find(samples.docs(spark, PII)).collect()
    got = sorted((str(r.doc_id), [(x.start, x.kind, x.end) for x in r.base]) for r in rows)
    assert got == sorted((str(i), pii_by_loop(t)) for i, t in PII)
    for r in rows:
        assert {(x.start, x.kind, x.end) for x in r.base} <= {(x.start, x.kind, x.end) for x in r.spans}
        assert all(a.start <= b.start for a, b in zip(r.spans, r.spans[1:]))
    assert pii.find(samples.docs(spark).limit(0)).count() == 0


def test_trees_add_secrets_and_keep_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.find(docs).cache()
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    n = {r.kind: r.n for r in spans.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert n.get(pii.KINDS.index("secret"), 0) > 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found.collect():
        assert [(x.start, x.kind, x.end) for x in r.base] == pii_by_loop(texts[r.doc_id])


def test_trees_learn_although_one_candidate_has_most_copies(spark):
    secret = pii.KINDS.index("secret")
    forms = [(f"{i:032x}", 1.0) for i in range(60)] + [(f"value-{i}_zzzz", 0.0) for i in range(60)]
    rows = [(secret, m, "token = ", " end", label) for m, label in forms]
    candidates = spark.createDataFrame(rows, "kind int, match string, before string, after string, label double")
    candidates = candidates.withColumns({"start": F.lit(0), "doc_id": F.lit(1)})
    first = candidates.orderBy(F.xxhash64("match", "before", "after")).limit(1)
    crowd = first.withColumn("doc_id", F.explode(F.sequence(F.lit(1), F.lit(500))))
    model, least = pii.learn(candidates.unionByName(crowd), sample=100)
    assert least[secret] <= 1.0


def test_spans_cross_lines_and_need_no_digit_or_sign(spark):
    rows = [
        (1, "a line\njane (at) example.org\nmore"),
        (2, "write john[at]example.org today"),
        (3, "password:\n s3cr3tvalue1x"),
        (4, "password =\n04dbebab91ab85687d33eeaaf9ac699e"),
    ]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    proposed = found.select("doc_id", F.explode(pii._proposed(F.col("text"))).alias("p")).select("doc_id", "p.*")
    got = {(r.doc_id, pii.KINDS[r.kind], r.match) for r in proposed.collect()}
    assert {
        (1, "email", "jane (at) example.org"),
        (2, "email", "john[at]example.org"),
        (3, "secret", "s3cr3tvalue1x"),
        (4, "secret", "04dbebab91ab85687d33eeaaf9ac699e"),
    } <= got


def test_spans_are_taken_in_order_among_those_that_stay(spark):
    rows = [
        (1, 0, 0, 10, 1.0, True), (1, 5, 0, 20, 0.9, False), (1, 15, 1, 30, 0.8, False),
        (1, 29, 2, 40, 0.8, False), (1, 30, 2, 35, 0.8, False), (1, 33, 3, 34, 0.7, False),
        (2, 0, 0, 5, 0.9, False), (2, 0, 0, 9, 0.9, False), (2, 5, 1, 9, 0.9, False), (2, 9, 1, 12, 0.5, False),
    ]
    schema = "doc_id long, start long, kind int, end long, score double, is_base boolean"
    spans = spark.createDataFrame(rows, schema).withColumn("row", F.lit(7).cast("bigint"))
    got = {(r.doc_id, r.start, r.end) for r in pii._without_overlaps(spans).collect()}
    assert got == {(1, 0, 10), (1, 15, 30), (1, 30, 35), (2, 0, 9), (2, 9, 12)}


def test_veiled_forms_of_several_kinds_are_added(spark):
    rng = np.random.default_rng(4)
    prose = lambda: " ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.integers(0, 400, 8))

    def card():
        digits = "4" + "".join(str(x) for x in rng.integers(0, 10, 14))
        return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))

    def number(n):
        return "".join(str(x) for x in rng.integers(0, 10, n))

    made = {
        "email": lambda: f"{prose().split()[0]}.{number(2)}@mail{number(1)}.example.com",
        "card": card,
        "phone": lambda: f"+1 ({number(3)}) 555-{number(4)}",
        "secret": lambda: 'token = "' + "".join(rng.choice(list("0123456789abcdef"), 40)) + '"',
    }
    rows, planted = [], {}
    for i in range(240):
        kind = list(made)[i % 4]
        rows.append((i, f"{prose()} {made[kind]()} {prose()}"))
    for i in range(240, 300):  # numbers that are nothing
        rows.append((i, f"{prose()} {number(11)} {prose()} 1.{number(2)}.{number(1)} {prose()}"))
    veils = {
        "email": lambda: made["email"]().replace("@", " (at) "),
        "card": lambda: ".".join(re.findall("....", card())),
        "phone": lambda: made["phone"]()[1:],
    }
    for i in range(300, 330):
        kind = list(veils)[i % 3]
        own = veils[kind]()
        rows.append((i, f"{prose()} {own} {prose()}"))
        planted[i] = (pii.KINDS.index(kind), own)
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    added = {
        (r.doc_id, x.kind, texts[r.doc_id][x.start : x.end])
        for r in found for x in r.spans if x.score < 1 or (x.start, x.kind, x.end) not in {(b.start, b.kind, b.end) for b in r.base}
    }
    caught = {kind: [(i, kind, own) in added for i, (k, own) in planted.items() if k == kind] for kind in (0, 2, 3)}
    assert all(np.mean(c) > 0.7 for c in caught.values()), caught
    clean = [r for r in found if 240 <= r.doc_id < 300]
    assert np.mean([len(r.spans) == 0 for r in clean]) > 0.9


def test_redaction(spark):
    text = "call +1 (555) 123-4567 or a@b.example now"
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    out = row.select(pii.redact(F.lit(text), F.col("base")).alias("t")).first().t
    assert out == "call [phone] or [email] now"


def test_running_starts_over_many_pieces(spark):
    lengths = [i % 7 for i in range(1000)]
    got = spark.createDataFrame([(lengths,), ([],)], "l array<bigint>").select(tx.running_starts(F.col("l")).alias("s")).collect()
    assert got[0].s == [sum(lengths[:i]) for i in range(1000)] and got[1].s == []


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    vectors, dense = [], np.zeros((400, 50))
    for i in range(400):
        t = np.sort(rng.choice(50, rng.integers(0, 6), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        w = w / np.sqrt(w @ w) if len(t) else w
        vectors.append((t, w))
        dense[i, t] = w
    ids = rng.permutation(400).astype(np.int64)
    index = toxicity.Index.of(ids, np.zeros(400), vectors, 50)
    for i in range(100):
        place, cosine = index.nearest(*vectors[i], 7)
        all_cosines = dense @ dense[i]
        order = np.lexsort((ids, -np.round(all_cosines, 12)))
        want = [int(ids[j]) for j in order if all_cosines[j] > 0][:7]
        assert index.ids[place].tolist() == want


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    known = labels.where(toxicity.held_out())
    scored = toxicity.score(docs.join(known.select("doc_id"), "doc_id", "left_semi"), model)
    rows = scored.join(known, "doc_id").select("score", "toxic", "evidence").collect()
    caught = [r.score >= 0.5 for r in rows if r.toxic == 1]
    false = [r.score >= 0.5 for r in rows if r.toxic == 0]
    assert np.mean(caught) > 0.85 and np.mean(false) < 0.03
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_with_awkward_rows(spark):
    rng = np.random.default_rng(5)
    prose = lambda: " ".join(f"w{x}" for x in rng.integers(0, 400, 12))
    insults = [(100 + i, f"{prose()} you idiot {prose()}") for i in range(30)]
    fine = [(200 + i, f"{prose()} lovely day {prose()}") for i in range(60)]
    docs = samples.docs(spark, [*samples.TEXTS, *insults, *fine])
    labels = [(i, 1) for i, _ in insults] + [(i, 0) for i, _ in fine]
    labelled = spark.createDataFrame([*labels, (1, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labelled)
    by = defaultdict(set)
    for r in toxicity.score(docs, model).collect():
        by[r.doc_id].add(r.score)
    assert all(min(by[i]) >= 0.5 for i, _ in insults) and all(max(by[i]) < 0.5 for i, _ in fine)
    assert by[3] == by[4] and len(by[2]) == 1
    left = toxicity.drop_toxic(docs, labelled)
    assert left.schema == docs.schema and left.count() == docs.count() - 30
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs)
    assert toxicity.drop_toxic(unnamed, labelled).count() == 2 * (docs.count() - 30)
    unlabelled = toxicity.fit(docs, labelled.limit(0))
    assert {r.score for r in toxicity.score(docs, unlabelled).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_words_that_few_examples_hold_find_neighbours(spark):
    rng = np.random.default_rng(6)
    prose = lambda: " ".join(f"w{x}" for x in rng.integers(0, 400, 12))
    insults = [*((100 + i, f"{prose()} you idiot {prose()}") for i in range(30)), (150, "zork blip"), (151, "zork blap")]
    fine = [(200 + i, f"{prose()} lovely day {prose()}") for i in range(60)]
    docs = samples.docs(spark, [*insults, *fine, (300, "ZORK, again")])
    labels = [(i, 1) for i, _ in insults] + [(i, 0) for i, _ in fine]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.terms) == {w for _, t in insults + fine for w in toxicity.words(t.encode())}
    row = toxicity.score(docs, model).where("doc_id = 300").first()
    assert {x.example_id for x in row.evidence} == {150, 151} and row.score >= 0.5


def test_g_statistic():
    a, b, n1, n0 = 3, 1, 10, 30
    seen = np.array([[a, b], [n1 - a, n0 - b]], float)
    expected = seen.sum(1, keepdims=True) * seen.sum(0, keepdims=True) / seen.sum()
    got = toxicity.g_statistic(np.array([a, 1, 0]), np.array([b, 3, 30]), n1, n0)
    assert np.isclose(got[0], 2 * (seen * np.log(seen / expected)).sum()) and np.isclose(got[1], 0)
    assert np.isclose(got[2], toxicity.g_statistic(np.array([10]), np.array([0]), n1, n0)[0])


def test_examples_keep_their_own_labels(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (2, passage + " you idiot"), (3, passage + " lovely"), (4, passage), (5, passage), (6, None)]
    labels = [(1, 0), (2, 1), (3, 0), (4, 0), (5, 1), (6, 0)]
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity._examples(samples.docs(spark, rows), labelled, 100).collect()
    texts = dict(rows)
    assert sorted((r.doc_id, r.toxic, r.text) for r in got) == [(i, y, texts[i]) for i, y in ((1, 0), (2, 1), (3, 0), (5, 1))]
