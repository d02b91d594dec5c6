"""Repair of conversations against a plain search over all edits."""

import functools
import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from likewise.llm import conversations, queries

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"
SHA = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        yield from [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def repair(rows):
    """The counts, the cheapest edits and the repaired turns of ordered (turn, role, text)."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.strip(SPACE)[-1:]
        faults.append("" if last in tuple(".!?") else "truncated")
        if not last:
            faults[-1] = "blank"
        elif (role, text) in seen:
            faults[-1] = "duplicate"
        seen.add((role, text))

    @functools.lru_cache(maxsize=None)
    def best(i, roles, begun):
        """(cost, letters, turns) from row i on; ``roles`` are the initials of the last turn."""
        found = []
        if i == len(rows) and roles in ("", "a"):
            found.append((0, "", ()))
        if begun < 3:
            due = "a" if roles == "u" else "u"
            cost, letters, turns = best(i, due, begun + 1)
            full = {"u": "user", "a": "assistant"}[due]
            found.append((cost + 2, "I" + letters, ((full, ""), *turns)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, letters, turns = best(i + 1, roles, 0)
            found.append((cost + 3, "D" + letters, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                first = role[:1]
                if (roles, first) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    cost, letters, turns = best(i + 1, first, 0)
                    found.append((cost + more, "K" + letters, ((role, text), *turns)))
                for full in ("user", "assistant"):
                    if (roles, full[0]) in {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        cost, letters, turns = best(i + 1, full[0], 0)
                        found.append((cost + 2 + more, "R" + letters, ((full, text), *turns)))
        return min(found, default=(10**9, "", ()))

    cost, letters, turns = best(0, "", 0)
    return faults, cost, letters, turns


def report(rows):
    """What the query has to return, from (conv, turn, role, text)."""
    by_conversation = defaultdict(list)
    for conv, turn, role, text in damaged(rows):
        by_conversation[conv].append((turn, role, text))
    want = {}
    for conv in {r[0] for r in rows}:
        own = by_conversation[conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        known = {t for t, _, _ in own if t is not None}
        faults, cost, letters, turns = repair(own)
        initials = [r[:1] for _, r, _ in own]
        want[conv] = (
            max(known) - min(known) + 1 - len(known) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            letters,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
        )
    return want


def asked(spark, rows):
    schema = "role string, conv_id long, text string, turn long, place string, audit string, fault string, _hashed long"
    full = [(r, c, x, t, "p", "a", "f", 1) for c, t, r, x in rows]
    table = spark.createDataFrame(full, schema).repartition(3)
    got = conversations.repair_report(table, conversations.damaged(table)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_long_paths_are_the_cheapest_in_every_stretch_length():
    rng = random.Random(3)
    for _ in range(300):
        codes = bytes(rng.choice([0, 4, 8, 12, 4, 8]) | rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randrange(0, 23)))
        rows, text = [], 0
        for n, code in enumerate(codes):
            text += 1
            rows.append((n, "sua?"[code >> 2], [f"{text}.", "", "", f"{text}"][code & 3]))
        # A duplicate needs an earlier equal row, blank has to be deleted as well.
        blank = bytes(c & ~3 | (1 if c & 3 == 2 else c & 3) for c in codes)
        _, cost, letters, _ = repair(rows)
        for stretch in (1, 2, 5, 128):
            assert conversations.cheapest(blank, stretch) == (cost, letters), codes


def test_many_turns_in_linear_time():
    codes = bytes(random.Random(5).choice([0, 4, 8, 7, 11, 5]) for _ in range(30_000))
    cost, letters = conversations.cheapest(codes)
    assert len(letters.replace("I", "")) == len(codes)
    assert (cost, letters) == conversations.cheapest(codes, 97)


def test_query_on_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = report([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert got == want


def test_awkward_rows(spark):
    rng = random.Random(11)
    texts = ["Fine.", "Fine.", "cut", "", " \t\x0b", None, "Dots. and more ", "ünï 日本!", "\x1c", "x" * 200_000 + "?"]
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "User"]
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rng.randrange(1, 12)):
            turn = rng.choice([None, *range(6), 2**40, -3])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    rows += [(100, 7, "user", "same.")] * 5
    got = asked(spark, rows)
    want = report(rows)
    assert got == want
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert asked(spark, [(dropped, 0, "user", "gone.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", SHA)}
    assert asked(spark, rows[:0]) == {}


def test_one_conversation_in_most_of_the_rows(spark):
    rng = random.Random(7)
    rows = [(1, n, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"{n}.", "no"])) for n in range(220)]
    rows += [(c, n, "user", "Hello.") for c in range(2, 40) for n in range(3)]
    assert asked(spark, rows) == report(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "assistant", "B."), (2, 0, "user", " ")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = conversations.plan(table)
    turns = conversations.repaired(table, plans).orderBy("conv_id", "place").collect()
    by_row = {r.conv_id: r.audit for r in plans.collect()}
    assert by_row[2] == "D" and by_row[1] in ("IKIK", "RK")
    assert [r.role[0] for r in turns] == list("ua") * (len(turns) // 2)
    assert conversations.repaired(table.where(F.lit(False)), plans.limit(0)).count() == 0
