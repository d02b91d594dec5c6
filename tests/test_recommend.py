from collections import defaultdict
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import brute
from likewise import EngineParams, FieldRule, Indicator, Ranking
from likewise.operators import backfill as bf
from likewise.operators import model as md
from likewise.plans.recommend import recommend
from likewise.plans.train import train
from shop import BOOKS, EVENTS, NOW, READERS, book_props, event_log, usage_rows

PARAMS = EngineParams(
    tuple(Indicator(n, max_query_events=12) for n in EVENTS),
    num=5,
    rankings=(Ranking("popular", event_names=("buy",)), Ranking("userDefined")),
)

RULES = "array<struct<name:string,values:array<string>,bias:double>>"
SCHEMA = f"""query_id string, user string, user_bias double, item string, item_bias double,
 item_set array<string>, item_set_bias double, fields {RULES}, current_date timestamp,
 date_range struct<name:string,before:timestamp,after:timestamp>, blacklist_items array<string>,
 return_self boolean, num int, `from` int, event_names array<string>, with_ranks boolean"""
COLUMNS = [c.strip().split()[0].strip("`") for c in SCHEMA.replace(f"{RULES}", "x").replace(
    "struct<name:string,before:timestamp,after:timestamp>", "x").split(",")]


def ask(spark, model, log, queries, params=PARAMS, now=NOW):
    rows = [tuple({"query_id": q, **given}.get(c) for c in COLUMNS) for q, given in queries.items()]
    found = recommend(spark.createDataFrame(rows, SCHEMA), model, log, params, now)
    answers = defaultdict(list)
    for r in found.orderBy("query_id", "pos").collect():
        answers[r.query_id].append((r.item, r.score))
    return answers


@pytest.fixture(scope="module")
def log(spark):
    return event_log(spark).cache()


@pytest.fixture(scope="module")
def model(spark, log):
    return train(log, PARAMS, NOW)


class Shop:
    """Everything brute force needs to know."""

    def __init__(self):
        rows = usage_rows()
        self.rows = rows
        self.lists = brute.correlators([r[:3] for r in rows], EVENTS)
        self.props = book_props()
        items = set(self.props) | {i for i, _ in self.lists} | {i for _, e, i, _ in rows if e == "buy"}
        self.documents = {i: {k: v for k, v in self.props.get(i, {}).items()} for i in items}
        for (i, e), found in self.lists.items():
            self.documents[i][e] = [c for c, _ in found]
        bought = defaultdict(int)
        for _, e, i, _ in rows:
            bought[i] += e == "buy"
        own = lambda i: float(self.props[i]["userRank"][0]) if i in self.props else None
        down = lambda x: (x is None, -(x or 0))
        self.order = sorted(items, key=lambda i: (down(bought[i] or None), down(own(i)), i))

    def history(self, user, names=EVENTS, cap=12):
        clauses = []
        for name in names:
            mine = sorted(
                ((t, i) for u, e, i, t in self.rows if u == user and e == name),
                key=lambda x: (-x[0].timestamp(), x[1]),
            )
            clauses += [(name, i, 1.0) for i in {i for _, i in mine[:cap]}]
        return clauses

    def similar(self, item):
        return [(e, c, 1.0) for e in EVENTS for c, _ in self.lists.get((item, e), [])[:12]]

    def bought(self, user, names=("buy",)):
        return {i for u, e, i, _ in self.rows if u == user and e in names}

    def has(self, item, field, *values):
        return bool(set(self.props.get(item, {}).get(field, ())) & set(values))

    def answer(self, clauses, taken=(), **kwargs):
        return brute.recommend(self.order, self.documents, clauses, set(taken), **{"num": 5, **kwargs})


SHOP = Shop()


def test_the_ranking_orders_all_items(model):
    got = [r.item for r in model.items.orderBy("pos").collect()]
    assert got == SHOP.order


def test_users_items_carts_and_mixtures(spark, model, log):
    queries = {f"u {u}": {"user": u} for u in READERS}
    queries |= {f"i {b}": {"item": b} for b in BOOKS}
    queries |= {f"c {a}": {"item_set": [a, b]} for a, b in zip(BOOKS, BOOKS[3:])}
    queries |= {f"m {u} {b}": {"user": u, "item": b} for u, b in zip(READERS, BOOKS)}
    got = ask(spark, model, log, queries)
    for u in READERS:
        assert got[f"u {u}"] == SHOP.answer(SHOP.history(u), SHOP.bought(u)), u
    for b in BOOKS:
        assert got[f"i {b}"] == SHOP.answer(SHOP.similar(b), {b}), b
    for a, b in zip(BOOKS, BOOKS[3:]):
        assert got[f"c {a}"] == SHOP.answer([("buy", a, 1.0), ("buy", b, 1.0)], {a, b})
    for u, b in zip(READERS, BOOKS):
        both = SHOP.history(u) + SHOP.similar(b)
        assert got[f"m {u} {b}"] == SHOP.answer(both, SHOP.bought(u) | {b})


def test_unknown_users_and_items_get_the_ranking(spark, model, log):
    got = ask(spark, model, log, {"none": {}, "who": {"user": "nobody"}, "what": {"item": "nothing"}})
    top = [(i, 0.0) for i in SHOP.order[:5]]
    assert got["none"] == got["who"] == got["what"] == top


def test_rules(spark, model, log):
    u = READERS[1]
    filters = [("genre", ["novel", "prize"], -1.0), ("shelf", ["0", "1", "2"], -3.0)]
    queries = {
        "filter": {"user": u, "fields": filters},
        "exclude": {"user": u, "fields": [("genre", ["novel"], 0.0)]},
        "boost": {"user": u, "fields": [("genre", ["novel", "prize"], 2.5)]},
        "all": {"fields": [("genre", ["verse"], 3.0), ("shelf", ["1"], 0.0), ("genre", ["verse", "essay"], -1.0)]},
        "no such": {"user": u, "fields": [("colour", ["red"], -1.0)]},
    }
    got = ask(spark, model, log, queries)
    mine, had = SHOP.history(u), SHOP.bought(u)
    passes = lambda i: SHOP.has(i, "genre", "novel", "prize") and SHOP.has(i, "shelf", "0", "1", "2")
    assert got["filter"] == SHOP.answer(mine, had, allowed=passes)
    assert got["exclude"] == SHOP.answer(mine, had, allowed=lambda i: not SHOP.has(i, "genre", "novel"))
    boosts = [("genre", "novel", 2.5), ("genre", "prize", 2.5)]
    assert got["boost"] == SHOP.answer(mine + boosts, had)
    assert got["all"] == SHOP.answer(
        [("genre", "verse", 3.0)],
        allowed=lambda i: SHOP.has(i, "genre", "verse", "essay") and not SHOP.has(i, "shelf", "1"),
    )
    assert got["no such"] == []


def test_filters_never_change_scores(spark, model, log):
    u = READERS[2]
    got = ask(spark, model, log, {
        "open": {"user": u, "num": 99},
        "tight": {"user": u, "num": 99, "fields": [("genre", ["essay"], -1.0)]},
    })
    scores = dict(got["open"])
    assert got["tight"] and all(scores[i] == s for i, s in got["tight"])


def test_rules_of_the_engine_join_those_of_the_query(spark, model, log):
    engine = replace(PARAMS, fields=(FieldRule("shelf", ("3",), 0.0), FieldRule("genre", ("verse",), 2.0)))
    got = ask(spark, model, log, {"q": {"fields": [("genre", ["verse"], 2.0)]}}, engine)
    want = SHOP.answer([("genre", "verse", 2.0)], allowed=lambda i: not SHOP.has(i, "shelf", "3"))
    assert got["q"] == want


def test_biases(spark, model, log):
    u, b = READERS[0], BOOKS[2]
    got = ask(spark, model, log, {
        "user": {"user": u, "item": b, "user_bias": 2.0},
        "item": {"user": u, "item": b, "item_bias": 3.0},
        "cart": {"item_set": [b], "item_set_bias": 1.5},
        "no cart": {"item_set": [b], "item_set_bias": 0.0},
    })
    times = lambda clauses, x: [(f, t, x) for f, t, _ in clauses]
    mine, similar, had = SHOP.history(u), SHOP.similar(b), SHOP.bought(u) | {b}
    assert got["user"] == SHOP.answer(times(mine, 2.0) + similar, had)
    assert got["item"] == SHOP.answer(mine + times(similar, 3.0), had)
    assert got["cart"] == SHOP.answer([("buy", b, 1.5)], {b})
    assert got["no cart"] == SHOP.answer([], {b})


def test_a_negative_bias_requires_a_match_of_every_event_type(spark, model, log):
    u, b = READERS[0], BOOKS[1]
    got = ask(spark, model, log, {
        "u": {"user": u, "user_bias": -1.0, "event_names": ["buy", "follow"]},
        "i": {"item": b, "item_bias": -1.0},
        "stranger": {"user": "nobody", "user_bias": -1.0},
    })
    _, found = brute.weights(SHOP.documents)

    def matched(item, clauses, names):
        return {f for f, t, _ in clauses if item in found.get((f, t), ())} >= set(names)

    mine = SHOP.history(u, ["buy", "follow"])
    assert got["u"] == SHOP.answer([], SHOP.bought(u), allowed=lambda i: matched(i, mine, ["buy", "follow"]))
    similar = SHOP.similar(b)
    assert got["i"] == SHOP.answer([], {b}, allowed=lambda i: matched(i, similar, EVENTS))
    assert got["stranger"] == []


def test_event_names_choose_the_history_but_not_the_blacklist(spark, model, log):
    u = READERS[1]
    got = ask(spark, model, log, {"q": {"user": u, "event_names": ["follow"]}})
    assert got["q"] == SHOP.answer(SHOP.history(u, ["follow"]), SHOP.bought(u))


def test_blacklists(spark, model, log):
    u, b = READERS[3], BOOKS[4]
    query = {"q": {"user": u, "item": b, "return_self": True, "blacklist_items": BOOKS[:2]}}
    clauses = SHOP.history(u) + SHOP.similar(b)
    no_events = replace(PARAMS, blacklist_events=())
    assert ask(spark, model, log, query, no_events)["q"] == SHOP.answer(clauses, BOOKS[:2])
    browsed = replace(PARAMS, blacklist_events=("browse",))
    had = SHOP.bought(u, ["browse"]) | set(BOOKS[:2])
    assert ask(spark, model, log, query, browsed)["q"] == SHOP.answer(clauses, had)


def test_pages_add_up(spark, model, log):
    u = READERS[0]
    got = ask(spark, model, log, {
        "whole": {"user": u, "num": 8},
        "one": {"user": u, "num": 3},
        "two": {"user": u, "num": 5, "from": 3},
        "past the end": {"user": u, "num": 5, "from": 500},
    })
    assert got["whole"] == got["one"] + got["two"]
    assert got["past the end"] == []


def test_dates(spark, log):
    dated = replace(PARAMS, available_date_name="from", expire_date_name="till", date_name="day")
    model = train(log, dated, NOW)
    day = {b: datetime.fromisoformat(p["day"][0]) for b, p in book_props().items()}
    later, edge = NOW + timedelta(days=4), day[BOOKS[3]]
    got = ask(spark, model, log, {
        "now": {"num": 20},
        "later": {"num": 20, "current_date": later},
        "after": {"num": 20, "date_range": ("day", None, edge)},
        "between": {"num": 20, "date_range": ("day", NOW, NOW - timedelta(days=20))},
        "range wins": {"num": 20, "date_range": ("day", edge, None), "current_date": later},
        "no date": {"num": 20, "date_range": ("genre", NOW, None)},
    }, dated)

    def items(test):
        return [i for i in SHOP.order if i in day and test(i)]

    open_at = lambda t: lambda i: day[i] <= t < day[i] + timedelta(days=20)
    names = {q: [i for i, _ in a] for q, a in got.items()}
    assert names["now"] == items(open_at(NOW)) and names["later"] == items(open_at(later))
    assert names["after"] == items(lambda i: day[i] > edge)
    assert names["between"] == items(lambda i: NOW - timedelta(days=20) < day[i] < NOW)
    assert names["range wins"] == items(lambda i: day[i] < edge)
    assert "no date" not in names


def test_modes(spark, model, log):
    u = READERS[0]
    query = {"q": {"user": u, "num": 99}}
    every = ask(spark, model, log, query)["q"]
    cf = replace(PARAMS, recs_model="collabFiltering")
    only = ask(spark, train(log, cf, NOW), log, query, cf)["q"]
    assert {i for i, _ in only} <= {i for i, _ in every} and all(s > 0 for _, s in only)
    ranked = replace(PARAMS, recs_model="backfill")
    got = ask(spark, train(log, ranked, NOW), log, query, ranked)["q"]
    assert all(s == 0 for _, s in got)
    had = SHOP.bought(u)
    known = [i for i in SHOP.order if i not in had]
    assert [i for i, _ in got] == known


def test_ranks_come_along_where_asked(spark, model, log):
    rows = [("with", True), ("without", False)]
    queries = spark.createDataFrame(rows, "query_id string, with_ranks boolean")
    found = recommend(queries, model, log, PARAMS, NOW).collect()
    assert all((r.ranks is not None) == (r.query_id == "with") for r in found)
    top = min((r for r in found if r.query_id == "with"), key=lambda r: r.pos)
    assert top.ranks["popRank"] == max(r.ranks.get("popRank", 0) for r in found if r.ranks)


def test_small_pages_blocks_and_hot_terms_change_nothing(spark, log, monkeypatch):
    """Same answers when lists, pages and blocks are cut far smaller than the data."""
    monkeypatch.setattr(bf, "PAGE", 2)
    monkeypatch.setattr(bf, "FIRST_PAGES", 1)
    monkeypatch.setattr(bf, "GROWTH", 2)
    monkeypatch.setattr(md, "BLOCK", 2)
    model = train(log, PARAMS, NOW)
    assert model.postings.agg(F.max("block")).first()[0] > 0
    u = READERS[0]
    rule = [("genre", ["novel"], 0.0)]
    rare = [("shelf", ["4"], -1.0)]
    got = ask(spark, model, log, {
        "u": {"user": u, "num": 9},
        "listed": {"user": u, "num": 9, "blacklist_items": SHOP.order[:6]},
        "rule": {"fields": rule, "num": 9},
        "rare": {"fields": rare, "num": 9},
        "short": {"fields": rule, "num": 1},
    })
    mine, had = SHOP.history(u), SHOP.bought(u)
    assert got["u"] == SHOP.answer(mine, had, num=9)
    assert got["listed"] == SHOP.answer(mine, had | set(SHOP.order[:6]), num=9)
    assert got["rule"] == SHOP.answer([], allowed=lambda i: not SHOP.has(i, "genre", "novel"), num=9)
    assert got["rare"] == SHOP.answer([], allowed=lambda i: SHOP.has(i, "shelf", "4"), num=9)
    assert got["short"] == got["rule"][:1]


def test_one_user_with_a_third_of_all_events(spark):
    """Half the catalog excluded for one query, everything still filled."""
    rows = [("buy", "user", "hot", "item", f"i{n:04d}", None, NOW - timedelta(minutes=n), n) for n in range(600)]
    rows += [
        ("buy", "user", f"u{n % 200}", "item", f"i{n * 7 % 1200:04d}", None, NOW - timedelta(hours=n + 1), n)
        for n in range(1200)
    ]
    log = spark.createDataFrame(rows, event_log(spark).schema)
    params = EngineParams.of("buy", num=30)
    model = train(log, params, NOW)
    queries = spark.createDataFrame([("hot", "hot"), ("u3", "u3")], "query_id string, user string")
    found = recommend(queries, model, log, params, NOW).collect()
    had = {r[4] for r in rows if r[2] == "hot"}
    hot = [r.item for r in found if r.query_id == "hot"]
    assert len(hot) == len(set(hot)) == 30 and not set(hot) & had
