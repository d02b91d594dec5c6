"""SQL counterparts of the recommendation queries: every query against every item."""

from __future__ import annotations

from checks.sql_parts import (
    CATALOG,
    LOG,
    ORDER_LOG,
    USER_RANK,
    best,
    ctes,
    cut,
    fixed6,
    pairs,
    popular,
    stretches,
)
from checks.training_sql import DOCS, LONG_AGO, NAMES, NOW

#: Item documents, inverted and weighted.
INVERTED = """
post AS (SELECT DISTINCT item, field, unnest(vals) AS term FROM docs),
per AS (SELECT field, count(DISTINCT item) AS n FROM post GROUP BY field),
w AS (
  SELECT field, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM post JOIN per USING (field) GROUP BY field, term)"""


def items(rank_columns: list[str]) -> str:
    order = "".join(f"{c} DESC NULLS LAST, " for c in rank_columns)
    return f"""
items AS (
  SELECT item, pop.rank AS popRank, trend.rank AS trendRank, usr.rank AS userRank,
         row_number() OVER (ORDER BY {order}item) AS place
  FROM (SELECT item FROM cat UNION SELECT item FROM corr UNION SELECT item FROM pop) i
  LEFT JOIN pop USING (item) LEFT JOIN trend USING (item) LEFT JOIN usr USING (item))"""


RANKS = ["popRank", "trendRank", "userRank"]


def engine(rank_columns: list[str] | None = None, with_correlators: bool = True) -> str:
    """CTEs of the usage engine: log, corr, cat, docs, post, w, items."""
    pop = popular("pop", "'purchase'", LONG_AGO, NOW)
    trend = stretches("trend", "'purchase'", ["2024-01-01", "2024-01-16", NOW])
    found = best(50) if with_correlators else best(0)
    return ctes(
        LOG, cut(NAMES), pairs("purchase"), found, CATALOG, DOCS, INVERTED, pop, trend, USER_RANK,
        items(RANKS if rank_columns is None else rank_columns),
    )


ALL_EVENTS = "['purchase','view','click']"

#: All users ask; what a query leaves open comes from here.
DEFAULTS = {
    "query_id": "u",
    "usr_id": "u",
    "usr_bias": "1.0",
    "itm": "CAST(NULL AS VARCHAR)",
    "itm_bias": "1.0",
    "cart": "CAST([] AS VARCHAR[])",
    "cart_bias": "1.0",
    "events_used": ALL_EVENTS,
    "n_wanted": "20",
    "n_skip": "0",
    "own_too": "false",
    "banned": "CAST([] AS VARCHAR[])",
}


def asked(source: str = "(SELECT DISTINCT u FROM log)", **given: str) -> str:
    columns = {**DEFAULTS, **given}
    return "q AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {source})"


def rules(*rows: tuple[str, str, float]) -> str:
    """CTE r(query_id, nr, field, vals, bias); values may use u of the query."""
    if not rows:
        return """r AS (SELECT CAST(NULL AS VARCHAR) AS query_id, 0 AS nr, '' AS field,
            CAST([] AS VARCHAR[]) AS vals, 0.5 AS bias WHERE false)"""
    parts = [
        f"SELECT query_id, {nr} AS nr, '{f}' AS field, {v} AS vals, {b} AS bias FROM q"
        for nr, (f, v, b) in enumerate(rows)
    ]
    return "r AS (" + " UNION ALL ".join(parts) + ")"


def matching(cap: int | None = None, blacklist: str = "'purchase'") -> str:
    """CTEs hist, terms, excl, gain; ``cap`` keeps the newest events of each type only."""
    newest = f"WHERE place <= {cap}" if cap else ""
    return f"""
hist AS (
  SELECT DISTINCT u, e, i FROM (
    SELECT *, row_number() OVER (PARTITION BY u, e ORDER BY t DESC, i) AS place FROM log
    WHERE e IN ('purchase', 'view', 'click')) {newest}),
terms AS (
  SELECT query_id, e AS field, i AS term, usr_bias AS boost
  FROM q JOIN hist ON u = usr_id WHERE usr_bias > 0 AND list_contains(events_used, e)
  UNION ALL
  SELECT query_id, event, correlator, itm_bias FROM q JOIN corr ON item = itm{' WHERE rnk <= ' + str(cap) if cap else ''}
  UNION ALL
  SELECT query_id, 'purchase', unnest(cart), cart_bias FROM q
  UNION ALL
  SELECT query_id, field, unnest(vals), bias FROM r WHERE bias > 0),
excl AS (
  SELECT query_id, i AS item FROM q JOIN log ON u = usr_id WHERE e IN ({blacklist})
  UNION SELECT query_id, itm FROM q WHERE itm IS NOT NULL AND NOT own_too
  UNION SELECT query_id, unnest(cart) FROM q
  UNION SELECT query_id, unnest(banned) FROM q),
gain AS (
  SELECT query_id, item, {fixed6("sum(boost * idf)")} AS score
  FROM terms JOIN w USING (field, term) JOIN post USING (field, term) GROUP BY query_id, item)"""


def answers(extra: str = "", columns: str = "", positive: bool = False) -> str:
    """Brute force: every query with every item, rules as conditions."""
    return f"""
listed AS (
  SELECT q.query_id, i.item, coalesce(g.score, 0.0) AS score, {columns}
         row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(g.score, 0.0) DESC, i.place) AS pos,
         q.n_skip, q.n_wanted
  FROM q CROSS JOIN items i LEFT JOIN gain g ON g.query_id = q.query_id AND g.item = i.item
  WHERE NOT EXISTS (SELECT 1 FROM excl x WHERE x.query_id = q.query_id AND x.item = i.item)
  AND NOT EXISTS (
    SELECT 1 FROM r WHERE r.query_id = q.query_id AND r.bias < 0 AND NOT EXISTS (
      SELECT 1 FROM cat c WHERE c.item = i.item AND c.field = r.field AND list_has_any(c.vals, r.vals)))
  AND NOT EXISTS (
    SELECT 1 FROM r JOIN cat c ON c.field = r.field AND list_has_any(c.vals, r.vals)
    WHERE r.query_id = q.query_id AND r.bias = 0 AND c.item = i.item)
  {"AND coalesce(g.score, 0.0) > 0" if positive else ""} {extra})"""


PICK = "SELECT query_id, pos, item, score FROM listed WHERE pos > n_skip AND pos <= n_skip + n_wanted"


def recs(
    q: str = asked(),
    r: str = rules(),
    cap: int | None = None,
    blacklist: str = "'purchase'",
    extra: str = "",
    pick: str = PICK,
    columns: str = "",
    positive: bool = False,
    base: str | None = None,
) -> str:
    found = answers(extra, columns, positive)
    return ", ".join([base or engine(), q, r, matching(cap, blacklist), found]) + " " + pick


_N = "CAST(query_id AS BIGINT)"
_BRAND = f"'Brand#' || CAST({_N} % 25 + 1 AS VARCHAR)"
_SIZE = f"CAST({_N} % 50 + 1 AS VARCHAR)"

_REQUIRED = """
  AND (SELECT count(DISTINCT p.field) FROM hist h JOIN post p ON p.field = h.e AND p.term = h.i
       WHERE h.u = q.usr_id AND p.item = i.item AND list_contains(q.events_used, h.e)) = 2"""

_DATES = """
  AND EXISTS (
    SELECT 1 FROM day d, (SELECT TIMESTAMP '2023-12-20' + to_days(CAST(CAST(q.query_id AS BIGINT) % 40 AS INTEGER)) AS at_day)
    WHERE d.item = i.item AND CASE
      WHEN CAST(q.query_id AS BIGINT) % 2 = 0
        THEN CAST(d.opens AS TIMESTAMP) <= at_day AND at_day < CAST(d.closes AS TIMESTAMP)
      ELSE CAST(d.opens AS TIMESTAMP) > at_day AND (CAST(q.query_id AS BIGINT) % 3 = 0
        OR CAST(d.opens AS TIMESTAMP) < TIMESTAMP '2024-01-25') END)"""

_MOMENTS = """
  AND EXISTS (
    SELECT 1 FROM day d, (SELECT TIMESTAMP '2023-12-20'
        + to_seconds(CAST(q.query_id AS BIGINT) * 7919 % (86400 * 40)) AS asked_at)
    WHERE d.item = i.item AND CAST(d.opens AS TIMESTAMP) <= asked_at AND asked_at < CAST(d.closes AS TIMESTAMP))"""

_NARROW = """
  AND EXISTS (
    SELECT 1 FROM day d, (SELECT TIMESTAMP '2023-12-20' + to_days(CAST(CAST(q.query_id AS BIGINT) % 40 AS INTEGER)) AS at_day)
    WHERE d.item = i.item AND CASE
      WHEN CAST(q.query_id AS BIGINT) % 2 = 0
        THEN CAST(d.opens AS TIMESTAMP) <= TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20' < CAST(d.closes AS TIMESTAMP)
      ELSE CAST(d.opens AS TIMESTAMP) > at_day AND CAST(d.opens AS TIMESTAMP) < at_day + INTERVAL 9 DAY END)"""

_STRANGERS = """(SELECT DISTINCT u, CAST(NULL AS VARCHAR) AS named FROM log
    UNION ALL SELECT c_name, c_name FROM customer)"""

_MIXED = asked(itm="u")


def _mode(mode: str, sql: str) -> str:
    return f"SELECT *, '{mode}' AS mode FROM ({sql})"


SQL: dict[str, str] = {
    "user_recs": recs(),
    "history_cap": recs(cap=3),
    "item_recs": recs(
        asked("(SELECT CAST(p_partkey AS VARCHAR) AS u FROM part)", usr_id="CAST(NULL AS VARCHAR)", itm="u")
    ),
    "item_set_recs": f"""{ctes(ORDER_LOG, cut(['N', 'R', 'A']), pairs('N'), best(50))},
        pop AS (SELECT i AS item, count(*) AS rank FROM log WHERE e = 'N'
                AND t >= TIMESTAMP '2005-01-01' - INTERVAL 3650 DAY AND t < TIMESTAMP '2005-01-01' GROUP BY i),
        items AS (SELECT item, row_number() OVER (ORDER BY rank DESC NULLS LAST, item) AS place
                  FROM (SELECT item FROM corr UNION SELECT item FROM pop) LEFT JOIN pop USING (item)),
        cart AS (SELECT DISTINCT o_orderkey AS query_id, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
        per AS (SELECT count(DISTINCT item) AS n FROM corr WHERE event = 'N'),
        w AS (SELECT correlator, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
              FROM corr CROSS JOIN per WHERE event = 'N' GROUP BY correlator),
        gain AS (SELECT query_id, item, {fixed6('sum(idf)')} AS score
                 FROM cart JOIN w ON w.correlator = cart.i
                 JOIN corr ON corr.event = 'N' AND corr.correlator = cart.i GROUP BY query_id, item),
        listed AS (SELECT g.query_id, g.item, g.score,
                     row_number() OVER (PARTITION BY g.query_id ORDER BY g.score DESC, items.place) AS pos
                   FROM gain g JOIN items USING (item) ANTI JOIN cart c ON c.query_id = g.query_id AND c.i = g.item)
        SELECT query_id, pos, item, score FROM listed WHERE pos <= 20""",
    "mixed_recs": recs(_MIXED),
    "event_name_override": recs(asked(events_used="['view','click']")),
    "cross_recs": recs(asked(events_used="['view']")),
    "popular_recs": recs(
        asked("customer", query_id="c_custkey", usr_id="CAST(NULL AS VARCHAR)", n_wanted="7"),
        rules().replace("CAST(NULL AS VARCHAR) AS query_id", "CAST(NULL AS BIGINT) AS query_id"),
    ),
    "unknown_entity_fallback": recs(asked(_STRANGERS, itm="named", n_wanted="5")),
    "term_match": f"""{engine()}, {asked()}, {rules()}, {matching()}
        SELECT query_id, field, item, count(*) AS n_terms FROM terms JOIN post USING (field, term)
        GROUP BY query_id, field, item""",
    "term_score": f"{engine()}, {asked()}, {rules()}, {matching()} SELECT query_id, item, score FROM gain",
    "bias_user": recs(asked(itm="u", usr_bias="2.5")),
    "bias_item": recs(asked(itm="u", itm_bias="3.0")),
    "bias_item_set": recs(
        asked(
            cart="[CAST(CAST(u AS BIGINT) + 1 AS VARCHAR), CAST(CAST(u AS BIGINT) + 2 AS VARCHAR)]",
            cart_bias="1.5",
        )
    ),
    "negative_bias_filter": recs(
        asked(usr_bias="-1.0", events_used="['purchase','view']"),
        rules(("brand", f"[{_BRAND}]", 2.0)),
        extra=_REQUIRED,
    ),
    "field_boost": recs(r=rules(("tags", f"[{_BRAND}, 'ECONOMY']", 1.5), ("size", f"[{_SIZE}]", 4.0))),
    "field_filter": recs(
        r=rules(("brand", f"[{_BRAND}, 'Brand#3']", -1.0), ("tags", "['ECONOMY', 'PROMO']", -1.0))
    ),
    "field_exclude": recs(r=rules(("brand", f"[{_BRAND}]", 0.0), ("tags", "['STANDARD']", 0.0))),
    "rule_defaults": recs(
        r=rules(("size", "['7']", 3.0), ("brand", f"[{_BRAND}]", 2.0), ("big", "['true']", 0.0))
    ),
    "date_rules": recs(extra=_DATES),
    "date_moments": recs(asked(n_wanted="30"), extra=_MOMENTS),
    "narrow_rules": recs(
        r=f"""r AS (SELECT query_id, 0 AS nr, 'size' AS field, [{_SIZE}] AS vals, -1.0 AS bias FROM q WHERE {_N} % 2 = 0
            UNION ALL SELECT query_id, 1, 'brand', [{_BRAND}], 0.0 FROM q WHERE {_N} % 2 = 0)""",
        extra=_NARROW,
    ),
    "history_recs": recs(),
    "backfill": recs(asked(n_wanted="400")),
    "blacklist": recs(
        asked(itm="u", own_too="true", banned="['11', CAST(CAST(u AS BIGINT) + 5 AS VARCHAR)]"),
        blacklist="'view','click'",
    ),
    "exclude_items": f"""{engine()}, {asked(itm='u', cart='[CAST(CAST(u AS BIGINT) + 1 AS VARCHAR)]')},
        {rules()}, {matching()} SELECT query_id, item FROM excl""",
    "top_n": recs(asked(n_wanted="4")),
    "paginate": recs(asked(n_wanted="15", n_skip="15")),
    "with_ranks": recs(
        columns="""CASE WHEN CAST(q.query_id AS BIGINT) % 2 = 0 THEN i.popRank END AS popRank,
          CASE WHEN CAST(q.query_id AS BIGINT) % 2 = 0 THEN i.trendRank END AS trendRank,
          CASE WHEN CAST(q.query_id AS BIGINT) % 2 = 0 THEN i.userRank END AS userRank,""",
        pick=PICK.replace("item, score", "item, score, popRank, trendRank, userRank"),
    ),
    "recs_model_modes": " UNION ALL ".join(
        [
            _mode("all", recs()),
            _mode("collabFiltering", recs(base=engine(rank_columns=[]), positive=True)),
            _mode("backfill", recs(base=engine(with_correlators=False))),
        ]
    ),
}
