"""Shared pieces of the SQL counterparts (DuckDB)."""

from __future__ import annotations

USAGE = "'purchase','view','click'"

#: The usage log: seq, t, u, e, i, value.
LOG = """
log AS (
  SELECT event_id AS seq, ts AS t, CAST(user_id AS VARCHAR) AS u, event_type AS e,
         regexp_extract(props, '([0-9]+)', 1) AS i, value
  FROM events)"""

#: The order log: seq, t, u, e, i.
ORDER_LOG = """
log AS (
  SELECT o_orderkey * 10 + l_linenumber AS seq, o_orderdate AS t, o_custkey AS u,
         l_returnflag AS e, l_partkey AS i
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""

#: The property log: seq, t, item, op, field, val.
PROPERTY_LOG = (
    LOG
    + """,
plog AS (
  SELECT seq, t, i AS item,
         CASE WHEN e = 'signup' THEN '$set' WHEN value > 150 THEN '$delete' ELSE '$unset' END AS op,
         'h' || CAST(extract(hour FROM t) // 6 AS VARCHAR) AS field, u AS val
  FROM log WHERE e IN ('signup', 'error')),
gone AS (
  SELECT item, max(ROW(t, seq)) AS d FROM plog WHERE op = '$delete' GROUP BY item),
lastw AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY item, field ORDER BY t DESC, seq DESC) AS r
    FROM plog WHERE op <> '$delete') WHERE r = 1),
folded AS (
  SELECT l.item, l.field, l.val FROM lastw l LEFT JOIN gone g ON l.item = g.item
  WHERE l.op = '$set' AND (g.d IS NULL OR ROW(l.t, l.seq) > g.d)),
alive AS (
  SELECT p.item, max(ROW(p.t, p.seq)) AS s FROM plog p LEFT JOIN gone g ON p.item = g.item
  WHERE p.op = '$set' AND (g.d IS NULL OR ROW(p.t, p.seq) > g.d) GROUP BY p.item)"""
)

#: The catalog, one row per item, field, value list.
CATALOG = """
day AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item, p_brand, p_type, p_size,
         CAST(p_retailprice AS VARCHAR) AS price,
         CAST(DATE '2023-12-15' + p_size AS VARCHAR) || 'T00:00:00' AS opens,
         CAST(DATE '2023-12-15' + p_size + 40 AS VARCHAR) || 'T00:00:00' AS closes
  FROM part),
cat AS (
  SELECT item, 'brand' AS field, [p_brand] AS vals FROM day
  UNION ALL SELECT item, 'tags', [p_brand, p_type] FROM day
  UNION ALL SELECT item, 'size', [CAST(p_size AS VARCHAR)] FROM day
  UNION ALL SELECT item, 'price', [price] FROM day
  UNION ALL SELECT item, 'userRank', [price] FROM day
  UNION ALL SELECT item, 'big', [CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END] FROM day
  UNION ALL SELECT item, 'date', [opens] FROM day
  UNION ALL SELECT item, 'available', [opens] FROM day
  UNION ALL SELECT item, 'expires', [closes] FROM day)"""


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def fixed6(value: str) -> str:
    return f"floor(({value}) * 1e6 + 0.5) / 1e6"


def _xlx(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN CAST(({x}) AS DOUBLE) * ln(CAST(({x}) AS DOUBLE)) ELSE 0.0 END"


def _entropy(*counts: str) -> str:
    parts = " - ".join(f"({_xlx(c)})" for c in counts)
    return f"(({_xlx(' + '.join(counts))}) - {parts})"


def llr(k: str, a: str, b: str, n: str) -> str:
    """Row entropy plus column entropy minus matrix entropy, doubled, not below 0."""
    k11, k12, k21, k22 = k, f"({a} - {k})", f"({b} - {k})", f"({n} - {a} - {b} + {k})"
    rows = _entropy(f"{a}", f"({n} - {a})")
    cols = _entropy(f"{b}", f"({n} - {b})")
    return f"greatest(0.0, 2.0 * ({rows} + {cols} - {_entropy(k11, k12, k21, k22)}))"


def cut(names: list[str], cap: int | dict[str, int] | None = None, min_events: int = 1, seed: int = 0) -> str:
    """CTEs bag, act, ci, margin, n from ``log``: prepared interactions and margins."""
    listed = ",".join(f"'{x}'" for x in names)
    if cap is None:
        return f"""
bag AS (SELECT u, e, i, count(*) AS c FROM log WHERE e IN ({listed}) GROUP BY u, e, i),
act AS (SELECT u FROM bag WHERE e = '{names[0]}' GROUP BY u HAVING sum(c) >= {min_events}),
ci AS (SELECT u, e, i FROM bag WHERE u IN (SELECT u FROM act)),
margin AS (SELECT e, i, count(*) AS m FROM ci GROUP BY e, i),
n AS (SELECT count(*) AS n FROM act)"""
    caps = cap if isinstance(cap, dict) else {x: cap for x in names}
    limit = "CASE e " + " ".join(f"WHEN '{x}' THEN {caps[x]}" for x in names) + " END"
    key = f"md5('{seed}|' || CAST(u AS VARCHAR) || '|' || CAST(i AS VARCHAR))"
    return f"""
bag AS (SELECT u, e, i, count(*) AS c FROM log WHERE e IN ({listed}) GROUP BY u, e, i),
act AS (SELECT u FROM bag WHERE e = '{names[0]}' GROUP BY u HAVING sum(c) >= {min_events}),
cu AS (
  SELECT u, e, i FROM (
    SELECT *, row_number() OVER (PARTITION BY u, e ORDER BY {key}, i) AS r
    FROM bag WHERE u IN (SELECT u FROM act)) WHERE r <= {limit}),
ci AS (
  SELECT u, e, i FROM (
    SELECT *, row_number() OVER (PARTITION BY e, i ORDER BY {key}, u) AS r FROM cu)
  WHERE r <= {limit}),
margin AS (SELECT e, i, count(*) AS m FROM ci GROUP BY e, i),
n AS (SELECT count(*) AS n FROM act)"""


def pairs(primary: str) -> str:
    """CTEs pairc and scored from ``ci``, ``margin`` and ``n``."""
    score = llr("p.k", "ma.m", "mb.m", "n.n")
    return f"""
pairc AS (
  SELECT a.i AS item, b.e AS event, b.i AS correlator, count(*) AS k
  FROM ci a JOIN ci b ON a.u = b.u
  WHERE a.e = '{primary}' AND NOT (b.e = '{primary}' AND b.i = a.i)
  GROUP BY a.i, b.e, b.i),
scored AS (
  SELECT p.item, p.event, p.correlator, p.k AS n_both, ma.m AS n_item, mb.m AS n_correlator,
         {fixed6(score)} AS llr
  FROM pairc p JOIN margin ma ON ma.e = '{primary}' AND ma.i = p.item
  JOIN margin mb ON mb.e = p.event AND mb.i = p.correlator CROSS JOIN n)"""


def best(k: int | dict[str, int] = 50, min_llr: dict[str, float] | None = None) -> str:
    """CTE corr from ``scored``: item, event, correlator, llr, rnk."""
    limit = str(k)
    if isinstance(k, dict):
        limit = "CASE event " + " ".join(f"WHEN '{x}' THEN {v}" for x, v in k.items()) + " END"
    least = "0"
    if min_llr:
        least = "CASE event " + " ".join(f"WHEN '{x}' THEN {v}" for x, v in min_llr.items()) + " ELSE 0 END"
    return f"""
corr AS (
  SELECT item, event, correlator, llr, rnk FROM (
    SELECT *, row_number() OVER (PARTITION BY item, event ORDER BY llr DESC, correlator) AS rnk
    FROM scored WHERE llr > 1e-6 AND llr >= {least}) WHERE rnk <= {limit})"""


def ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def popular(name: str, names: str | None, start: str, end: str) -> str:
    chosen = f"e IN ({names}) AND " if names else ""
    return f"""
{name} AS (
  SELECT i AS item, CAST(count(*) AS DOUBLE) AS rank FROM log
  WHERE {chosen}t >= TIMESTAMP '{start}' AND t < TIMESTAMP '{end}' GROUP BY i)"""


def stretches(name: str, names: str, bounds: list[str]) -> str:
    """Trend (two stretches) or change of trend (three), present in every stretch."""
    counts, joins, value = [], "", ""
    for j, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        counts.append(popular(f"{name}{j}", names, lo, hi))
        joins += f"{name}0" if j == 0 else f" JOIN {name}{j} USING (item)"
    if len(bounds) == 3:
        value = f"{name}1.rank - {name}0.rank"
    else:
        value = f"({name}2.rank - {name}1.rank) - ({name}1.rank - {name}0.rank)"
    return ",".join(counts) + f", {name} AS (SELECT item, {value} AS rank FROM {joins})"


def uniform(name: str, seed: int, start: str, end: str) -> str:
    return f"""
{name} AS (
  SELECT item, CAST(CAST('0x' || substr(md5('{seed}|' || item), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS rank
  FROM (SELECT i AS item FROM log WHERE t >= TIMESTAMP '{start}' AND t < TIMESTAMP '{end}'
        UNION SELECT CAST(p_partkey AS VARCHAR) FROM part))"""


USER_RANK = """
usr AS (SELECT CAST(p_partkey AS VARCHAR) AS item, p_retailprice AS rank FROM part)"""
