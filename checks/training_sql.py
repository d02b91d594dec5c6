"""SQL counterparts of the training-side queries."""

from __future__ import annotations

from checks.sql_parts import (
    CATALOG,
    LOG,
    ORDER_LOG,
    PROPERTY_LOG,
    USAGE,
    USER_RANK,
    best,
    ctes,
    cut,
    pairs,
    popular,
    stamp,
    stretches,
    uniform,
)

NAMES = ["purchase", "view", "click"]
FLAGS = ["N", "R", "A"]
NOW = "2024-01-31"
LONG_AGO = "2014-02-02"  # 3650 days before NOW

#: Correlators of the engine most checks use.
USAGE_CORR = ctes(LOG, cut(NAMES), pairs("purchase"), best(50))

_AT = f"{stamp('t')} AS moment"
_EVENT = f"e AS event, u AS entity_id, i AS target_entity_id, {_AT}, seq"

#: Item documents: field lists of the correlators over those of the catalog.
DOCS = """
docs AS (
  SELECT item, field, vals FROM cat
  UNION ALL
  SELECT item, event, list(CAST(correlator AS VARCHAR) ORDER BY rnk) FROM corr GROUP BY item, event)"""


def props_text(source: str, columns: str = "") -> str:
    """item, props text from (item, field, vals)."""
    entry = "field || '=' || array_to_string(vals, '|')"
    return f"SELECT item, string_agg({entry}, ';' ORDER BY {entry}) AS props FROM {source} GROUP BY item"


def rank_ctes() -> str:
    w30 = ["2024-01-01", "2024-01-16", "2024-01-31"]
    w30thirds = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-01-31"]
    return ",".join(
        [
            popular("pop", "'purchase'", LONG_AGO, NOW),
            stretches("trend", "'view'", w30),
            stretches("hot", "'click','view'", w30thirds),
            USER_RANK,
            uniform("rnd", 9, "2024-01-01", NOW),
            """
ranks AS (
  SELECT item, max(p) AS popRank, max(t) AS trendRank, max(h) AS hotRank, max(us) AS userRank,
         max(rn) AS uniqueRank
  FROM (SELECT item, rank AS p, NULL AS t, NULL AS h, NULL AS us, NULL AS rn FROM pop
        UNION ALL SELECT item, NULL, rank, NULL, NULL, NULL FROM trend
        UNION ALL SELECT item, NULL, NULL, rank, NULL, NULL FROM hot
        UNION ALL SELECT item, NULL, NULL, NULL, rank, NULL FROM usr
        UNION ALL SELECT item, NULL, NULL, NULL, NULL, rank FROM rnd) GROUP BY item)""",
        ]
    )


def _merged() -> str:
    return """
layered AS (
  SELECT item, field, vals, 1 AS place FROM cat
  UNION ALL SELECT item, field, [val], 2 FROM folded
  UNION ALL SELECT item, 'brand', ['new'], 3 FROM day WHERE p_brand > 'Brand#2'),
merged AS (
  SELECT item, field, vals FROM (
    SELECT *, row_number() OVER (PARTITION BY item, field ORDER BY place DESC) AS r FROM layered)
  WHERE r = 1)"""


SQL: dict[str, str] = {
    "scan_events": f"{ctes(LOG)} SELECT {_EVENT} FROM log WHERE e IN ({USAGE})",
    "scan_events_window": f"""{ctes(LOG)} SELECT {_EVENT} FROM log
        WHERE e IN ('purchase', 'view') AND t >= TIMESTAMP '2024-01-10 06:00:00'
        AND t < TIMESTAMP '2024-01-20 18:30:00'""",
    "parse_delimited_events": f"""{ctes(LOG, CATALOG)}
        SELECT e AS event, 'user' AS entity_type, u AS entity_id, i AS target, '-' AS field,
               '-' AS value_list, seq FROM log
        UNION ALL
        SELECT '$set', 'item', item, '-', 'tags', p_brand || '|' || p_type, -CAST(item AS BIGINT) - 1
        FROM day""",
    "parse_ratings": f"""{ctes(ORDER_LOG)},
        line AS (SELECT seq, CAST(u AS VARCHAR) AS u, CAST(i AS VARCHAR) AS i,
                 CAST(u AS VARCHAR) || '::' || CAST(i AS VARCHAR) || '::' || CAST(seq % 5 + 1 AS VARCHAR) AS t
                 FROM log),
        drawn AS (SELECT *,
                 CAST('0x' || substr(md5('3|' || t || '|' || CAST(seq AS VARCHAR)), 1, 8) AS BIGINT) < 2147483648 AS buys,
                 CAST('0x' || substr(md5('4|' || t || '|' || CAST(seq AS VARCHAR)), 1, 8) AS BIGINT) < 2147483648 AS first
                 FROM line)
        SELECT CASE WHEN buys THEN 'buy' ELSE 'rate' END AS event, 'user' AS entity_type,
               u AS entity_id, i AS target, '-' AS category, seq FROM drawn
        UNION ALL
        SELECT '$set', 'item', i, '-', CASE WHEN first THEN 'garden|tools' ELSE 'garden|seeds|spring' END, seq
        FROM drawn""",
    "recent_user_history": f"""{ctes(LOG)}
        SELECT u AS user, e AS event, i AS item, {_AT} FROM log WHERE e IN ({USAGE})""",
    "lookup_item_model": f"""{USAGE_CORR}, {CATALOG}, {DOCS},
        known AS (SELECT item FROM cat UNION SELECT i FROM log WHERE e = 'purchase'),
        asked AS (SELECT item AS query_id, item FROM known
                  UNION ALL SELECT 'no-' || item, 'no-' || item FROM known)
        SELECT query_id,
          coalesce(max(array_to_string(vals, '|')) FILTER (field = 'purchase'), '') AS purchase,
          coalesce(max(array_to_string(vals, '|')) FILTER (field = 'view'), '') AS "view",
          coalesce(max(array_to_string(vals, '|')) FILTER (field = 'click'), '') AS click,
          coalesce(max(array_to_string(vals, '|')) FILTER (field = 'brand'), '') AS brand
        FROM asked LEFT JOIN docs USING (item) GROUP BY query_id""",
    "load_model": f"{USAGE_CORR}, {CATALOG}, {DOCS} {props_text('docs')}",
    "publish_model": f"{ctes(CATALOG)} {props_text('cat')}",
    "sink_parallelism": f"{USAGE_CORR} SELECT event, count(*) AS n, true AS few_files FROM corr GROUP BY event",
    "moving_event_window": f"""{ctes(LOG)} SELECT {_EVENT} FROM log
        WHERE t >= (SELECT max(t) FROM log) - INTERVAL 10 DAY""",
    "cleaned_properties": f"{ctes(PROPERTY_LOG)} SELECT item, field, val AS value FROM folded",
    "cleaned_usage": f"""{ctes(LOG)}
        SELECT u AS user, e AS event, i AS item, {_AT} FROM (
          SELECT u, e, i, max(t) AS t FROM log
          WHERE e IN ({USAGE}) AND t >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY GROUP BY u, e, i)""",
    "first_event_type_empty": f"{USAGE_CORR} SELECT item, event, correlator, llr, rnk FROM corr",
    "dedup_events": f"""{ctes(LOG)} SELECT e AS event, u AS entity_id, i AS target_entity_id, {_AT} FROM (
          SELECT *, row_number() OVER (PARTITION BY e, u, i ORDER BY t DESC, seq DESC) AS r FROM log)
        WHERE r = 1""",
    "compact_properties": f"""{ctes(PROPERTY_LOG)},
        one AS (SELECT a.item, f.field, [f.val] AS vals, a.s FROM alive a LEFT JOIN folded f USING (item))
        SELECT '$set' AS event, item AS entity_id,
               coalesce(string_agg(field || '=' || vals[1], ';' ORDER BY field), '') AS props,
               {stamp('max(s[1])')} AS moment
        FROM one GROUP BY item""",
    "split_by_event": f"""{ctes(LOG)} SELECT e AS event, row_number() OVER (ORDER BY p) AS position, n FROM (
          SELECT e, count(*) AS n, CASE e WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS p
          FROM log WHERE e IN ('wish', 'view', 'purchase', 'click') GROUP BY e)""",
    "aggregate_properties": f"{ctes(PROPERTY_LOG)} SELECT item, field, val AS value FROM folded",
    "validate_events": f"""{ctes(LOG)} SELECT event, verdict, count(*) AS n FROM (
          SELECT e AS event, CASE WHEN e NOT IN ({USAGE}) THEN 'unexpected event'
            WHEN extract(hour FROM t) = 3 THEN 'empty user'
            WHEN extract(hour FROM t) = 4 THEN 'empty item' ELSE 'accepted' END AS verdict FROM log)
        GROUP BY event, verdict""",
    "min_events_filter": f"""{ctes(LOG)} SELECT DISTINCT u AS user, e AS event, i AS item FROM log
        WHERE e = 'purchase' AND u IN (
          SELECT u FROM log WHERE e = 'purchase' GROUP BY u HAVING count(*) >= 13)""",
    "restrict_secondary_users": f"""{ctes(LOG)} SELECT u AS user, e AS event, i AS item, count(*) AS n
        FROM log WHERE e <> 'purchase' AND u IN (
          SELECT u FROM log WHERE e = 'purchase' GROUP BY u HAVING count(*) >= 16)
        GROUP BY u, e, i""",
    "binarize": f"{ctes(ORDER_LOG)} SELECT DISTINCT u AS user, e AS event, i AS item FROM log",
    "downsample_interactions": f"""{ctes(ORDER_LOG, cut(FLAGS, cap=8, min_events=0, seed=7).replace(
        "bag WHERE u IN (SELECT u FROM act)", "bag"))}
        SELECT ci.u AS user, ci.e AS event, ci.i AS item, m AS n_users FROM ci
        JOIN margin ON margin.e = ci.e AND margin.i = ci.i""",
    "project_item_fields": f"""{ctes(CATALOG)} SELECT item,
        '{{' || string_agg('"' || field || '":["' || array_to_string(vals, '","') || '"]', ',' ORDER BY field)
        || '}}' AS fields FROM cat GROUP BY item""",
    "coerce_property_types": f"""{ctes(CATALOG)},
        long AS (SELECT item, field, unnest(vals) AS v FROM cat),
        kinds AS (SELECT *, CASE
          WHEN field IN ('date', 'available', 'expires') THEN 'date'
          WHEN field = 'userRank' THEN 'double'
          WHEN v IN ('true', 'false') THEN 'bool'
          WHEN try_cast(v AS BIGINT) IS NOT NULL AND v NOT LIKE '%.%' THEN 'int'
          WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'double' ELSE 'string' END AS kind FROM long)
        SELECT item, field, kind,
          CASE WHEN kind = 'date' THEN {stamp('CAST(v AS TIMESTAMP)')} END AS date_value,
          CASE WHEN kind = 'double' THEN CAST(v AS DOUBLE) END AS double_value,
          CASE WHEN kind = 'int' THEN CAST(v AS BIGINT) END AS int_value,
          CASE WHEN kind = 'bool' THEN CAST(v AS BOOLEAN) END AS bool_value,
          CASE WHEN kind = 'string' THEN v END AS string_value
        FROM kinds""",
    "field_inventory": f"""{ctes(PROPERTY_LOG, CATALOG)} SELECT field FROM cat UNION SELECT field FROM folded""",
    "cooccurrence_counts": f"""{ctes(ORDER_LOG, cut(FLAGS), pairs('N'))}
        SELECT item, correlator, k AS n_both FROM pairc WHERE event = 'N'""",
    "cross_occurrence_counts": f"""{ctes(ORDER_LOG, cut(FLAGS), pairs('N'))}
        SELECT item, event, correlator, k AS n_both FROM pairc WHERE event <> 'N'""",
    "llr_score": f"""{ctes(LOG, cut(NAMES, min_events=9), pairs('purchase'))}
        SELECT item, event, correlator, n_both, n_item, n_correlator, llr FROM scored""",
    "llr_threshold": f"""{ctes(LOG, cut(NAMES, min_events=9), pairs('purchase'))}
        SELECT item, event, correlator, llr FROM scored WHERE llr > 1e-6
        AND llr >= CASE event WHEN 'purchase' THEN 0.5 WHEN 'view' THEN 2.0 ELSE 0 END""",
    "top_correlators": f"""{ctes(ORDER_LOG, cut(FLAGS), pairs('N'), best(10))}
        SELECT item, event, correlator, llr, rnk FROM corr""",
    "incremental_correlators": f"{USAGE_CORR} SELECT item, event, correlator, llr, rnk FROM corr",
    "stretch_ranks": f"""{ctes(
        LOG,
        popular("pop", "'view'", "2024-01-11", NOW),
        stretches("trend", "'view'", ["2024-01-11", "2024-01-21", "2024-01-31"]),
        stretches("hot", "'view'", ["2024-01-11", "2024-01-17 16:00:00", "2024-01-24 08:00:00", "2024-01-31"]))}
        SELECT item, pop.rank AS popRank, trend.rank AS trendRank, hot.rank AS hotRank
        FROM pop FULL JOIN trend USING (item) FULL JOIN hot USING (item)""",
    "per_indicator_params": f"""{ctes(
        LOG, cut(NAMES), pairs('purchase'),
        best({'purchase': 4, 'view': 7, 'click': 3}, {'view': 1.0}))}
        SELECT item, event, correlator, llr, rnk FROM corr""",
    "correlator_lists": f"""{ctes(LOG, cut(NAMES, min_events=5), pairs('purchase'), best(50))}
        SELECT item, event, string_agg(correlator, '|' ORDER BY rnk) AS correlators
        FROM corr GROUP BY item, event""",
    "rank_popular": f"""{ctes(LOG, popular('pop', "'purchase','view'", '2024-01-02', '2024-01-30 12:00:00'))}
        SELECT item, rank FROM pop""",
    "rank_trending": f"""{ctes(LOG, stretches('trend', USAGE, ['2024-01-02', '2024-01-16 06:00:00',
        '2024-01-30 12:00:00']))} SELECT item, rank FROM trend""",
    "rank_hot": f"""{ctes(LOG, stretches('hot', USAGE, ['2024-01-02', '2024-01-11 12:00:00',
        '2024-01-21', '2024-01-30 12:00:00']))} SELECT item, rank FROM hot""",
    "rank_random": f"{ctes(LOG, uniform('rnd', 9, '2024-01-02', '2024-01-30 12:00:00'))} SELECT item, rank FROM rnd",
    "rank_user_defined": f"{ctes(USER_RANK)} SELECT item, rank FROM usr",
    "rank_table": f"{ctes(LOG, rank_ctes())} SELECT * FROM ranks",
    "velocity_join": f"""{ctes(ORDER_LOG, stretches('trend', "'N','R','A'",
        ['1994-01-01', '1998-12-31 12:00:00', '2004-01-01']))} SELECT item, rank FROM trend""",
    "join_props_ranks": f"""{ctes(PROPERTY_LOG, rank_ctes())},
        p AS (SELECT a.item, coalesce(string_agg(field || '=' || val, ';' ORDER BY field), '') AS props
              FROM alive a LEFT JOIN folded f USING (item) GROUP BY a.item)
        SELECT item, coalesce(props, '') AS props, popRank, trendRank
        FROM p FULL JOIN ranks USING (item)""",
    "merge_model": f"{ctes(PROPERTY_LOG, CATALOG, _merged())} {props_text('merged')}",
    "user_semi_join": f"""{ctes(ORDER_LOG)} SELECT u AS user, e AS event, count(*) AS n FROM log
        WHERE e <> 'N' AND u IN (SELECT u FROM log WHERE e = 'N' GROUP BY u HAVING count(*) >= 18)
        GROUP BY u, e""",
    "build_postings": f"""{USAGE_CORR}, {CATALOG}, {DOCS},
        post AS (SELECT DISTINCT item, field, unnest(vals) AS term FROM docs),
        per AS (SELECT field, count(DISTINCT item) AS n FROM post GROUP BY field)
        SELECT field, term, count(*) AS n_items, min(item) AS first_item, count(*) AS df,
               round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
        FROM post JOIN per USING (field) GROUP BY field, term""",
    "refresh_ranks": f"""{USAGE_CORR.replace(LOG, PROPERTY_LOG)}, {CATALOG}, {DOCS},
        layered AS (SELECT item, field, vals, 1 AS place FROM cat
                    UNION ALL SELECT item, field, [val], 2 FROM folded),
        merged AS (SELECT item, field, vals FROM (
          SELECT *, row_number() OVER (PARTITION BY item, field ORDER BY place DESC) AS r FROM layered)
          WHERE r = 1),
        pt AS ({props_text('merged')}),
        {popular('pop', "'view'", '2024-01-24', NOW)},
        allitems AS (SELECT item FROM pt UNION SELECT item FROM pop UNION SELECT item FROM corr
                     UNION SELECT item FROM alive)
        SELECT a.item, coalesce(pt.props, '') AS props, pop.rank AS popRank,
          row_number() OVER (ORDER BY pop.rank DESC NULLS LAST, a.item) AS pos,
          coalesce((SELECT array_to_string(d.vals, '|') FROM docs d WHERE d.item = a.item AND d.field = 'view'), '') AS "view"
        FROM allitems a LEFT JOIN pt ON pt.item = a.item LEFT JOIN pop ON pop.item = a.item""",
}
