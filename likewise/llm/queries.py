"""The registered queries: every operator over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from likewise.llm import bpe, conversations, exact, licenses, lines, minhash, mixing, periods, pii, rollup, suffixes, toxicity, vectors
from likewise.llm.sieve import sieve
from likewise.sources.staging import stage, staged_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


#: Domains of the labels table and the share of the tokens that each should have.
WEIGHTS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}


def domains(labels: DataFrame) -> DataFrame:
    domain = (
        F.when(F.col("toxic") == 1, "toxic")
        .when(F.col("quality") == 1, "good")
        .when(F.col("quality") == 0, "poor")
    )
    return labels.select("doc_id", domain.alias("domain"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(table(spark, sf_dir, "documents"), labels, WEIGHTS)
    posteriors = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(WEIGHTS)]
    return mixed.select("doc_id", "tokens", *posteriors, "rate")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.id_text(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.to_json("evidence").alias("evidence"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{k}")
        for i, k in enumerate(pii.KINDS[:4])
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.joined("base"), 256).alias("base_sha256"),
        pii.joined("spans").alias("spans"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches of arrivals, one of revisions and one of deletions.

    Documents of poor quality are revised to their text with white space folded, toxic ones are
    deleted; the batch of revisions is sent a second time.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def counted(rows: DataFrame, seq: int) -> DataFrame:
        rows = rows.select("doc_id", "source", "lang", "text", rollup.word_count(F.col("text")).alias("words"))
        rows = rollup.bpe_count(rows, path, public_tokenizers.PATTERN, "byte_bpe_50k")
        return rows.unpivot(
            ["doc_id", "source", "lang"], ["words", "byte_bpe_50k"], "version", "n_tokens"
        ).withColumn("seq", F.lit(seq))

    inserts = stage(counted(docs, 0), "rollup-inserts")
    poor = labels.where("quality = 0").select("doc_id").distinct()
    folded = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    # Texts stay where they are: those that may be revised are counted, the counts are joined.
    revised = sieve(docs, [F.col("doc_id")], poor, [F.col("doc_id")]).withColumn("text", folded)
    revisions = stage(counted(revised, 1).join(poor, "doc_id", "left_semi"), "rollup-revisions")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    deletes = inserts.join(toxic, "doc_id", "left_semi").withColumn(
        "n_tokens", F.lit(None).cast("bigint")
    )
    totals = rollup.Rollup(spark, staged_path(spark, "rollup"))
    for part in range(4):
        totals.apply(part, inserts.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == part))
    totals.apply(4, revisions)
    totals.apply(5, deletes)
    totals.apply(4, revisions)
    return totals.totals()


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.planted(table(spark, sf_dir, "documents"))
    return periods.run_report(periods.periodic_runs(docs))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return suffixes.score(table(spark, sf_dir, "documents"), apart)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair_report(turns, conversations.damaged(turns))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1,
    "op2_soft_mixing": op2,
    "op3_license_scan": op3,
    "op4_minhash_near_dedup": op4,
    "op5_byte_bpe": op5,
    "op6_inverted_multi_index": op6,
    "op7_toxicity_knn": op7,
    "op8_pii_boosting": op8,
    "op9_line_dedup": op9,
    "op10_token_rollup": op10,
    "op11_periodic_runs": op11,
    "op12_suffix_tree": op12,
    "op13_conversation_repair": op13,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_GAPS = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _license_sql() -> str:
    templates = ", ".join(
        f"('{label}', {sorted(set(t.split()))}, {licenses._needed(len(set(t.split())), licenses.THRESHOLD)})"
        for label, t in licenses.TEMPLATES.items()
    )
    starts = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: "
        + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
        + ")) AS place FROM docs"
        for p, label in licenses.PHRASES.items()
    )
    split = "list_filter(regexp_split_to_array({}, " + _GAPS + "), lambda x: x <> '')"
    step = licenses.WINDOW // 2
    return f"""
        WITH docs AS (
            SELECT doc_id, {split.format(f"translate(coalesce(text, ''), {_LOWER})")} AS w FROM documents
        ), places AS ({starts}
        ), base AS (
            SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi,
                   list_sort(list_distinct(list(label))) AS names FROM places GROUP BY doc_id
        ), blocks AS (
            SELECT doc_id, w[o + 1 : o + {licenses.WINDOW}] AS b
            FROM (SELECT doc_id, w, unnest(range(0,
                CAST(greatest(0, ceil((len(w) - {licenses.WINDOW}) / {step}.0)) AS BIGINT) + 1)) * {step} AS o
                FROM docs)
        ), templates(label, own, needed) AS (VALUES {templates}
        ), found AS (
            SELECT doc_id, label, max(len(list_intersect(own, b)) / len(own)) AS share
            FROM blocks, templates WHERE len(list_intersect(own, b)) >= needed GROUP BY doc_id, label
        ), per_doc AS (
            SELECT doc_id, list(label) AS names, max(share) AS share FROM found GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(b.n, 0) AS n_base,
               b.lo AS first_word, b.hi AS last_word,
               coalesce(array_to_string(b.names, ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(
                   list_concat(coalesce(b.names, []), coalesce(p.names, [])))), ','), '') AS labels,
               CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(p.share, 0.0) END AS score
        FROM docs d LEFT JOIN base b USING (doc_id) LEFT JOIN per_doc p USING (doc_id)"""


SQL: dict[str, str] = {
    "op3_license_scan": _license_sql(),
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ), keyed AS (
            SELECT *, translate(
                trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ), held AS (
            SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
            GROUP BY k HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
            SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone
            FROM keyed LEFT JOIN held USING (k)
        )
        SELECT doc_id, count(*) AS n_lines,
               CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
                   AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
