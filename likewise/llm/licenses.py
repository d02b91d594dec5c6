"""License statements: fixed phrases, and an exact set-similarity join with templates.

The join finds every block of text that contains enough of a template's words, in any order.
Words are ordered by how many blocks of the corpus hold them, rarest first. A block that
reaches the threshold shares with the template one of its rarest words (prefix filter), has
enough words (length filter), and after the first word they share enough words are left on
either side (positional filter). What passes is verified in full.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.llm import text as tx
from likewise.sources.staging import stage

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening words of well-known license statements, by label.
TEMPLATES = {
    "agpl": "gnu affero general public license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification",
    "cc-by": "licensed under a creative commons attribution license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "dedicated to the public domain under the creative commons zero waiver",
    "gpl": "licensed under the gnu general public license version 3",
    "lgpl": "gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy",
    "mpl-2.0": "subject to the terms of the mozilla public license",
    "no-warranty": "provided as is without warranty of any kind express or implied",
    "reserved": "copyright all rights reserved",
}

#: Share of a template's distinct words that a block must contain.
THRESHOLD = 0.8

#: A block is a window of so many words of a text, each half over the next; lines end none. Every
#: statement of half as many words lies whole in some block.
WINDOW = 64

# Between words: all ASCII but digits and letters.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def phrase_places(text: Column, phrases: Mapping[str, str]) -> Column:
    """array<struct<start,end,match>> of all phrases; no two of them may overlap.

    Most texts have none: one search says so, and starts only at letters that begin a phrase.
    """
    each = "|".join(f"{_GAP}++".join(p.split()) for p in phrases)
    first = "".join(sorted({p[0] for p in phrases}))
    pattern = f"(?i)(?=[{first}])(?<!{_WORD})(?:{each})(?!{_WORD})"
    found = tx.matches(text, pattern)
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _needed(words: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * words, 9)))


def block_words(docs: DataFrame, vocabulary: list[str], window: int, least: int = 1) -> DataFrame:
    """(doc_id, row, held): of every block the distinct words that some template has.

    Blocks with fewer than ``least`` of them are left out.
    """
    step = window // 2
    known = F.array(*[F.lit(w) for w in vocabulary])
    split = F.array_remove(F.split(tx.ascii_lower(F.col("text")), f"{_GAP}+", -1), "")
    windows = F.sequence(
        F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - window) / step)).cast("int")
    )
    return (
        docs.select("doc_id", "row", split.alias("words"))
        .where(F.size(F.array_intersect("words", known)) >= least)
        .select("doc_id", "row", "words", F.explode(windows).alias("w"))
        .select("doc_id", "row", F.slice("words", F.col("w") * step + 1, window).alias("block"))
        .select("doc_id", "row", F.array_intersect("block", known).alias("held"))
        .where(F.size("held") >= least)
    )


def template_matches(
    blocks: DataFrame, templates: Mapping[str, str], threshold: float
) -> DataFrame:
    """(doc_id, row, label, containment) of every block and template that reach the threshold."""
    spark = blocks.sparkSession
    # The order: at most as many rows as the templates have words.
    counted = blocks.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    often = {r["word"]: r["count"] for r in counted}
    words = sorted({w for t in templates.values() for w in t.split()})
    words.sort(key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(words)}
    index = []
    for label, template in templates.items():
        own = sorted(set(template.split()), key=rank.__getitem__)
        needed = _needed(len(own), threshold)
        index += [
            (w, label, at, len(own), needed, own) for at, w in enumerate(own[: len(own) - needed + 1])
        ]
    schema = "word string, label string, t_at int, t_size int, needed int, own array<string>"
    prefixes = spark.createDataFrame(index, schema)
    ranks = F.create_map(*[F.lit(x) for item in rank.items() for x in item])
    ordered = F.transform(
        F.array_sort(F.transform("held", lambda w: F.struct(ranks[w].alias("rank"), w.alias("word")))),
        lambda x: x["word"],
    )
    least = min(r[4] for r in index)
    entries = (
        blocks.where(F.size("held") >= least)
        .select("doc_id", "row", ordered.alias("held"))
        .select("doc_id", "row", "held", F.posexplode("held").alias("b_at", "word"))
    )
    b_size = F.size("held")
    room = 1 + F.least(F.col("t_size") - F.col("t_at"), b_size - F.col("b_at")) - 1
    shared = F.array_intersect("own", "held")
    candidates = (
        entries.join(F.broadcast(prefixes), "word")  # as many rows as the templates have words
        .where(b_size >= F.col("needed"))
        .where(room >= F.col("needed"))
        # Of the words they share, the first one speaks for the pair.
        .where(F.col("word") == shared[0])
    )
    return candidates.where(F.size(shared) >= F.col("needed")).select(
        "doc_id", "row", "label", (F.size(shared) / F.col("t_size")).alias("containment")
    )


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, found (array<struct<label,containment>> of templates), labels, score.

    Only A-Z are lower-cased; words are runs of digits, letters and anything beyond ASCII.
    A null text is an empty one, without words, places and labels, with score 0. The score is
    1 where a phrase stands, else the largest containment found. Blocks are windows of ``window``
    words, wherever lines end; a very long text has many. Rows that repeat a doc_id are
    scanned each for itself; equal ones give equal results. An empty table gives an empty one.
    Other columns are not looked at.
    """
    text = tx.whole(F.col("text"))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("row"),
    )
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    # no template is reached by fewer words
    least = min(_needed(len(set(t.split())), threshold) for t in templates.values())
    blocks = stage(block_words(texts, vocabulary, window, least), "license-blocks")
    found = (
        template_matches(blocks, templates, threshold)
        .groupBy("doc_id", "row", "label")
        .agg(F.max("containment").alias("containment"))
        .groupBy("doc_id", "row")
        .agg(F.array_sort(F.collect_list(F.struct("label", "containment"))).alias("found"))
        .withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    )
    places = texts.withColumn("places", phrase_places(F.col("text"), phrases))
    named = F.create_map(*[F.lit(x) for item in phrases.items() for x in item])
    before = lambda at: F.regexp_count(
        F.substring(F.col("text"), F.lit(1), at.cast("int")), F.lit(f"{_WORD}+")
    ).cast("bigint")
    first, last = F.element_at("places", 1)["start"], F.element_at("places", -1)["start"]
    some = F.size("places") > 0
    phrase = lambda p: tx.ascii_lower(F.regexp_replace(p["match"], f"{_GAP}+", " "))
    base = places.select(
        "doc_id",
        "row",
        tx.count_runs(F.col("text"), _GAP).alias("n_words"),
        F.size("places").cast("bigint").alias("n_base"),
        F.when(some, before(first)).alias("first_word"),
        F.when(some, before(last)).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("places", lambda p: named[phrase(p)]))).alias("base"),
    )
    none = F.array().cast(found.schema["found"].dataType)
    same = base["doc_id"].eqNullSafe(found["_id"]) & (base["row"] == found["_row"])
    both = F.array_union("base", F.transform("found", lambda x: x["label"]))
    return (
        base.join(found, same, "left")
        .withColumn("found", F.coalesce("found", none))
        .select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join("base", ",").alias("base_labels"),
            "found",
            F.array_join(F.array_sort(both), ",").alias("labels"),
            F.when(F.col("n_base") > 0, F.lit(1.0))
            .otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0)))
            .alias("score"),
        )
    )
