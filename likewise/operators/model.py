"""The item model: one wide row per item, and its inverted form for matching."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from likewise.functions.scores import inverse_frequency
from likewise.operators.groups import number_rows
from likewise.operators.similarity import correlator_lists
from likewise.sources.staging import hash_slices, stage, stage_parts

PROPS = "map<string,array<string>>"

#: Items per block of a term's postings.
BLOCK = 1024

#: A term with more than one in so many of all entries is hot.
HOT = 1024

#: Entries on their way into postings at a time, about.
SLICE = 1 << 27


def join_props_ranks(props: DataFrame, ranks: DataFrame) -> DataFrame:
    """Full outer join on the item; a ranking overrides the property of its name."""
    names = [c for c in ranks.columns if c != "item"]
    own = F.coalesce("props", F.map_from_arrays(F.array(), F.array()).cast(PROPS))

    def current(name: Column, values: Column) -> Column:
        for n in names:
            ranked = (name == n) & F.col(n).isNotNull()
            values = F.when(ranked, F.array(F.col(n).cast("string"))).otherwise(values)
        return values

    joined = props.join(ranks, "item", "full_outer")
    return joined.select("item", F.transform_values(own, current).alias("props"), *names)


def merge_model(relations: Sequence[DataFrame]) -> DataFrame:
    """(item, props) of several such relations; for a name in two, the later one wins.

    One shuffle for any number of relations: an item has at most one row in each.
    """
    tagged = [
        df.select("item", F.lit(i).alias("place"), "props") for i, df in enumerate(relations)
    ]
    names = [f"_part{i}" for i in range(len(tagged))]
    parts = [
        F.any_value(F.when(F.col("place") == i, F.col("props")), ignoreNulls=True).alias(name)
        for i, name in enumerate(names)
    ]

    def overlay(older: Column, newer: Column) -> Column:
        rest = F.map_filter(older, lambda name, _: ~F.map_contains_key(newer, name))
        return F.map_concat(rest, newer)

    empty = F.map_from_arrays(F.array(), F.array()).cast(PROPS)
    filled = [F.coalesce(name, empty) for name in names]
    merged = reduce(DataFrame.unionByName, tagged).groupBy("item").agg(*parts)
    return merged.select("item", reduce(overlay, filled).alias("props"))


def correlator_fields(correlators: DataFrame) -> DataFrame:
    """(item, props): one list of correlator ids per event type, as document fields."""
    lists = correlator_lists(correlators)
    entry = F.struct("event", F.col("correlators").cast("array<string>").alias("ids"))
    return lists.groupBy("item").agg(F.map_from_entries(F.collect_list(entry)).alias("props"))


def item_table(
    props: DataFrame,
    ranks: DataFrame | None,
    correlators: DataFrame | None,
    date_columns: Sequence[str] = (),
) -> DataFrame:
    """Every known item: properties, typed dates, rankings, and its place ``pos``.

    ``pos`` numbers the items by the rankings in order, highest first, missing last,
    ties by id. It is the order of equal scores and of the backfill.
    """
    if ranks is None:
        joined = props
        rank_columns: list[str] = []
    else:
        joined = join_props_ranks(props, ranks)
        rank_columns = [c for c in ranks.columns if c != "item"]
    if correlators is not None:
        ids = correlators.select("item").distinct()
        joined = joined.join(ids, "item", "full_outer").withColumn(
            "props", F.coalesce("props", F.map_from_arrays(F.array(), F.array()).cast(PROPS))
        )
    dated = joined.select(
        "item",
        "props",
        *rank_columns,
        *[F.try_to_timestamp(F.get(F.col("props")[d], F.lit(0))).alias(d) for d in date_columns],
    )
    order = [F.col(c).desc_nulls_last() for c in rank_columns] + [F.col("item").asc()]
    return number_rows(dated, order)


def index_terms(correlators: DataFrame | None, props: DataFrame) -> DataFrame:
    """(field, term, item): the words under which an item is found."""
    described = props.select("item", F.explode("props").alias("field", "values")).select(
        "field", F.explode(F.array_distinct("values")).alias("term"), "item"
    )
    if correlators is None:
        return described
    correlated = correlators.select(
        F.col("event").alias("field"), F.col("correlator").cast("string").alias("term"), "item"
    )
    return correlated.unionByName(described)


def term_weights(entries: DataFrame, correlators: DataFrame | None, props: DataFrame) -> DataFrame:
    """(field, term, df, idf); idf counts the items that have the field at all.

    Document frequencies combine before the shuffle; the number of items per field needs
    no distinct count, as an item's list has exactly one first entry.
    """
    docs = props.select(F.explode("props").alias("field", "values")).where(
        F.size("values") > 0
    ).select("field")
    if correlators is not None:
        docs = docs.unionByName(
            correlators.where(F.col("rnk") == 1).select(F.col("event").alias("field"))
        )
    # one row per field name; staged, so that its true size decides how it is joined
    per_field = stage(docs.groupBy("field").agg(F.count("*").alias("n_docs")), "fields")
    per_term = entries.groupBy("field", "term").agg(F.count("*").alias("df"))
    return per_term.join(per_field, "field").select(
        "field", "term", "df", inverse_frequency(F.col("n_docs"), F.col("df")).alias("idf")
    )


def _weighted(entries: DataFrame, weights: DataFrame, total: int | None = None) -> DataFrame:
    """Entries with the ``df`` and ``idf`` of their terms.

    A term that has more than one in ``HOT`` of all entries, ``total`` if given, is hot; there are at most ``HOT`` of them,
    so they are sent to all tasks, and their entries stay where they are. The others meet
    their weights by a shuffle in which no term is large.
    """
    key = ["field", "term"]
    if total is None:
        total = weights.agg(F.sum("df")).first()[0] or 0
    hot = weights.where(F.col("df") * HOT > total).select(*key, "df", "idf")
    marked = entries.join(F.broadcast(hot), key, "left")
    rest = marked.where("df IS NULL").drop("df", "idf")
    cold = weights.where(F.col("df") * HOT <= total).select(*key, "df", "idf")
    return marked.where("df IS NOT NULL").unionByName(rest.join(cold, key))


def build_postings(entries: DataFrame, weights: DataFrame, items: DataFrame) -> DataFrame:
    """(field, term, idf, block, places): the items of a term, as lists of places.

    Lists are cut into blocks of about ``BLOCK`` by a hash of the place, as many as the
    term's frequency asks for. However common a term is, no list outgrows memory and
    its blocks are built, stored and joined separately; a rare term is one row instead
    of one per item.

    An entry is shuffled up to three times, with more on it each time. Of more than ``SLICE`` entries,
    those of some terms are taken at a time, and their postings written before the next.
    """
    total = weights.agg(F.sum("df")).first()[0] or 0
    slices = hash_slices(-(-total // SLICE), "field", "term")

    def built(own: Column) -> DataFrame:
        blocks = F.ceil(F.col("df") / BLOCK)
        weighted = _weighted(entries.where(own), weights.where(own), total)
        return (
            weighted.join(items.select("item", "pos"), "item")
            .withColumn("block", F.pmod(F.xxhash64("pos"), blocks))
            .groupBy("field", "term", "idf", "block")
            .agg(F.collect_list("pos").alias("places"))
        )

    if len(slices) == 1:
        return built(slices[0])
    return stage_parts(items.sparkSession, [partial(built, own) for own in slices], "term-postings")


@dataclass(frozen=True)
class Model:
    """What queries are answered from.

    correlators (item, event, correlator, llr, rnk), items (item, props, dates...,
    rankings..., pos), postings (field, term, idf, block, places), weights (field, term,
    df, idf), bitmaps (field, term, part, bits) of common property values, without which all are made
    from postings. ``pos`` is an item's place in the ranking of all items, and stands for the
    item wherever queries are answered: eight bytes, ordered like the backfill.
    """

    correlators: DataFrame
    items: DataFrame
    postings: DataFrame
    weights: DataFrame
    bitmaps: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        tables = {
            "correlators": self.correlators,
            "items": self.items,
            "postings": self.postings,
            "weights": self.weights,
        }
        return tables if self.bitmaps is None else {**tables, "bitmaps": self.bitmaps}

    def documents(self, only: DataFrame | None = None) -> DataFrame:
        """One row per item with its properties and correlator lists in one map.

        ``only`` names the items wanted in a column ``item``; others are not assembled.
        """
        found, described = self.correlators, self.items.select("item", "props")
        if only is not None:
            found = found.join(only, "item", "left_semi")
            described = described.join(only, "item", "left_semi")
        return merge_model([correlator_fields(found), described])


def empty_correlators(spark, item_type: DataType) -> DataFrame:
    """No correlators at all, with the schema of some."""
    kind = item_type.simpleString()
    return spark.createDataFrame(
        [], f"item {kind}, event string, correlator {kind}, llr double, rnk int"
    )
