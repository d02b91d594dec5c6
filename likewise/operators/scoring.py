"""Matching query terms against the inverted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likewise.functions.scores import fixed6
from likewise.sources.staging import stage

#: A query with more terms and exclusions than this is long.
LONG = 4096

#: Terms whose matches a task adds up, about.
TERMS = 1 << 15

#: Above the bits of all must-match clauses.
TAKEN = 1 << 62


def term_match(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Equi-join on (field, term): the place of every item under every term of a query.

    Adds ``idf`` and ``pos`` to the terms. The join meets blocks of postings, not single
    ones. A term shared by many queries and found under many items is skewed on both
    sides; adaptive execution splits both, as a shuffle of the matches follows.
    """
    met = terms.join(postings.drop("block"), ["field", "term"])
    return met.select("*", F.explode("places").alias("pos")).drop("places")


def _summed(matches: DataFrame) -> DataFrame:
    key = ["query_id", "sig", "pos"]
    return matches.groupBy(*key).agg(F.sum("gain").alias("score"), F.bit_or("bit").alias("bits"))


def term_sums(terms: DataFrame, postings: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(query_id, sig, pos, score, bits): sum of boost * idf over the matched terms, not rounded.

    The matches of one (query, item) come from different terms and so from different
    tasks: combining them before the shuffle would fill hash tables without shrinking
    anything. Lists of places go to their query's task and become matches there, which moves a number for
    a match instead of a row. A query of more than ``LONG`` terms would make that task a hot one: its
    matches are spread by (query, item), where a group is bounded by the query's number of terms.
    ``bits`` tells which must-match clauses were met.

    Items ``taken`` from a query (query_id, sig, pos) go through the same shuffle as one
    more match each, marked, and drop out when the group is summed: an anti join
    without the join.
    """
    columns = ["query_id", "sig", "gain", "bit", "places"]
    terms = stage(terms, "terms")
    # few, as they are event types: other fields' postings need not be shuffled
    fields = [r["field"] for r in terms.where("field IS NOT NULL").select("field").distinct().collect()]
    postings = postings.where(F.col("field").isin(fields)).drop("block")
    sizes = terms.select("query_id", F.lit(1).alias("n"))
    if taken is not None:
        sizes = sizes.unionByName(taken.select("query_id", F.lit(1).alias("n")))
    sizes = sizes.groupBy("query_id").agg(F.sum("n").alias("n"))
    long = stage(sizes.where(F.col("n") > LONG).select("query_id"), "long-queries")

    def matches(how: str) -> DataFrame:
        """Of the queries that are not long, or of those that are, as lists."""
        met = terms.join(long, "query_id", how).join(postings, ["field", "term"])
        met = met.withColumn("gain", F.col("boost") * F.col("idf")).select(*columns)
        if taken is None:
            return met
        mark = F.lit(TAKEN).cast("bigint").alias("bit")
        own = taken.join(long, "query_id", how)
        return met.unionByName(own.select("query_id", "sig", F.lit(0.0).alias("gain"), mark, F.array("pos").alias("places")))

    spread = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = [*columns[:-1], F.explode("places").alias("pos")]
    tasks = max(spread, -(-terms.count() // TERMS))
    summed = _summed(matches("left_anti").repartition(tasks, "query_id").select(*each))
    if not long.isEmpty():
        rest = matches("left_semi").select(*each)
        summed = summed.unionByName(_summed(rest.repartition("query_id", "sig", "pos")))
    return summed.where(F.col("bits") < TAKEN)


def term_score(terms: DataFrame, postings: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """The same, scores rounded as answers show them."""
    return term_sums(terms, postings, taken).withColumn("score", fixed6(F.col("score")))
