"""Personal data: exact base spans, and spans that boosted trees select among candidates.

Generators of high recall propose spans that may overlap. Gradient-boosted trees score them by
their format and their context; what they learn from is a bounded sample of the distinct
candidates of every kind, those that the strict rules confirm against those they don't. Over all
candidates a threshold is set for every kind so that what passes is as precise as asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likewise.llm import text as tx
from likewise.sources.staging import stage

KINDS = ["email", "ip", "card", "phone", "secret"]

# The strict patterns. Possessive quantifiers and the look-behinds change no
# match; they keep long runs of the same characters from being searched again and again.
_LOCAL = r"[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Patterns of high recall. The last run of a secret's match is its value.
WIDE = {
    "email": r"(?<![^\s<>\"'(\[,;])[^\s@<>\"'(\[,;]++(?:@|\x20?[(\[]at[)\]]\x20?)[^\s@<>\"')\],;]++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?+[0-9]){10,}+",
    "phone": r"(?<![0-9+(])[+(]{0,2}[0-9][\x20().0-9-]{5,30}[0-9](?![0-9])",
    "secret": r"(?i)(?:token|secret|passwd|password|api_?key)[\"']?\s{0,4}[:=]\s{0,4}[\"']?[a-z0-9+/_=-]{8,}+",
}

#: Characters before and after a candidate that count as its context.
CONTEXT = 24

#: Candidates that are learnt from.
SAMPLE = 20_000

#: Precision that a kind's threshold must reach.
PRECISION = 0.95

#: The trees.
TREES, DEPTH = 12, 4

_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[0-9]|(?<=0))"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")
        ),
    )
    total = F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return (F.length(number) > 0) & (total % 10 == 0)


def octets(x: Column) -> Column:
    return x.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")


def confirmed(kind: Column, match: Column) -> Column:
    """Whether a strict match passes the check of its kind."""
    n = F.length(digits(match))
    return (
        F.when(kind == "ip", octets(match))
        .when(kind == "card", n.between(12, 19) & luhn(digits(match)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _strict(match: Column) -> Column:
    """Whether a candidate as a whole has the strict form of its kind and passes the check.

    A secret has no strict form: it passes when it is 32 hex digits or more.
    """
    kind = F.col("kind")
    forms = {k: p.replace(rf"(?:(?<!{_LOCAL})|\G)", "").replace(r"(?:(?<![0-9])|\G)", "") for k, p in STRICT.items()}
    forms["secret"] = "[0-9a-fA-F]{32,}"
    formed = F.lit(False)
    for i, k in enumerate(KINDS):
        formed = formed | ((kind == i) & match.rlike(f"^(?:{forms[k]})$"))
    names = F.array(*[F.lit(k) for k in KINDS])
    return formed & confirmed(names[kind], match)


def _unveiled(match: Column) -> Column:
    """A candidate as it may have been before it was written in a veiled form."""
    forms = {
        "email": F.regexp_replace(match, r"\x20?[(\[]at[)\]]\x20?", "@"),
        "card": F.regexp_replace(match, r"\.", ""),
        "phone": F.concat(F.lit("+"), F.ltrim(match, F.lit("+"))),
        "secret": F.when(match.rlike("^[0-9a-fA-F]{16,}$"), F.repeat(match, F.lit(2))).otherwise(match),
    }
    form = match
    for k, changed in forms.items():
        form = F.when(F.col("kind") == KINDS.index(k), changed).otherwise(form)
    return form


def _label() -> Column:
    """1.0 for what the strict rules confirm, 0.0 for what they don't; null where nothing is known.

    Nothing is known of a candidate that the rules would confirm in another form.
    """
    match = F.col("match")
    return F.when(_strict(match), 1.0).when(~_strict(_unveiled(match)), 0.0)


#: What a text must hold to hold a span of the kind at all: a cheaper search than the patterns'.
_GATES = {
    "email": r"@|[(\[]at[)\]]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20.-]?+[0-9]){10}",
    "phone": r"[0-9][\x20().0-9-]",
    "secret": r"(?i)(?:token|secret|passwd|password|api_?key)",
}


def _spans(kind: str, pattern: str, text: Column) -> Column:
    found = F.transform(
        tx.matches(text, pattern),
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            x["end"].alias("end"),
            x["match"].alias("match"),
        ),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,match:string>>")
    return F.when(text.rlike(_GATES[kind]), found).otherwise(none)


def _base(text: Column) -> Column:
    """All confirmed strict spans: array<struct<start,kind,end,match>>, by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    found = F.concat(*[_spans(k, p, text) for k, p in STRICT.items()])
    return F.array_sort(F.filter(found, lambda x: confirmed(names[x["kind"]], x["match"])))


def _proposed(text: Column) -> Column:
    """All wide spans with their context, wherever lines end."""
    secret, email = KINDS.index("secret"), KINDS.index("email")

    def value(x: Column) -> Column:
        """Of a secret only the value; of an address not the punctuation it ends with."""
        last = F.regexp_extract(x["match"], r"([A-Za-z0-9+/_=-]+)$", 1)
        tail = F.regexp_extract(x["match"], r"[^A-Za-z0-9]*$", 0)
        end = F.when(x["kind"] == email, x["end"] - F.length(tail)).otherwise(x["end"])
        start = F.when(x["kind"] == secret, x["end"] - F.length(last)).otherwise(x["start"])
        return F.struct(start.alias("start"), x["kind"].alias("kind"), end.alias("end"))

    part = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def context(x: Column) -> Column:
        before = F.greatest(x["start"] - CONTEXT, F.lit(0))
        return F.struct(
            *[x[c].alias(c) for c in ("start", "kind", "end")],
            part(x["start"], x["end"]).alias("match"),
            part(before, x["start"]).alias("before"),
            part(x["end"], x["end"] + CONTEXT).alias("after"),
        )

    wide = F.concat(*[_spans(k, p, text) for k, p in WIDE.items()])
    return F.transform(F.transform(wide, value), context)


def veiled(rows: DataFrame) -> DataFrame:
    """Confirmed candidates written as the strict rules don't know them, in the same context.

    An address spells its @, a card number has dots, a phone number no plus, a secret is cut to 24
    characters. So a label does not follow from the strict checks that are among the features.
    """
    kind, match = F.col("kind"), F.col("match")
    forms = {
        "email": F.regexp_replace(match, "@", " (at) "),
        "card": F.regexp_replace(F.regexp_replace(match, r"[\x20-]", ""), "([0-9]{4})(?=[0-9])", "$1."),
        "phone": F.ltrim(match, F.lit("+")),
        "secret": F.substring(match, 1, 24),
    }
    form = F.lit(None).cast("string")
    for k, changed in forms.items():
        form = F.when(kind == KINDS.index(k), changed).otherwise(form)
    return rows.where("label = 1.0").withColumn("match", form).where("match IS NOT NULL")


def _count(x: Column, letters: str) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, f"[{letters}]", ""))


def features(rows: DataFrame) -> DataFrame:
    """Columns f_* for candidates with kind, match, before and after."""
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    number = digits(match)
    flags: dict[str, Column] = {
        "length": F.length(match),
        "digits": F.length(number),
        "letters": _count(match, "A-Za-z"),
        "dots": _count(match, "."),
        "gaps": _count(match, r"\x20-"),
        "variety": F.size(F.array_distinct(F.split(match, ""))),
        "plus": match.startswith("+"),
        "paren": match.contains("("),
        "luhn": luhn(number),
        "octets": octets(match),
        "domain": match.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"),
        "hex": match.rlike(r"^[0-9a-fA-F]+$"),
        "joined_before": before.rlike(r"[A-Za-z0-9@.+-]$"),
        "joined_after": after.rlike(r"^[A-Za-z0-9@-]"),
        "quoted": before.rlike(r"[\"']$") & after.rlike(r"^[\"']"),
        "named": before.rlike(r"(?i)(?:mail|phone|tel|call|card|visa|server|host|address|token|secret|key|pass)"),
        "assigned": before.rlike(r"[:=]\s*[\"']?$"),
    }
    named = {f"f_{k}": v.cast("double") for k, v in flags.items()}
    named |= {f"f_{k}": (F.col("kind") == i).cast("double") for i, k in enumerate(KINDS)}
    return rows.withColumns(named)


def learn(candidates: DataFrame, sample: int = SAMPLE) -> tuple[GBTClassificationModel, list[float]] | None:
    """The trees, and for every kind the probability from which a candidate is taken.

    Candidates without a label are neither learnt from nor judged. Copies of one are learnt from once, an equal share of the sample for each kind and
    label, and confirmed ones in a veiled form as well. The thresholds count all candidates that the
    trees haven't seen, three in ten at least, veiled forms included. None where there are no
    candidates of one of the two classes to learn from.
    """
    form = ["kind", "match", "before", "after"]
    distinct = stage(
        candidates.where("label IS NOT NULL").groupBy(*form, "label").agg(F.count(F.lit(1)).alias("copies")), "pii-distinct"
    )
    order = F.xxhash64("match", "before", "after")
    strata = [
        distinct.where((F.col("kind") == kind) & (F.col("label") == label) & (F.pmod(order, F.lit(10)) >= 3))
        .orderBy(F.xxhash64(order, F.lit(1)), "match", "before", "after")
        .limit(max(1, sample // (2 * len(KINDS))))
        for kind in range(len(KINDS))
        for label in (0.0, 1.0)
    ]
    seen = stage(reduce(DataFrame.unionByName, strata), "pii-sample")
    chosen = stage(features(seen.unionByName(veiled(seen))), "pii-features")
    if chosen.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=17, cacheNodeIds=False)
    model = trees.fit(_assembled(chosen))
    unseen = distinct.join(seen.select(*form), form, "left_anti")
    # A kind of which the trees have seen everything is judged by that.
    lone = seen.join(unseen.select("kind").distinct(), "kind", "left_anti")
    judged = unseen.unionByName(lone)
    scored = model.transform(_assembled(features(judged.unionByName(veiled(judged)))))
    rows = (
        scored.select("kind", "label", "copies", F.floor(_probability() * 100).cast("int").alias("p"))
        .groupBy("kind", "p")
        .agg(F.sum(F.col("label") * F.col("copies")).alias("right"), F.sum("copies").alias("n"))
        .collect()  # at most 101 steps of each kind
    )
    least = [1.01] * len(KINDS)
    for kind in range(len(KINDS)):
        right = total = 0.0
        for row in sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["p"]):
            right, total = right + row["right"], total + row["n"]
            if right / total >= PRECISION:
                least[kind] = row["p"] / 100
    return model, least


def _assembled(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c.startswith("f_")]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def _probability() -> Column:
    return vector_to_array("probability")[1]


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, array<struct<start,kind,end,...>>.

    ``base`` holds the strict spans that pass their checks, ``spans`` these and the candidates
    that the trees select, each with the number of its kind in ``KINDS`` and its score (1 for
    a base span). A selected candidate that overlaps a base span is left out; the others are taken
    in order, those that start first before others, then longer ones, each if it overlaps none
    taken before. Places are code points. Very long texts are searched whole, spans may cross
    lines. A null text is an empty one and has no spans. Rows that repeat a doc_id are searched each
    for itself. An empty table gives an empty one. Other columns are not looked at.
    """
    text = tx.whole(F.col("text"))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("row"),
    )
    found = stage(
        texts.select(
            "doc_id", "row", _base(F.col("text")).alias("base"), _proposed(F.col("text")).alias("proposed")
        ),
        "pii-found",
    )
    proposed = found.select("doc_id", "row", F.explode("proposed").alias("p"))
    candidates = proposed.select("doc_id", "row", "p.*").withColumn("label", _label())
    learnt = learn(candidates, sample)

    base = found.select("doc_id", "row", F.explode("base").alias("b")).select(
        "doc_id", "row", "b.start", "b.kind", "b.end", F.lit(1.0).alias("score"), F.lit(True).alias("is_base")
    ).distinct()
    spans = base
    if learnt is not None:
        model, least = learnt
        limits = F.array(*[F.lit(x) for x in least])
        taken = (
            model.transform(_assembled(features(candidates)))
            .withColumn("score", F.round(_probability(), 6))
            .where(F.col("score") >= limits[F.col("kind")])
            .select("doc_id", "row", "start", "kind", "end", "score", F.lit(False).alias("is_base"))
            .distinct()
        )
        spans = _without_overlaps(base.unionByName(taken))
    listed = (
        spans.groupBy("doc_id", "row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "score"))).alias("spans"))
        .withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    )
    same = found["doc_id"].eqNullSafe(listed["_id"]) & (found["row"] == listed["_row"])
    none = F.array().cast(listed.schema["spans"].dataType)
    return found.join(listed, same, "left").select(
        "doc_id", "base", F.coalesce("spans", none).alias("spans")
    )


def _without_overlaps(spans: DataFrame) -> DataFrame:
    """All base spans, and of the others, in order, those that overlap none of these and none taken.

    Spans that overlap, directly or through others, are a chain; each chain is decided by itself.
    """
    text = Window.partitionBy("doc_id", "row").orderBy("start", F.desc("end"), "kind")
    earlier = text.rowsBetween(Window.unboundedPreceding, -1)
    later = text.rowsBetween(1, Window.unboundedFollowing)
    base_end = F.max(F.when(F.col("is_base"), F.col("end"))).over(earlier)
    base_start = F.min(F.when(F.col("is_base"), F.col("start"))).over(later)
    clear = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (
        F.coalesce(base_start, F.col("end")) >= F.col("end")
    )
    others = spans.withColumn("clear", clear).where("clear AND NOT is_base").drop("clear")
    opens = F.coalesce(F.max("end").over(earlier) <= F.col("start"), F.lit(True)).cast("int")
    chained = others.withColumn("opens", opens).withColumn("chain", F.sum("opens").over(text))
    # longer ones first among those that start together
    entry = F.struct("start", (-F.col("end")).alias("back"), "kind", "end", "score")
    chains = chained.groupBy("doc_id", "row", "chain").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    none = F.slice("all", 1, 0)
    taken = F.aggregate(
        "all",
        none,
        lambda kept, x: F.when(
            (F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= x["start"]), F.concat(kept, F.array(x))
        ).otherwise(kept),
    )
    chosen = chains.select("doc_id", "row", F.explode(taken).alias("x")).select(
        "doc_id", "row", "x.start", "x.kind", "x.end", "x.score", F.lit(False).alias("is_base")
    )
    return spans.where("is_base").unionByName(chosen)


def joined(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ","
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlaps count once."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def put(done: Column, x: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int"))
        return F.when(
            x["start"] >= done["at"],
            F.struct(F.concat(done["out"], gap, names[x["kind"]]).alias("out"), x["end"].alias("at")),
        ).otherwise(
            F.struct(done["out"].alias("out"), F.greatest(done["at"], x["end"]).alias("at"))
        )

    return F.aggregate(
        spans,
        start,
        put,
        lambda done: F.concat(
            done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
        ),
    )
