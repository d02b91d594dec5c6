"""A small bookshop: users buy, browse and follow topics; books have properties."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql.types import (
    ArrayType, LongType, MapType, StringType, StructField, StructType, TimestampType,
)

NOW = datetime(2024, 6, 1)
EVENTS = ["buy", "browse", "follow"]

SCHEMA = StructType(
    [
        StructField("event", StringType()),
        StructField("entity_type", StringType()),
        StructField("entity_id", StringType()),
        StructField("target_entity_type", StringType()),
        StructField("target_entity_id", StringType()),
        StructField("properties", MapType(StringType(), ArrayType(StringType()))),
        StructField("event_time", TimestampType()),
        StructField("seq", LongType()),
    ]
)

BOOKS = [f"book {n:02d}" for n in range(14)]
TOPICS = ["sea", "war", "tea", "art"]
GENRES = ["novel", "essay", "verse"]
READERS = [f"r-{n}" for n in range(12)]


def usage_rows(seed=4, n=260):
    """(user, event, item, time), users of very different activity."""
    rng = random.Random(seed)
    rows = []
    for step in range(n):
        user = READERS[min(int(rng.expovariate(0.3)), len(READERS) - 1)]
        event = rng.choice(EVENTS)
        target = rng.choice(TOPICS) if event == "follow" else rng.choice(BOOKS[:11])
        rows.append((user, event, target, NOW - timedelta(hours=3 * step + 1)))
    return rows


def book_props():
    """Properties by book; the last two books have no events."""
    rng = random.Random(8)
    props = {}
    for n, book in enumerate(BOOKS):
        opens = NOW + timedelta(days=rng.randint(-30, 10))
        props[book] = {
            "genre": [rng.choice(GENRES)] + (["prize"] if n % 4 == 0 else []),
            "shelf": [str(n % 5)],
            "userRank": [str(float(n % 7))],
            "day": [opens.isoformat()],
            "from": [opens.isoformat()],
            "till": [(opens + timedelta(days=20)).isoformat()],
        }
    return props


def log_rows():
    rows = [
        (e, "user", u, "item", i, None, t, n) for n, (u, e, i, t) in enumerate(usage_rows())
    ]
    for n, (book, props) in enumerate(book_props().items()):
        rows.append(("$set", "item", book, None, None, props, NOW - timedelta(days=9), 1000 + n))
    return rows


def event_log(spark):
    return spark.createDataFrame(log_rows(), SCHEMA).coalesce(2)
