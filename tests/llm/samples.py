"""Small inputs with all the awkward rows, and plain loops to compare with."""

import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, digest string, label string, ids string, tokens string, node string, "
    "`key` string, score string, _id string, _metadata string, place string, n string"
)
_EXTRA = ("x",) * 12

LONG = " ".join(f"word{i % 977} filler" for i in range(15_000))
LICENSED = "Some prose.\nLicensed under the Apache License, Version 2.0.\nAll rights  reserved"
PLAIN = "the quick brown fox jumps over the lazy dog again and again"

TEXTS = [
    (1, PLAIN),
    (2, PLAIN),
    (2, PLAIN),
    (3, None),
    (4, ""),
    (None, None),
    (None, PLAIN),
    (5, LONG),
    (6, LONG + " tail"),
    (7, LICENSED),
    (8, "\n\n \t\n"),
    (9, "two words"),
    (10, "Two  Words"),
    (11, "ünïcödé 日本語 😀 İK ſ\x00\x1c\x85"),
    (12, "repeated line of text here\nown line of twelve\nrepeated line of text here"),
    (13, "  REPEATED line of text here\t\nshort\nshort"),
    (14, "mail a@b.example.com, 10.0.0.255 +1 (555) 123-4567 4539 1488 0343 6467 256.1.1.1"),
]


def docs(spark, rows=TEXTS):
    full = [(i, t, None if i == 4 else "en", None if i == 3 else "s", None, *_EXTRA) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


class Union:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def near(rows, link=85):
    """doc_id to (set size, component) by comparing all pairs; ids must not be null."""
    sets = {i: shingles(t) for i, t in rows}
    union = Union(sets)
    items = [(i, s) for i, s in sets.items() if s]
    for n, (i, a) in enumerate(items):
        for j, b in items[:n]:
            both = len(a & b)
            if 100 * both >= link * (len(a) + len(b) - both):
                union.join(i, j)
    return {i: (len(sets[i]), union.find(i)) for i in sets}
