"""The same answers by plain loops, for small inputs."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict


def fixed6(x):
    return math.floor(x * 1e6 + 0.5) / 1e6


def shuffle_key(seed, *parts):
    return hashlib.md5("|".join(str(p) for p in (seed, *parts)).encode()).hexdigest()


def prepare(rows, names, cap=None, min_events=1, seed=0):
    """rows are (user, event, item); returns the kept set and the users."""
    raw = Counter(r for r in rows if r[1] in names)
    per_user = Counter()
    for (u, e, _), n in raw.items():
        if e == names[0]:
            per_user[u] += n
    users = {u for u, n in per_user.items() if n >= min_events}
    by_user, by_item = defaultdict(list), defaultdict(list)
    for u, e, i in raw:
        if u in users:
            by_user[u, e].append(i)
    for (u, e), items in by_user.items():
        for i in sorted(items, key=lambda i: (shuffle_key(seed, u, i), i))[:cap]:
            by_item[e, i].append(u)
    kept = set()
    for (e, i), us in by_item.items():
        for u in sorted(us, key=lambda u: (shuffle_key(seed, u, i), u))[:cap]:
            kept.add((u, e, i))
    return kept, users


def entropy(*counts):
    xlx = lambda x: x * math.log(x) if x > 0 else 0.0
    return xlx(sum(counts)) - sum(xlx(c) for c in counts)


def llr(k, a, b, n):
    rows, cols = entropy(a, n - a), entropy(b, n - b)
    return max(0.0, 2 * (rows + cols - entropy(k, a - k, b - k, n - a - b + k)))


def correlators(rows, names, k=50, **limits):
    """{(item, event): [(correlator, llr), ...]} strongest first."""
    kept, users = prepare(rows, names, **limits)
    margin = Counter((e, i) for _, e, i in kept)
    baskets = defaultdict(set)
    for u, e, i in kept:
        baskets[u].add((e, i))
    both = Counter()
    for basket in baskets.values():
        for e, i in basket:
            if e == names[0]:
                both.update((i, f, j) for f, j in basket if (f, j) != (e, i))
    lists = defaultdict(list)
    for (i, f, j), n in both.items():
        score = fixed6(llr(n, margin[names[0], i], margin[f, j], len(users)))
        if score > 1e-6:
            lists[i, f].append((j, score))
    return {key: sorted(v, key=lambda x: (-x[1], x[0]))[:k] for key, v in lists.items()}


def weights(documents):
    """documents: {item: {field: [terms]}}; returns {(field, term): idf} and the postings."""
    found, has = defaultdict(set), Counter()
    for item, doc in documents.items():
        for field, terms in doc.items():
            has[field] += bool(terms)
            for t in terms:
                found[field, t].add(item)
    idf = {
        (f, t): math.log(1 + (has[f] - len(s) + 0.5) / (len(s) + 0.5)) for (f, t), s in found.items()
    }
    return idf, found


def recommend(order, documents, clauses, taken, allowed=lambda item: True, start=0, num=20, cf=False):
    """order: all items, best rank first; clauses: [(field, term, boost)]."""
    idf, found = weights(documents)
    score = defaultdict(float)
    for field, term, boost in clauses:
        for item in found.get((field, term), ()):
            score[item] += boost * idf[field, term]
    place = {item: p for p, item in enumerate(order)}
    listed = [i for i in order if i not in taken and allowed(i) and (not cf or score[i] > 0)]
    listed.sort(key=lambda i: (-fixed6(score[i]), place[i]))
    return [(i, fixed6(score[i])) for i in listed[start : start + num]]
