"""The pipeline's near-copy stage against brute-force components of five-word Jaccard 0.8."""

import collections
import random
import re

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def five_words(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def firsts(rows):
    """The ids that stay: the first of each component, and all without words."""
    sets, up = [five_words(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    common = collections.Counter((a, b) for x in by.values() for k, a in enumerate(x) for b in x[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {r[0] for i, r in enumerate(rows) if find(i) == i or not sets[i]}


def test_near_stage(spark):
    pick = random.Random(4)
    rows = [(0, None), (1, ""), (2, "one two three"), (3, "One two three")]
    for k in range(40):
        base = [f"w{pick.randrange(9000)}" for _ in range(pick.randrange(60, 200))]
        longer = base + [f"x{pick.randrange(9000)}" for _ in range(len(base) * pick.randrange(15, 30) // 100)]
        edited = [f"e{i}" if i % 47 == 20 else w for i, w in enumerate(base)]
        rows += [(10 + 3 * k + i, " ".join(x)) for i, x in enumerate((base, longer, edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == firsts(rows)
