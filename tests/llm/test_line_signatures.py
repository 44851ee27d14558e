"""Lines without spaces and rulers of different lengths meet their near copies."""

import random
import string

import pytest

from entivore.llm import line_dedup


def test_unspaced_lines_and_rulers(spark):
    pick = random.Random(6)
    base = ["".join(chr(pick.randrange(0x4E00, 0x9F00)) for _ in range(n)) for n in (80, 121, 300) * 10]
    base += ["https://a.example/" + "".join(pick.choices("abcdefghijklmnop0123456789/", k=120)) for _ in range(10)]
    near = [chr(0x3042) + x[1:] for x in base]
    rulers = ["-" * 50, "-" * 90, "=-" * 25, "=-" * 60]
    docs = spark.createDataFrame([(1, "\n".join(base + rulers[::2])), (2, "\n".join(near + rulers[1::2]))], "doc_id long, text string")
    got = {r.doc_id: list(r.removed) for r in line_dedup.decisions(docs).collect()}
    assert got == {1: [], 2: list(range(len(base) + 2))}


@pytest.mark.parametrize("n", [1000, 3000])
def test_templates_are_no_square(spark, monkeypatch, n):
    """Lines that share a long beginning and are not similar: few pairs are verified, and similar ones are found among them."""
    rng = random.Random(n)
    template = "share this page with your friends and subscribe to our weekly newsletter at"
    lines = [f"{template} {''.join(rng.choices(string.ascii_lowercase + string.digits, k=45))}" for _ in range(n)]
    twins = {i: lines[i][:-2] + "zz" for i in range(0, n, 50)}
    rows = [(i, x) for i, x in enumerate(lines)] + [(10_000 + i, x) for i, x in twins.items()]
    compared = []
    similar = line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, percent: compared.append(pairs.count()) or similar(pairs, percent))
    got = {r.doc_id for r in line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).where("size(removed) > 0").collect()}
    assert got == {10_000 + i for i in twins}
    assert sum(compared) <= 4 * n


def test_lines_of_one_beginning_share_more_than_a_word(spark, monkeypatch):
    """Lines of a long beginning that also share a rare word or two: these aren't compared for the words' sake, and near copies are found."""
    rng = random.Random(5)
    words = ["".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(40)]
    template = "share this page with your friends and subscribe to our weekly newsletter at once, then tell"
    lines = [f"{template} {rng.choice(words)} {''.join(rng.choices(string.ascii_lowercase + string.digits, k=30))}" for _ in range(1500)]
    twins = {i: lines[i][:-2] + "zz" for i in range(0, 1500, 50)}
    rows = [(i, x) for i, x in enumerate(lines)] + [(10_000 + i, x) for i, x in twins.items()]
    compared = []
    similar = line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, percent: compared.append(pairs.count()) or similar(pairs, percent))
    got = {r.doc_id for r in line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).where("size(removed) > 0").collect()}
    assert got == {10_000 + i for i in twins}
    assert sum(compared) <= 8 * 1500


def shingles(line):
    return frozenset(line[i : i + 5] for i in range(max(len(line) - 4, 1)))


def test_crowds_are_compared_by_sketches(spark, monkeypatch):
    """Lines of one beginning with two rare words each: few pairs are verified, and the near copies are found."""
    rng = random.Random(8)
    words = ["".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(40)]
    template = "share this page with your friends and subscribe to our weekly newsletter at once, then tell"
    lines = [f"{template} {rng.choice(words)} {rng.choice(words)} {''.join(rng.choices(string.ascii_lowercase + string.digits, k=30))}" for _ in range(1500)]
    twins = {i: lines[i][:-2] + "zz" for i in range(0, 1500, 50)}
    rows = [(i, x) for i, x in enumerate(lines)] + [(10_000 + i, x) for i, x in twins.items()]
    compared = []
    similar = line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, percent: compared.append(pairs.count()) or similar(pairs, percent))
    got = {r.doc_id for r in line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).where("size(removed) > 0").collect()}
    assert got == {10_000 + i for i in twins}
    assert sum(compared) <= 4 * len(rows)


def test_sketches_lose_no_similar_pair(spark):
    """No pair that reaches the similarity is left out by its sketches, and most that are far below it are."""
    rng = random.Random(9)
    lines = []
    for n in (8, 30, 90, 300, 900, 3000):
        base = "".join(rng.choices("abcdefgh ", k=n))
        lines.append(base)
        for share in (1, 3, 5, 8, 12, 30, 60):
            at = rng.randrange(n)
            lines.append(base[:at] + "".join(rng.choices("xyz", k=max(1, n * share // 100))) + base[at:])
    sets = [shingles(x) for x in lines]
    texts = spark.createDataFrame([(i, len(sets[i]), x) for i, x in enumerate(lines)], "id long, size int, line string")
    rows = texts.join(line_dedup.sketches(texts), "id").cache()
    near = {(r.a, r.b) for r in rows.alias("x").join(rows.alias("y"), line_dedup.may_be_similar(80)("x", "y")).selectExpr("x.id AS a", "y.id AS b").collect()}
    similar = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y)}
    assert similar <= near
    assert not any(len(sets[i] & sets[j]) < 0.4 * len(sets[i] | sets[j]) and len(sets[i] | sets[j]) < 1000 for i, j in near)


@pytest.mark.parametrize("few, crowd", [(2, 4), (2, 4000), (16, 16)])
def test_ways_of_crowds_give_one_result(spark, monkeypatch, few, crowd):
    """Bands of any size, compared at once, by sketches or by rare shingles, lead to the same lines."""
    rng = random.Random(10)
    rows = []
    for k in range(12):
        base = "".join(rng.choices("abcdefghij ", k=200))
        for i in range(20):
            at = rng.randrange(190)
            rows.append((100 * k + i, base[:at] + "".join(rng.choices("xyz", k=rng.randrange(1, 9))) + base[at:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: list(r.removed) for r in line_dedup.decisions(docs).collect()}
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    assert {r.doc_id: list(r.removed) for r in line_dedup.decisions(docs).collect()} == want
