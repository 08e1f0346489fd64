"""Near-duplicate documents and lines against brute force and on awkward tables."""

import random
import time
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swardshift.llm import components, line_neighbours, lsh_forest

from .odd import PROSE, ROWS, by_row, documents, no_documents


def shingles(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "x").split(" ") if w]
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)])


def brute_components(texts, percent):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(sets):
        for e in s:
            index[e].append(k)
    seen = {(a, b) for v in index.values() for a in v for b in v if a < b}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return words


def test_forest_finds_all_components(spark):
    rng = random.Random(11)
    texts = []
    vocabulary = [f"w{k}" for k in range(4000)]
    # A crowded group around one text, with edits on both sides of the limit, and copies of copies.
    base = [rng.choice(vocabulary) for _ in range(150)]
    crowd = [edited(rng, base, rng.randint(0, 8)) for _ in range(260)]
    crowd += [edited(rng, rng.choice(crowd), rng.randint(1, 2)) for _ in range(60)]
    texts += [" ".join(w) for w in crowd]
    for _ in range(60):  # small groups
        own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 400))]
        texts += [" ".join(edited(rng, own, rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
    texts += ["", None, "one", "ONE", "one two", "two one", *["exact copy of a text that stands here many times over"] * 50]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[k] for k in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = lsh_forest.near_duplicates(docs, percent=85, region=16)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in found.collect()}
    comps, sizes = brute_components(texts, 85)
    assert got == {k: (c, n, c == k) for k, (c, n) in enumerate(zip(comps, sizes, strict=True))}


def test_only_the_rarest_shared_shingles_become_rows(spark, monkeypatch):
    """80 sets of 250 shingles share 200: a partner shares one of the few rarest, whether frequencies are known or not."""
    rng = random.Random(6)
    shared = {rng.getrandbits(62): 80 for _ in range(190)} | {rng.getrandbits(62): 3 for _ in range(10)}
    sets = [(k, 250, k // 2, sorted([*shared, *(rng.getrandbits(62) for _ in range(50))])) for k in range(80)]
    sets.append((80, 100, 80, sorted([*list(shared)[:40], *(rng.getrandbits(62) for _ in range(60))])))  # shares too little
    own = spark.createDataFrame(sets, "rep long, n long, component long, shingles array<long>").repartition(3)
    df = spark.createDataFrame(list(shared.items()), "token long, df long")
    for most in (1 << 18, 12, 0):
        monkeypatch.setattr(lsh_forest, "MOST_FREQUENT", most)
        found = defaultdict(list)
        for r in lsh_forest._rarest_shared(own, df, 80).collect():
            found[r["rep"]].append((r["pos"], r["token"], r["c"]))
        assert set(found) == set(range(80))
        for k, rare in found.items():
            c = rare[0][2]
            assert 200 <= c < 210 and [p for p, _, _ in sorted(rare)] == list(range(c - 199))
            passed = [t for _, t, _ in sorted(rare)]
            if most == 1 << 18:  # shingles of no known frequency come first
                least = min((v, t) for t, v in shared.items())[1]
                assert passed[-1] == least


def test_forest_is_exact_without_frequencies(spark, monkeypatch):
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(80)]
    base = passage + [f"w{rng.randrange(4000)}" for _ in range(60)]
    texts = [" ".join(edited(rng, base, rng.randint(0, 9))) for _ in range(90)]
    texts += [" ".join(passage + [f"v{rng.randrange(4000)}" for _ in range(rng.randint(2, 60))]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    comps, _ = brute_components(texts, 85)
    for most in (1 << 18, 0):
        monkeypatch.setattr(lsh_forest, "MOST_FREQUENT", most)
        got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(docs, percent=85, region=4).collect()}
        assert got == dict(enumerate(comps))


def test_forest_on_awkward_tables(spark):
    rows = by_row(lsh_forest.near_duplicates(documents(spark)), "doc_id", "component_id", "kept")
    assert len(rows) == len(ROWS)
    assert rows.count((1, 0, False)) == 2 and (0, 0, True) in rows and (2, 2, True) in rows and (3, 3, True) in rows
    assert rows.count((None, None, True)) == 2
    assert lsh_forest.near_duplicates(no_documents(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, least):
    lines = [(k, n, line.strip(" \t\n\v\f\r")) for k, t in rows if t for n, line in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if x[2])
    firsts = {}
    for k, n, body in lines:
        firsts.setdefault(body, (k, n))
    gone = {(k, n) for k, n, body in lines if firsts[body] != (k, n)}
    for x, at in firsts.items():
        if len(x) >= least and any(len(y) >= least and before < at and line_neighbours.within_one_edit(x, y) for y, before in firsts.items()):
            gone.add(at)
    return gone


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    bodies = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 45))) for _ in range(60)] + ["a" * 30, "aab" * 10, "é日" * 14]
    rows = []
    for k in range(250):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(bodies)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(line) + 1)
                line = rng.choice([line[:p] + rng.choice("abcd") + line[p:], line[:p] + line[p + 1 :], line[:p] + rng.choice("abcd") + line[p + 1 :]])
            lines.append(rng.choice(["", " ", "\t"]) + line + rng.choice(["", "  "]))
        rows.append((k, rng.choice(["\n", "\n\n"]).join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["id"], r["line"]) for r in line_neighbours.repeated_lines(docs).collect()}
    assert got == brute_lines(rows, line_neighbours.LEAST_CHARS)


def test_text_of_many_lines(spark):
    """100,000 lines, half of them copies, and 100,000 to pick out, in one text."""
    text = "\n".join(f"a line that stands here in a very long text, number {k % 50_000 * 7919}" for k in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    start = time.time()
    gone = line_neighbours.repeated_lines(docs)
    assert gone.where("line >= 50000").count() == 50_000
    cleaned = line_neighbours.drop_lines(docs, gone).where("doc_id = 1").first()["text"]
    assert len(cleaned.split("\n")) == 100_000 - gone.count()
    assert time.time() - start < 60


def test_short_copies_and_more_edits(spark):
    """Every line that is not blank joins for equality; the bound of edits is free."""
    rng = random.Random(5)
    bodies = ["".join(rng.choice("abc ") for _ in range(rng.randint(8, 16))) for _ in range(30)] + ["}", "* * *", "a", "é日" * 5]
    rows = []
    for k in range(120):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = rng.choice(bodies)
            for _ in range(rng.choice([0, 1, 2, 3])):
                p = rng.randrange(len(line) + 1)
                line = rng.choice([line[:p] + rng.choice("abcd") + line[p:], line[:p] + line[p + 1 :], line[:p] + rng.choice("abcd") + line[p + 1 :]])
            lines.append(line)
        rows.append((k, "\n".join(lines)))

    def distance(x, y):
        row = list(range(len(y) + 1))
        for c in x:
            new = [row[0] + 1]
            for j, d in enumerate(y):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
            row = new
        return row[-1]

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lines = sorted((k, n, line.strip(" ")) for k, t in rows for n, line in enumerate(t.split("\n")) if line.strip(" "))
    for edits in (1, 2, 3):
        want = set()
        for at, (k, n, x) in enumerate(lines):
            if any(x == y or (min(len(x), len(y)) >= 10 and distance(x, y) <= edits) for _, _, y in lines[:at]):
                want.add((k, n))
        got = {(r["id"], r["line"]) for r in line_neighbours.repeated_lines(docs, least_chars=10, copy_chars=1, edits=edits).collect()}
        assert got == want, edits


@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
@settings(max_examples=300, deadline=None)
def test_one_edit(x, y):
    near = {x} | {x[:p] + x[p + 1 :] for p in range(len(x))} | {x[:p] + c + x[p + d :] for p in range(len(x) + 1) for c in "ab" for d in (0, 1)}
    assert line_neighbours.within_one_edit(x, y) == (y in near)


def test_lines_on_awkward_tables(spark):
    docs = documents(spark)
    gone = line_neighbours.repeated_lines(docs)
    # The text without an id comes first, so the copies with ids fall.
    assert by_row(gone, "id", "line") == [(0, 0), (0, 1), (1, 0), (1, 1)]
    cleaned = line_neighbours.drop_lines(docs, gone)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)
    left = by_row(cleaned, "doc_id", "text")
    assert (None, PROSE) in left and (1, "") in left and (2, None) in left
    assert line_neighbours.repeated_lines(no_documents(spark)).count() == 0
    assert line_neighbours.drop_lines(docs, gone.where(F.lit(False))).count() == len(ROWS)
