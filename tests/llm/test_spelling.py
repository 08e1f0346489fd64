"""Spelling variants against comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from swardshift.llm import spelling

from .odd import documents, no_documents


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute(counts, ratio=5):
    near_of = {x: [y for y in counts if near(x, y)] for x in counts}
    form = {}
    for x, ys in near_of.items():
        top = min(ys, key=lambda y: (-counts[y], y), default=None)
        form[x] = top if top is not None and counts[top] >= ratio * counts[x] else None

    def root(x):
        while form[x] is not None:
            x = form[x]
        return x

    return sorted((x, n, len(near_of[x]), form[x], counts.get(form[x]), root(x)) for x, n in counts.items())


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)


def result(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@pytest.mark.parametrize(("letters", "block"), [("ab", 1 << 15), ("ab", 40), ("abcé日\U0001f600", 60)])
def test_all_pairs(spark, letters, block):
    """Few letters: many near words, repeated letters, and ends that more words share than a block holds."""
    rng = random.Random(len(letters) + block)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 10))): 5 ** rng.randint(0, 6) for _ in range(350)}
    assert result(spelling.spelling_groups(table(spark, counts), block_words=block)) == brute(counts)


def test_chain_ties_and_boundaries(spark):
    counts = {
        "abcdef": 15625, "abcdefg": 3125, "abcdefgh": 625, "abcdefghi": 125, "abcdefghij": 25, "abcdefghijk": 5,  # one long path
        "mmmmmm": 10, "mmmmmmm": 50, "mmmmmx": 50, "xmmmmm": 50,  # ties: the first in code-point order
        "zzzzzz": 11, "zzzzzy": 54,  # not five times as frequent
        "a" * 3000: 7, "a" * 2999 + "b": 70, "b" + "a" * 2999: 35, "éééééé": 9, "ééééé日": 45,
    }
    got = result(spelling.spelling_groups(table(spark, counts)))
    assert got == brute(counts)
    roots = {r[0]: r[-1] for r in got}
    assert roots["abcdefghijk"] == "abcdef" and roots["mmmmmm"] == "mmmmmmm" and roots["zzzzzz"] == "zzzzzz"


def test_no_words(spark):
    assert spelling.spelling_groups(table(spark, {"x" * 6: 1}).where("n > 1")).collect() == []
    assert spelling.vocabulary(no_documents(spark)).collect() == []


def counted(rows, least_count, every):
    total = Counter()
    for own, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'null' if own is None else own}:{run}".encode())
            k = h % len(run)
            total[run[:k] + run[k + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= least_count}


@pytest.mark.parametrize("every", [3, 199])
def test_vocabulary(spark, every, monkeypatch):
    """Counts of the runs, deletions included; a task that hands on early changes nothing."""
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    rng = random.Random(9)
    letters = "abZé÷×ÿ"
    rows = [(rng.choice([1, 2, 3, None]), " ".join("".join(rng.choice(letters) for _ in range(rng.randint(5, 7))) for _ in range(400))) for _ in range(12)]
    rows += [(7, "Straße-Straße straSSe ŒUVREnote İstanbul KelvinKsign ABCDEF abcdef"), (8, None), (9, ""), (None, "ABCDEF")] * 2
    docs = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert {r.word: r.n for r in spelling.vocabulary(docs, least_count=2, every=every).collect()} == counted(rows, 2, every)


def test_odd_documents(spark, monkeypatch):
    from .odd import ROWS

    docs = documents(spark)
    want = counted([(r[0], r[1]) for r in ROWS], 1, 199)
    monkeypatch.setattr(spelling, "_LONG_TEXT", 1000)
    words = spelling.vocabulary(docs, least_count=1)
    assert {r.word: r.n for r in words.collect()} == want
    assert result(spelling.spelling_groups(words)) == brute(want)
