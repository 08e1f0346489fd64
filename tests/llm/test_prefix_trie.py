"""The trie of rebuilt conversations against a dictionary of prefixes, on tables of many shapes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from swardshift.llm import prefix_trie as pt

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(rows, attempt=0):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    mark = lambda o: (o[0], o[1], hashlib.sha256(f"{attempt}:{len(o[2])}:{o[2]}{o[3]}".encode()).hexdigest()[:32])
    conv = {c: [o[2:] for o in sorted(v, key=mark)] for c, v in conv.items()}
    members, length = {}, {}
    for c in conv:
        head = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))  # the remainder has the sign of the id, as in SQL
        whole = conv.get(base, [])[:head] + conv[c][head:]
        length[c] = len(whole)
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in own) if own else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = sum(saved[x] for x in own) + (len(members[k]) - 1) * words
    digest = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if length[c] == len(k)))).encode()).hexdigest()
    return ordered((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], digest(k, m)) for k, m in members.items())


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def check(spark, rows, **options):
    turns = spark.createDataFrame(rows, SCHEMA)
    assert ordered(pt.prefix_trie(turns, **options).collect()) == brute(rows, options.get("first_attempt", 0))


def drawn(rng, convs, turns, texts):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(convs) for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize("seed", [1, 2])
def test_small_vocabulary(spark, seed):
    rng = random.Random(seed)
    rows = drawn(rng, 260, 5, ["a", "b c", "", "d\ne f"])
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (0, None, None, None), (0, None, "", ""), (0, 1, "user", "x y"), (0, 1, "user", "x y"), (0, 1, "user", "x z"),
        (1, 0, "user", ""), (21, 3, None, "no base here"), (22, None, "a", "bc"), (23, None, "ab", "c"), (40, 0, "user", "word " * 30_000), (41, 0, "user", None),
        (-3, 1, "user", "negative ids"), (-40, 2, "user", "too"), (9_000_000_000, 0, "user", "large ids"), (60, 0, "é \U0001f600", "日本語　x"),
    ]
    check(spark, rows)


def test_no_rows_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pt.prefix_trie(empty).collect() == []
    rows = drawn(random.Random(4), 30, 4, ["a", "b"])
    names = ["c", "d", "f1", "w", "mark", "own", "head", "n", "last", "at"]
    wide = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], T.StructType([*SCHEMA, *[T.StructField(n, T.StringType()) for n in names]]))
    assert ordered(pt.prefix_trie(wide).collect()) == brute(rows)


def test_hot_conversation_and_hot_copies(spark):
    """A conversation with a third of the rows, and a third of the conversations equal, over many partitions."""
    rng = random.Random(5)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(1500)] + [(8, t, "user", f"t{t % 7}") for t in range(1400)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 400) for t in range(3)] + drawn(rng, 90, 6, ["p", "q r"])
    rows = [r for r in rows if r[0] not in (5, 8) or r[3].startswith("t")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_other_plan(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "z"), (2, 1, "u", "b"), (2, 2, "u", "c")]
    got = pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), plan=lambda c: (F.lit(1).cast("long"), F.lit(1)), most_head=1)
    # Both begin with the first turn of conversation 1: a b, and a b c.
    assert sorted((r.depth, r.conv_id, r.n_convs, r.n_children) for r in got.collect()) == [(0, 1, 2, 1), (1, 1, 2, 1), (2, 1, 2, 1), (3, 2, 1, 0)]


def test_fingerprints_that_meet_are_drawn_again(spark, monkeypatch):
    """With base 1 the order of turns is lost, so different prefixes meet; the check notices."""
    real = pt.bases
    monkeypatch.setattr(pt, "bases", lambda attempt: (1, 1) if attempt == 0 else real(attempt))
    rows = [(c, t, "user", x) for c, xs in enumerate([["a", "b", "c", "d", "e"], ["b", "a", "c", "d", "e"], ["a", "c", "b", "e", "d"]] * 4) for t, x in enumerate(xs)]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert ordered(pt.prefix_trie(turns).collect()) == brute(rows, 1)


def test_fingerprints_compose():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 2**63, 50, dtype=np.uint64)
    base = pt.bases(0)[0]
    whole = pt.prefix_fingerprints(np.zeros(50, dtype=np.int64), marks, base)
    plain = 0
    for k, m in enumerate(marks.tolist()):
        plain = (plain * base + m) % 2**64
        assert plain == int(whole[k])
    tail = pt.prefix_fingerprints(np.zeros(30, dtype=np.int64), marks[20:], base)
    joined = whole[19] * pt.power_of(base, np.arange(1, 31)) + tail
    assert (joined == whole[20:]).all()
