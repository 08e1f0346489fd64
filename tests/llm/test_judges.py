"""Quality field, page extraction, personal data and divergence on fixtures and awkward tables."""

import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swardshift.llm import boosted_pii, divergence, line_blocks, line_crf
from swardshift.llm.wordhash import NOT_SPACE, WordHasher

from .odd import PROSE, ROWS, by_row, documents, no_documents

SF = "/root/testdata/sf0.01"


# --- quality field


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = line_crf.train(docs, labels)
    scored = line_crf.with_scores(docs.select("doc_id", "text"), field, score="score").join(labels, "doc_id")
    rows = [(r["doc_id"], r["score"], r["quality"]) for r in scored.collect()]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 50
    assert sum((s >= line_crf.THRESHOLD) == (q == 1) for _, s, q in held) / len(held) > 0.93
    flags = {r["doc_id"]: r["held"] for r in docs.select("doc_id", line_crf.in_fold(F.col("doc_id")).alias("held")).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in flags.items())


def test_labels_of_the_fold_are_never_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(line_crf.in_fold(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = line_crf.train(docs, labels, train_docs=200), line_crf.train(docs, turned, train_docs=200)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    lengths = [1, 4, 0, 3]
    before = np.concatenate([[0], np.cumsum(lengths)])
    x = rng.normal(size=(before[-1], 3))
    field = line_crf.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    got = field.marginals(x, before)
    e = x @ field.weights
    for a, b in zip(before, before[1:]):
        total, good = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            w = math.exp(sum(e[a + k] * y[k] for k in range(b - a)) + sum(field.moves[y[k - 1], y[k]] for k in range(1, b - a)))
            total, good = total + w, good + w * np.array(y)
        assert np.allclose(got[a:b], good / total)


def test_a_text_scores_the_same_in_any_company():
    field = line_crf.Field(np.linspace(-1, 1, len(line_crf.FEATURES)), np.array([[1.0, -1], [-0.5, 2]]))
    texts = [PROSE, "", "a | b | c\n\n \nAN ODD LINE!!\na | b | c", "é" * 50, PROSE + "\n" + PROSE, None]
    hasher = WordHasher(NOT_SPACE)
    together = line_crf.document_scores(field, pa.array(texts), hasher)
    alone = [line_crf.document_scores(field, pa.array([t], pa.string()), hasher)[0] for t in texts]
    assert np.allclose(together, alone) and together[1] == together[5] == 0


def test_quality_on_awkward_tables(spark):
    labels = spark.createDataFrame([(0, 1), (5, 0), (None, 1), (6, None), (7, 0), (7, 1)], "doc_id long, quality int")
    field = line_crf.train(documents(spark), labels)
    scored = line_crf.with_scores(documents(spark), field, score="score")
    assert scored.count() == len(ROWS) and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert scored.where("doc_id IN (2, 3, 4) AND score <> 0").count() == 0
    assert line_crf.train(documents(spark), labels.limit(0)) == 0.5
    assert line_crf.with_scores(no_documents(spark), 0.5).count() == 0


# --- pages

PAGES = {
    "marked": (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><div class='ad'>Buy now</div>"
        "<article><h1>Head &amp; line</h1><p>First   para\n with <b>bold</b> text.</p><p>No.</p><aside>See also</aside><p>Last &eacute;.</p>"
        "<section class='comments'><p>I agree with this very long comment.</p></section></article><footer>(c) 2020</footer></body></html>",
        "Head & line\nFirst para with bold text.\nNo.\nLast é.",
    ),
    "cut off": ("<body><nav>Menu</nav><article><p>One<p>Two<script>var a='</p>';</script><p>Three", "One\nTwo\nThree"),
    "unmarked": (
        "<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div><p>" + "A long paragraph of the text itself. " * 5 + "</p><p>" + "Another one. " * 10
        + "</p></div><div><a href=3>Imprint</a></div><div id=footer>Copyright</div></body>",
        ("A long paragraph of the text itself. " * 5).strip() + "\n" + ("Another one. " * 10).strip(),
    ),
    "stray": ("<article><p>a < b and c > d &lt;p&gt;</p><!-- <p>no</p> --><p title='x>y'>e</p></article>", "a < b and c > d <p>\ne"),
    "none": ("", ""),
    "no markup": ("just words", "just words"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert line_blocks.main_text(page) == want


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in line_blocks.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        import html

        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_pages_on_awkward_tables(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>" + "long text " * 30_000, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, None, "<" * 2000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = by_row(line_blocks.extract_pages(pages), "page_id", "n_chars")
    assert got == [(None, 299_999), (1, 0), (2, 0), (2, 0), (3, 2000)]
    assert line_blocks.extract_pages(pages.limit(0)).count() == 0


# --- personal data

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    tests = [
        ("email", EMAIL, lambda v: True), ("ip", IP, lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", CARD, lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))), ("phone", PHONE, lambda v: 9 <= len(digits(v)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in tests for m in re.finditer(p, text or "") if ok(m[0])]


PII = [
    "write to a.b+c@mail.example.com_x@d.org or a@b.c.@e.f, not @x.y or a@b", "1.2.3.4.5.6.7.8 and 300.1.1.1 and 01.002.0003.255 and 9.9.9",
    "card 4539 1488 0343 6467 and 4539-1488-0343-6467, 4539  1488 0343 6467, 4539 1488 0343 6468", "call +1 (415) 555-2671 or +44.20.7946.0958- or +12 or (415) 555-2671",
    "é日\U0001f600 x@y.zz \U0001f600 +49 30 1234567", " ab 45391488 c@d.efg", "1" * 20_000, "1 " * 20_000, "a." * 20_000 + "@b.c", "a@" + "b." * 20_000 + "c",
    "%.@x-.-y", "a@b.c@d.e", "5 5-5 5 5 5-5 5 5 5 5 5-5 5", "", None, "name (at) host [dot] org", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "12.34.56.78.90", "-@-.-",
]


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    got = {r["doc_id"]: (r["b"], r["s"]) for r in boosted_pii.find_personal_data(docs).select(
        "doc_id", boosted_pii.span_text(F.col("base")).alias("b"), boosted_pii.span_text(F.concat("base", "added")).alias("s")).collect()}
    for k, text in enumerate(PII):
        assert got[k][0] == ",".join(brute_spans(text)), text
        assert set(brute_spans(text)) <= set(got[k][1].split(","))


def test_base_spans_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = boosted_pii.find_personal_data(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = found.select("doc_id", boosted_pii.span_text(F.col("base")).alias("b"), F.sha2(boosted_pii.span_text(F.col("base")).cast("binary"), 256).alias("h")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ",".join(brute_spans(texts[r["doc_id"]]))
        assert (r["b"], r["h"]) == (want, hashlib.sha256(want.encode()).hexdigest())


def test_trees_add_what_looks_alike(spark):
    rows = [(k, f"Please call our office by phone at +1 (415) 555-{1000 + k} today.") for k in range(300)]
    rows += [(300 + k, f"The order of {k + 1000000} pieces and {k} boxes came in.") for k in range(300)]
    rows += [(600 + k, f"Write to us by mail at person{k}@example.org or knock.") for k in range(200)]
    rows += [(800 + k, f"The event of 12-04-{1900 + k} drew {k} people.") for k in range(100)]
    loose = [(1000 + k, f"Please call our office by phone at 1 (415) 555-{4000 + k} today.") for k in range(5)]
    loose += [(2000 + k, f"Write to us by mail at other{k} (at) example (dot) org or knock.") for k in range(5)]
    docs = spark.createDataFrame(rows + loose, "doc_id long, text string")
    added = {r["doc_id"]: r["added"] for r in boosted_pii.find_personal_data(docs).select("doc_id", "added").collect()}
    assert all(not a for k, a in added.items() if k < 1000)
    assert set(added) == {k for k, _ in rows + loose}
    for k, text in loose:
        assert [text[x["b"] : x["e"]].strip() for x in added[k]] == [re.search(r"1 \(415\) [0-9-]+|other[0-9] \(at\) example \(dot\) org", text)[0]]


def test_disproved_candidates_are_never_added(spark):
    docs = spark.createDataFrame([(k, f"card 4539 1488 0343 646{k % 10} host 300.1.{k}.1 tel +44 20 7946 0{100 + k}") for k in range(60)], "doc_id long, text string")
    found = boosted_pii.scan(docs).select(F.explode("found").alias("x")).select("x.*").withColumn("label", boosted_pii.evidence())
    labels = {(r["kind"], r["v"], r["label"]) for r in found.collect()}
    cards = {v: label for kind, v, label in labels if kind == "card"}
    assert len(cards) == 10 and all(label == float(luhn(re.sub("[^0-9]", "", v))) for v, label in cards.items())
    assert ("ip", "300.1.7.1", 0.0) in labels and ("phone", "+44 20 7946 0100", 1.0) in labels


def test_contexts_and_overlaps(spark):
    text = "é" * 505 + " a@b.cc " + "x" * 700 + " +49 30 1234567"
    found = boosted_pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.explode("found").alias("x")).select("x.*").collect()
    assert {(r["kind"], r["v"]) for r in found} == {("email", "a@b.cc"), ("phone", "+49 30 1234567")}
    for r in found:
        b, e = r["b"], r["e"]
        assert (r["v"], r["left"], r["right"]) == (text[b:e], text[max(b - 32, 0) : b], text[e : e + 32])
    rng = np.random.default_rng(4)
    tables = [[sorted({(int(b), int(b + 1 + rng.integers(0, 9))) for b in rng.integers(0, 400, n)}) for n in (60, m)] for m in (0, 1, 20, 700)]
    spans = spark.createDataFrame([(k, a, o) for k, (a, o) in enumerate(tables)], "k int, a array<struct<b:bigint,e:bigint>>, o array<struct<b:bigint,e:bigint>>")
    for r in spans.select("k", boosted_pii._touching(F.col("a"), F.col("o")).alias("hit")).collect():
        a, o = tables[r["k"]]
        assert r["hit"] == [any(b < y and x < e for x, y in o) for b, e in a]


def test_a_text_of_many_spans(spark):
    """50,000 spans in one text, far under what a pass over all spans for each would take."""
    text = "".join(f"u{k}@ex.org 10.0.{k % 256}.{k % 200}\n" for k in range(25_000))
    docs = spark.createDataFrame([(1, text), (2, "order 1234567 pieces")], "doc_id long, text string")
    begun = time.perf_counter()
    assert boosted_pii.scan(docs).select(F.size("base").alias("n")).agg(F.sum("n")).first()[0] == 50_000
    assert time.perf_counter() - begun < 30
    found = boosted_pii.find_personal_data(docs)
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", boosted_pii.span_text(F.col("base")).alias("s")).collect()}
    assert got[1] == ",".join(brute_spans(text)) and got[2] == ""
    clean = {r["doc_id"]: r["text"] for r in boosted_pii.redact(docs, found).collect()}
    assert clean[1] == "[email] [ip]\n" * 25_000


def test_personal_data_on_awkward_tables(spark):
    found = boosted_pii.find_personal_data(documents(spark))
    assert by_row(found, "doc_id") == by_row(documents(spark), "doc_id")
    assert found.where("size(base) + size(added) > 0").count() == 0
    assert boosted_pii.find_personal_data(no_documents(spark)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é x@y.zz, 1.2.3.4!", "z"), (2, None, "z"), (3, "plain", "z")], "doc_id long, text string, base string")
    out = {r["doc_id"]: r["text"] for r in boosted_pii.redact(docs, boosted_pii.find_personal_data(docs)).collect()}
    assert out == {1: "é [email], [ip]!", 2: None, 3: "plain"}


# --- divergence


def test_divergence_finds_strange_texts(spark):
    judged = {r["doc_id"]: r for r in divergence.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = ([judged[r["doc_id"]] for r in labels if r["quality"] == q] for q in (1, 0))
    fine = [r for r in good if not r["base_failed"]]
    assert sum(r["kept"] for r in fine) >= 0.99 * len(fine)
    assert sum(not r["kept"] for r in bad) >= 0.7 * len(bad)


def test_divergence_on_awkward_tables(spark):
    judged = divergence.judge(documents(spark))
    assert judged.count() == len(ROWS)
    rows = by_row(judged, "doc_id", "n_words", "n_repeat_words", "kept")
    assert (2, 0, 0, False) in rows and (3, 0, 0, False) in rows and (4, 0, 0, False) in rows and (5, 48_000, 48_000, False) in rows
    assert rows.count((1, 29, 0, True)) == 2
    assert divergence.judge(no_documents(spark)).count() == 0
