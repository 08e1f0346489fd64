"""Decontamination, mixing, licence scan and token counts against brute force and on awkward tables."""

import random
import textwrap

import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from swardshift.llm import bpe_count, decontaminate, license_scan, queries, raking

from .odd import ROWS, by_row, documents, no_documents

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (3, None), (None, "alpha beta"), (4, "Rivers"), (4, "gamma delta alpha")]


def brute_found(text, items, width=13):
    words = decontaminate.item_words(text)
    hit, named = set(), set()
    for item, body in items:
        own = decontaminate.item_words(body)
        size = min(width, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit.update(range(at, at + size))
                    named.update(() if item is None else (str(item),))
    return len(words), len(hit), decontaminate.digest(list(named))


@pytest.mark.parametrize("block_words", [1_000_000, 3])
def test_occurrences(spark, block_words):
    rng = random.Random(3)
    vocabulary = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen short item rivers gamma delta alpha".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["x " + ITEMS[0][1].upper() + " y", "ONE-two.three" + " z" * 20, "short  ITEM", "shortitem", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items_sha256"]) for r in decontaminate.judge(decontaminate.find_occurrences(docs, items, block_words=block_words)).collect()}
    assert got == {k: brute_found(t, ITEMS) for k, t in enumerate(texts)}


def test_occurrences_on_awkward_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_words", F.lit(0))
    found = decontaminate.find_occurrences(documents(spark), items)
    assert found.count() == len(ROWS)
    judged = {r["doc_id"]: r for r in decontaminate.judge(found).collect()}
    assert judged[2]["n_words"] == 0 and not judged[2]["contaminated"]
    assert judged[5]["n_words"] == 48_000 and judged[5]["n_hit"] == 48_000 - 2  # the item without an id hits too
    assert decontaminate.find_occurrences(no_documents(spark), items).count() == 0
    none = decontaminate.judge(decontaminate.find_occurrences(documents(spark), items.limit(0)))
    assert none.where("n_hit > 0").count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randint(1, 40), rng.choice("aaab"), rng.choice("xy")) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    target = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double")}
    mixed = raking.mix_documents(docs, {"source": F.col("source"), "lang": F.col("lang")}, targets=target, sweeps=20, keep_share=0.4).toPandas()
    expected = (mixed.n_tokens * mixed.probability).groupby(mixed.source).sum()
    assert abs(expected["a"] / expected.sum() - 0.5) < 1e-6
    assert mixed.probability.max() <= 1 and mixed.kept.sum() > 1000
    kept = mixed[mixed.kept]
    share = kept.n_tokens[kept.source == "a"].sum() / kept.n_tokens.sum()
    assert abs(share - 0.5) < 0.05


def test_mix_keeps_its_share_beside_a_tiny_source(spark):
    """A source with one short document does not set the rate of the others; what it lacks, they give."""
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(50, 90), "hot" if k % 3 else rng.choice("bcde"), "x") for k in range(6000)] + [(9999, "one two", "tiny", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    margins = {"source": F.col("source"), "lang": F.col("lang")}
    mixed = raking.mix_documents(docs, margins).toPandas()
    total = mixed.n_tokens.sum()
    assert abs((mixed.n_tokens * mixed.probability).sum() / total - 0.5) < 1e-6
    assert mixed.probability[mixed.source == "tiny"].item() == 1.0
    expected = (mixed.n_tokens * mixed.probability).groupby(mixed.source).sum()
    tokens = mixed.groupby("source").n_tokens.sum()
    even = [expected[s] / tokens[s] ** 0.5 for s in "bcde" if mixed.probability[mixed.source == s].max() < 1]
    assert max(even, default=1) - min(even, default=1) < 1e-3 * max(even, default=1)
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 500), ("b", "y", 10)], "source string, lang string, tokens long")
    report = raking.margin_report(raking.rake_cells(cells, ["source", "lang"], sweeps=40), ["source", "lang"]).collect()
    assert len(report) == 4 and all(abs(r.target - r.expected) < 0.01 * r.target for r in report)


def test_mix_on_awkward_tables(spark):
    margins = queries.mixing_margins()
    mixed = raking.mix_documents(documents(spark), margins, sweeps=3)
    assert mixed.count() == len(ROWS) and mixed.where("probability IS NULL").count() == 0
    sampled = raking.sample_documents(documents(spark), margins, sweeps=3)
    assert set(documents(spark).columns) < set(sampled.columns)
    draws = {r["doc_id"]: r["kept"] for r in mixed.collect()}
    assert sampled.where("doc_id = 1").count() == (2 if draws[1] else 0)
    assert raking.mix_documents(no_documents(spark), margins, sweeps=2).count() == 0


def brute_license(block):
    plain = len(zstandard.ZstdCompressor(level=6, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block.encode()))
    sizes = []
    for name, (_, text) in license_scan.TEMPLATES.items():
        own = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes.append((len(zstandard.ZstdCompressor(level=6, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block.encode())), name))
    return plain, sorted(sizes)


def test_licenses(spark):
    mit = license_scan.TEMPLATES["mit-text"][1]
    near = mit.replace("free of charge", "free of any charge")
    texts = [
        "Some prose.\nReleased under the MIT License.\nMore prose.", "Copyright (c) 2020 Somebody\n\n" + near.replace(". ", ".\n"),
        "The license to print money is not a licence text at all, says the author.", "Licensed under CC BY-NC 4.0.", "", None, "no cue here",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert {k: r["license"] for k, r in got.items()} == {0: "MIT", 1: "MIT", 3: "CC-BY-NC-4.0"}
    assert (got[0]["n_missing"], got[0]["n_added"]) == (0, 0) and got[1]["n_added"] >= 1
    for r in got.values():
        lines = texts[r["doc_id"]].split("\n")
        plain, sizes = brute_license("\n".join(lines[r["first_line"] : r["last_line"] + 1]))
        assert (plain, r["template"]) == (r["bytes_alone"], next(n for s, n in sizes if license_scan.TEMPLATES[n][0] == r["license"]))


def test_licenses_as_they_are_written(spark):
    """Wrapped, commented, short and changed texts; names and versions that are other licences."""
    t = {k: text for k, (_, text) in license_scan.TEMPLATES.items()}
    wrap = lambda text, sign="": "\n".join(textwrap.wrap(text, 78, initial_indent=sign, subsequent_indent=sign))
    bsd3 = t["bsd-3-text"].replace("{}", "the University of Somewhere")
    prose = "\n".join(f"line {k} of some plain prose that has nothing to do with it" for k in range(60))
    cases = [
        ("All rights reserved.", ["Proprietary"]), ("Copyright (c) 2020 X. All rights reserved.", ["Proprietary"]),
        ("Copyright 2019-2021 The Long Name of a Holder, Inc.\nAll rights\nreserved", ["Proprietary"]), ("Some rights reserved.", []),
        ("MIT License\n\nCopyright (c) 2020 X\n\n" + wrap(t["mit-text"]), ["MIT"]),
        (prose + "\n" + wrap(t["gpl-3.0-header"], "# ") + "\n" + prose, ["GPL-3.0"]),
        (wrap(t["gpl-3.0-header"].replace("GNU General", "GNU Lesser General")), []), (wrap(t["gpl-3.0-header"].replace("version 3", "version 2")), []),
        (wrap(t["apache-2.0-header"], " * "), ["Apache-2.0"]), (t["mit-text"].upper(), ["MIT"]),
        (wrap(bsd3), ["BSD-3-Clause"]), (wrap(t["bsd-2-text"]), ["BSD-2-Clause"]),
        ("This is released under an MIT License, see below.", ["MIT"]), ("Unlike the MIT License it says more.", []),
        ("Licensed under CC BY-ND 4.0.", []), ("Licensed under CC BY 3.0.", []), ("Licensed under the Apache License, Version 1.1.", []),
        (" ".join(["word"] * 3000) + " Licensed under CC BY-SA 4.0. " + " ".join(["word"] * 3000), ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY 4.0.\nReleased under the MIT License.\nAll rights reserved.", ["CC-BY-4.0", "MIT", "Proprietary"]),
    ]
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "doc_id long, text string")
    got = {k: [] for k in range(len(cases))}
    for r in license_scan.scan_licenses(docs).orderBy("doc_id", "first_line").collect():
        got[r["doc_id"]].append(r["license"])
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_licenses_on_awkward_tables(spark):
    assert license_scan.scan_licenses(documents(spark)).count() == 0
    assert license_scan.scan_licenses(no_documents(spark)).count() == 0
    twice = documents(spark).withColumn("text", F.lit("Released under the MIT License."))
    assert license_scan.scan_licenses(twice).count() == len(ROWS)


def test_token_counts_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = ["", " ", "  ", "a  b", "▁a", "a▁b", "\x00a", "a ", "日本語", "\U0001f600", "ＡＢ", "\r\n", "<s> </s> <0x09> <unk>", "a" * 3000, " " * 100 + "x", "\t\tif (x)  {\r\n }"]
    extra = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(texts)], docs.schema)
    both = docs.union(extra)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in both.collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in bpe_count.count_tokens(both, queries.piece_model()).collect()}
    assert got == want


def test_token_counts_on_awkward_tables(spark):
    counted = bpe_count.count_tokens(documents(spark), queries.piece_model())
    rows = by_row(counted, "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert len(rows) == len(ROWS) and (2, 0, 0, False) in rows and (3, 0, 0, False) in rows and (None, 0, 0, False) in rows
    assert [r[3] for r in rows if r[0] == 5] == [True]
    assert bpe_count.count_tokens(no_documents(spark), queries.piece_model()).count() == 0
