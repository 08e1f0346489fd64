"""The pipeline's stages, one by one, against plain versions of them."""

from pyspark.sql import functions as F

import corpus_pipeline
from swardshift.llm import decontaminate, line_neighbours, lsh_forest, queries

from .odd import PROSE, documents, no_documents

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if k < 4:
            assert docs.columns == columns
        if name == "quality classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [d for d in before if labels.get(d) == 1]
            assert sum(d in after for d in good) >= 0.97 * len(good)
            assert sum(labels.get(d) == 0 for d in after) <= 0.2 * sum(q == 0 for q in labels.values())
        if name == "line dedup":
            rows = sorted((d, r["text"]) for d, r in before.items())
            seen, copies, want = [], set(), {}
            for d, text in rows:
                left = []
                for n, line in enumerate((text or "").split("\n")):
                    body = line.strip(" \t\n\v\f\r")
                    if body:
                        long = len(body) >= line_neighbours.LEAST_CHARS
                        dup = body in copies or (long and any(line_neighbours.within_one_edit(body, s) for s in seen))
                        copies.add(body)
                        seen += [body] * long
                        if dup:
                            continue
                    left.append(line)
                want[d] = "\n".join(left)
            assert {d: r["text"] for d, r in after.items()} == {d: t for d, t in want.items() if t.strip() or not (before[d]["text"] or "").strip()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "MinHash near-dedup":
            found = lsh_forest.near_duplicates(spark.createDataFrame([(d, r["text"]) for d, r in before.items()], "doc_id long, text string"), percent=80)
            assert set(after) == {r["doc_id"] for r in found.where("kept").collect()}
        if name == "benchmark decontamination":
            searches = decontaminate.build_searches([(k, t) for k, (_, t) in enumerate(items)], 13)
            grams = {g for s in searches for g in s.words}
            for d, r in before.items():
                words = decontaminate.item_words(r["text"])
                hit = {p for n in {len(g) for g in grams} for at in range(len(words) - n + 1) if tuple(words[at : at + n]) in grams for p in range(at, at + n)}
                assert (d in after) == (not hit or 20 * len(hit) < len(words))
        if name.startswith("mixing"):
            draws = {r["doc_id"]: r["kept"] for r in queries.raking.mix_documents(spark.createDataFrame(list(before.values()), docs.drop("keep_probability").schema), queries.mixing_margins()).collect()}
            assert set(after) == {d for d, kept in draws.items() if kept}
            assert "keep_probability" in docs.columns
            words = {d: len((r["text"] or "").split()) for d, r in before.items()}
            assert abs(sum(words[d] for d in after) / sum(words.values()) - queries.KEEP_SHARE) < 0.1


def test_stages_on_awkward_tables(spark):
    for make in (documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            docs = make(spark)
            out = stage(spark, docs, SF)
            assert set(docs.columns) <= set(out.columns), name
            rows = out.collect()
            assert len(rows) <= docs.count(), name
            if name == "MinHash near-dedup" and rows:
                # Of the copies of one text that with id 0 stays; texts without words are nobody's copies.
                assert sorted((r["doc_id"] for r in rows if r["text"] == PROSE)) == [0]
                assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [0, 2, 3, 4, 5, 6, 7]


def test_rows_with_missing_and_repeated_ids(spark):
    """Different texts under one id, or under none, are documents of their own: only what repeats goes."""
    passage = " ".join(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect())
    clean = ["The mill stands by the river, and nobody has worked there since the spring floods came.", "A letter from the north arrived with news of snow and of the long road to the coast.",
             "Three boats left the harbour before dawn and came back with nothing but wet nets aboard."]
    rows = [(own, f"{text}\nOnly in {own}: {text[::-1]}\nThis line is repeated in every single document here.", "en", "a", 1) for own in (7, None) for k, text in enumerate(clean)]
    rows += [(own, passage, "en", "a", 1) for own in (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = {n: f for n, f in corpus_pipeline.STAGES}
    cleaned = [r["text"] for r in stages["line dedup"](spark, docs, SF).collect()]
    assert sum("This line is repeated" in t for t in cleaned) == 1
    assert all(sum(f"Only in {own}: {text[::-1]}" in t for t in cleaned) == 1 for own in (7, None) for text in clean)
    assert all(sum(text in t for t in cleaned) == 1 for text in clean)
    left = stages["benchmark decontamination"](spark, docs, SF).collect()
    assert sorted(map(str, (r["text"] for r in left))) == sorted(r[1] for r in rows if r[1] != passage)
    left = [(r["doc_id"], r["text"]) for r in stages["MinHash near-dedup"](spark, docs, SF).collect()]
    assert (7, passage) in left and (None, passage) not in left and len(left) == 7


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op") and k[2].isdigit()}
    assert corpus_pipeline.run(spark, SF).where(F.col("keep_probability") > 1).count() == 0
