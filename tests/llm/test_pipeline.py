"""The pipeline's stages by what they promise, and the whole run."""

import re
from collections import Counter

import corpus_pipeline
from girderlake.llm import minhash_star, quality_lines, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r["doc_id"]: r for r in docs.collect()}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows = docs.collect()
        if i < 4:
            seen.append({r["doc_id"]: r for r in rows})
            assert len(rows) == len(seen[-1])
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
    for before, after in zip(seen, seen[1:]):
        assert set(after) <= set(before)
    judged = {r["doc_id"]: r for r in queries.op2_quality_lines(spark, SF).collect()}
    assert set(seen[1]) == {i for i, r in judged.items() if r["kept"]}
    assert all(seen[1][i]["text"] == seen[0][i]["text"] for i in seen[1] if not judged[i]["removed_words"])
    assert set(seen[3]) == set(seen[4])
    width, windows = 20, Counter()
    for _, r in sorted(seen[3].items()):
        w = re.findall("[^\x20\x09-\x0d]+", r["text"])
        fresh = [tuple(w[j : j + width]) for j in range(len(w) - width + 1)]
        if not any(windows[x] for x in fresh) and len(set(fresh)) == len(fresh):
            assert seen[4][r["doc_id"]]["text"] == r["text"]
        windows.update(fresh)
    assert {r["doc_id"] for r in rows} == set(seen[4])


def test_language_stage_without_labels(spark):
    texts = ["ein Satz", "a sentence", "", None, "1 2 3", "\u00e9"]
    docs = spark.createDataFrame([(i, t, None, "h", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.language(spark, docs, SF).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {i: texts[i] for i in (0, 1, 5)}


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, SF).count() >= 100
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


ODD = "doc_id long, text string, lang string, source string, n_chars long, _drop string, _key long, _row int, doc long, part int"


def odd_rows(spark):
    line = " ".join(f"w{i}x" for i in range(30))
    long = " ".join(f"v{i % 977}y{i % 13}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, line), (4, line), (5, line + " more"), (None, "z" + line), (6, long), (6, line[:60]), (7, "é" * 400)]
    return spark.createDataFrame([(i, t, "en" if i != 5 else None, None if i == 4 else "h", 0, "a", 1, 2, 3, 4) for i, t in texts], ODD)


def test_stages_on_odd_and_empty_tables(spark):
    """Null, empty and very long texts, repeated rows, null ids and hosts, and columns of any name: no stage fails or invents rows."""
    docs, known = odd_rows(spark), {r["text"] for r in odd_rows(spark).select("text").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, None)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        rows = out.collect()
        assert len(rows) <= docs.count()
        if name != "substring dedup":
            assert {r["text"] for r in rows} <= known
        assert stage(spark, docs.limit(0), None).count() == 0
    near = corpus_pipeline.near_dedup(spark, docs, None).collect()
    assert sorted(r["doc_id"] or 0 for r in near) == [1, 2, 3, 4, 6, 6, 7]  # 5 and the one without id are near copies of 4, which stays once
    cut = {(r["doc_id"], r["text"]) for r in corpus_pipeline.substring_dedup(spark, docs, None).collect()}
    assert (5, "more") in cut and (4, " ".join(f"w{i}x" for i in range(30))) in cut
    packed = corpus_pipeline.packing(spark, docs, None)
    assert packed.where("piece = 0").count() == docs.count()
    assert corpus_pipeline.packing(spark, docs.limit(0), None).count() == 0


def test_clean_keeps_columns_of_any_name(spark):
    docs = odd_rows(spark)
    assert quality_lines.clean(docs).columns == docs.columns
    assert minhash_star.one_of_each(docs).columns == docs.columns
