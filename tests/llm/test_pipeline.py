"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline

rng = random.Random(9)


def prose(n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_planted_cases(spark, tmp_path):
    passage, item, body = prose(80), prose(40), prose(200)
    clean = [prose(150) for _ in range(12)]
    near = body.split()
    near[7] = "changed"
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(clean)]
    rows += [(50, body, "en", "s", 1), (51, body, None, None, None), (52, " ".join(near), "en", "s", 1)]
    rows += [(60, f"{prose(100)} {passage}", "en", "s", 1), (61, f"{passage} {prose(100)}", "en", "s", 1)]
    rows += [(70, f"{prose(60)} {item} {prose(60)}", "en", "s", 1), (80, None, "en", "s", 0), (81, "12 !", "en", "s", 1), (None, prose(90), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(12), 50, 60, 61, None}
    assert out[61].n_tokens < out[60].n_tokens

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()}
    assert len(cut[61].text.split()) == 100 and cut[61].n_chars == len(cut[61].text) and cut[60].text == rows[15][1]
