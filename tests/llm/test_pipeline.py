import corpus_pipeline
from test_host_rules import brute as measure
from test_jaccard_groups import brute as components
from test_line_windows import brute as dedup

from opinara.llm import templates


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [f" {' '.join(templates.words_of(r.text))} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "best_fit_packing"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and all(r.n_chars == len(r.text) for r in rows)
        if name == "quality_rules":
            expected = {i: t for i, t in before.items() if (m := measure(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
        elif name == "line_dedup":
            expected = {i: t for i, (t, n) in dedup(list(before.items())).items() if t or not n}
        elif name == "near_duplicates":
            expected = {i: before[i] for i in {c for _, c in components(list(before.items()), 5, 80).values()}}
        else:
            expected = {i: t for i, t in before.items() if not any(x in f" {' '.join(templates.words_of(t))} " for x in items)}
        assert after == expected
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(before)


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
