import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from test_near_texts import components_of, linked  # noqa: E402

import corpus_pipeline  # noqa: E402
from gridloom.llm.decontamination import overlaps  # noqa: E402
from gridloom.llm.quality_rules import robust_outliers  # noqa: E402
from gridloom.llm.tables import written  # noqa: E402

D = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, D), name)
        assert after.columns == docs.columns
        before_ids, after_ids = {r.doc_id for r in docs.select("doc_id").collect()}, [r.doc_id for r in after.select("doc_id").collect()]
        assert len(after_ids) == len(set(after_ids)) and set(after_ids) <= before_ids
        kept[name] = set(after_ids)
        if name == "quality_rules":
            assert kept[name] == {r.doc_id for r in robust_outliers(docs).filter("kept").collect()}
        if name == "simhash_near_dedup":
            items = [(r.doc_id, r.text) for r in docs.collect()]
            groups = components_of([i for i, _ in items], linked(items))
            left = [groups[i] for i in kept[name]]
            assert len(left) == len(set(left)) and set(left) == set(groups.values())
        if name == "benchmark_decontamination":
            bad = {r.doc_id for r in overlaps(docs, spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
            assert kept[name] == before_ids - bad
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert {r.doc_id for r in last} == kept["benchmark_decontamination"] and all(r.round_trip and len(r.ids) == r.n_pieces for r in last)


def test_odd_rows(spark):
    text = " ".join(f"word{k} other{k % 7}" for k in range(40))
    rows = [(1, text, "en", "a", 5, "q"), (1, text, "en", "a", 5, "q"), (None, text + " tail", None, None, None, None), (2, None, "en", "a", 0, "x"), (3, "", None, "b", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        got = out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        assert len(got) == {"quality_rules": 3, "toxicity": 5, "simhash_near_dedup": len(got), "benchmark_decontamination": 5, "sentencepiece": 5}[name]
        if name == "simhash_near_dedup":
            assert 2 <= len(got) <= 3
        assert stage(spark, docs.limit(0), D).count() == 0
