import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.common import awkward, empty
from tests.llm.test_nearcopies import brute_least
from tests.llm.test_packing import check, reference_ids
from tests.llm.test_quality import brute

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_by_brute_force(spark):
    from shoplake.llm.queries import op5_toxic_segments
    from shoplake.llm.store import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in op5_toxic_segments(spark, SF).filter("predicted = 1").collect()}
    seen = [docs]
    for name, stage in cp.STAGES[:-1]:
        seen.append(written(stage(spark, seen[-1], SF), "test"))
        assert seen[-1].columns == COLUMNS
    ids = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in seen]
    assert set(ids[1]) == set(ids[0]) - toxic and toxic
    assert all(brute(t)[-1] for d, t in ids[1].items() if d not in ids[2] and len(t) < 40)
    assert not any(brute(t)[-1] for t in ids[2].values())
    # One document of each group of 5-word Jaccard similarity of 0.8 or more.
    comp = dict(zip(ids[2], brute_least(list(ids[2].values()))))
    assert len(ids[3]) == len(set(comp.values())) < len(ids[2]) and {comp[d] for d in ids[3]} == set(comp.values())
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(ids[4]) == {d for d, t in ids[3].items() if not any(i in flat(t) for i in items)}
    got = cp.STAGES[-1][1](spark, seen[-1], SF).toPandas()
    check(got, dict(zip(ids[4], reference_ids(list(ids[4].values())))), 2048)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_awkward_and_empty(spark, name, stage, tmp_path):
    for i, make in enumerate((awkward, empty)):
        path = str(tmp_path / f"docs{i}")
        make(spark).withColumns({"row_place": F.lit(1), "kept": F.lit("clash"), "whole_row": F.lit(2)}).write.parquet(path)
        got = stage(spark, spark.read.parquet(path), SF)
        rows = got.collect()
        if name != "packing":
            assert set(COLUMNS) <= set(got.columns)
        if make is empty:
            assert rows == []


def test_session_is_left_as_it_was(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    path = str(tmp_path / "docs")
    awkward(spark).write.parquet(path)
    for _, stage in cp.STAGES:
        stage(spark, spark.read.parquet(path), SF)
        assert spark.conf.get(name) == before
