"""The pipeline against its stages done by brute force, and the registered names."""

import re

import __spark_entry__ as entry_points
import corpus_pipeline
import pytest

from tests.llm.test_operators import near_brute


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, sf)
        assert done.columns == docs.columns
        out.append((docs.collect(), done.collect()))
        docs = spark.createDataFrame(out[-1][1], docs.schema)
    return out


def test_quality_stage_drops_what_the_rules_reject(spark, sf, steps):
    verdict = {r.doc_id: r.kept for r in entry_points.queries()["op2_quality_rules"](spark, sf).collect()}
    before, after = steps[0]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if verdict[r.doc_id]}


def test_exact_stage_keeps_the_largest_id(steps):
    before, after = steps[1]
    last = {}
    for r in sorted(before):
        last[r.text] = r.doc_id
    assert {r.doc_id for r in after} == set(last.values())


def test_near_stage_keeps_the_smallest_id(steps):
    before, after = sorted(steps[2][0]), steps[2][1]
    _, roots = near_brute([r.text for r in before], 5, 80)
    assert {r.doc_id for r in after} == {r.doc_id for k, r in enumerate(before) if roots[k] == k}


def test_mixing_stage_samples(steps):
    before, after = steps[3]
    assert set(after) <= set(before) and 0 < len(after) < len(before)


def test_pipeline_ends_in_ids(spark, sf, steps):
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in steps[3][1]} and all(r.ids for r in got)


def test_names():
    names = [n for n in entry_points.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert len(names) == 14 and set(entry_points.oracle_sql()) <= set(entry_points.queries())
