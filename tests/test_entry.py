import pathlib
import re
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["n_queries"] >= rows[-1]["n_queries"]


@pytest.mark.parametrize(
    "name", ["a20_majority_vote", "e6_execution_scores", "e17_bleu", "j7_overlap_top5", "j8_owning_database", "t4_table_suggestions", "a30_cluster_terms"]
)
def test_plans_make_no_pairs(spark, sf, name):
    """No nested loop, no product, no window without the early rank filter."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    if re.search(r"\bWindow \[", plan):
        assert "WindowGroupLimit" in plan


def test_bleu_shuffles_texts_once(spark, sf):
    from quarrylog import inputs
    from quarrylog.operators import nl_scores

    pairs = inputs.nl_pairs(spark, sf)
    before = pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    plan = nl_scores.bleu(pairs, ["conv_id", "turn"], "reference", "generated")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == before + 1


def test_bleu_makes_no_row_per_gram(spark):
    """Each pair is one row of text until it is scored; pairs of one key count together, null texts are empty."""
    from quarrylog.operators import nl_scores

    rows = [(1, None, "a b c d", "a b"), (1, None, "a b", "c d e a b"), (None, 2, "x y z w", "x y z w"), (None, None, None, "a"), (3, 3, "a", None), (4, 4, None, None)]
    frame = spark.createDataFrame([*rows, *[(k, 0, "p q r s t", "p q r s") for k in range(10, 300)]], "i int, j int, r string, g string")
    scores = nl_scores.bleu(frame, ["i", "j"], "r", "g")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r["i"], r["j"]): r["bleu"] for r in scores.collect()}
    assert len(got) == 295 and got[(None, 2)] == 1.0 and got[(None, None)] == got[(3, 3)] == got[(4, 4)] == 0.0
    # Words 6 of 7, pairs 3 of 5, no triple of "c d e", "d e a" or "e a b" in the references.
    assert got[(1, None)] == 0.0
    smooth = {(r["i"], r["j"]): r["bleu"] for r in nl_scores.bleu(frame, ["i", "j"], "r", "g", smooth=True).collect()}
    assert abs(smooth[(1, None)] - (6 / 7 * 3 / 5 * 0.1 / 3 * 0.1 / 2) ** 0.25) < 1e-12


def test_filters_and_columns_reach_the_scan(spark, sf):
    import __spark_entry__

    plan = __spark_entry__.queries()["p17_result_slice"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(event_type,purchase)" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


def test_no_local_checkpoint_or_collect_in_operators():
    for path in (ROOT / "quarrylog" / "operators").glob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".collect()" not in text and "crossJoin" not in text, path
