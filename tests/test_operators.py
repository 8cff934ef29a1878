import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrylog import inputs
from quarrylog.functions import sqltext
from quarrylog.operators import catalog_match, clustering, joins, log_context, results, sampling, sequence, similarity, votes


def result_frame(spark, rows):
    return spark.createDataFrame(rows, "query_id long, side string, values array<string>")


def brute_assign(w):
    n, m = len(w), len(w[0])
    return min(itertools.permutations(range(m), n), key=lambda p: (-sum(w[i][j] for i, j in enumerate(p)), p))


def test_assignment_against_all_permutations():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 4)
        m = rng.randint(n, 5)
        w = [[rng.randint(0, 3) for _ in range(m)] for _ in range(n)]
        assert tuple(results.assign(w)) == brute_assign(w)


def brute_accuracy(rows):
    """Entry and output accuracy of one query from plain sets."""
    gold = {tuple(v) for _, s, v in rows if s == "gold"}
    pred = {tuple(v) for _, s, v in rows if s == "pred"}
    if not gold or not pred:
        return 0.0, 0.0
    small, wide = (gold, pred) if len(next(iter(gold))) < len(next(iter(pred))) else (pred, gold)
    n, m = len(next(iter(small))), len(next(iter(wide)))
    w = [[len({r[i] for r in small} & {r[j] for r in wide}) for j in range(m)] for i in range(n)]
    match = brute_assign(w)
    ea = sum(w[i][j] for i, j in enumerate(match)) * 100 / (len(gold) * n)
    cut = {tuple(r[j] for j in match) for r in wide}
    return ea, len(small & cut) * 100 / len(gold)


def test_accuracies_against_plain_sets(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for q in range(25):
        own = []
        for side in ("gold", "pred"):
            width = rng.randint(1, 3)
            for _ in range(rng.randint(0, 6)):
                own.append((q, side, [rng.choice(["a", "b", "c", None]) for _ in range(width)]))
        if own:
            rows += own
            want[q] = brute_accuracy(own)
    frame = result_frame(spark, rows)
    got = {r["query_id"]: (r["entry_accuracy"], r["output_accuracy"]) for r in results.entry_and_output_accuracy(frame).collect()}
    assert got.keys() == want.keys()
    for q, pair in want.items():
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[q], pair)), q
    # Row order, repeated rows and the order of a query's columns change nothing.
    again = [(q, s, list(v)) for q, s, v in rows] + rows[:5]
    rng.shuffle(again)
    repeat = {r["query_id"]: (r["entry_accuracy"], r["output_accuracy"]) for r in results.entry_and_output_accuracy(result_frame(spark, again)).collect()}
    assert repeat == got


def test_accuracies_of_the_fixture(spark, sf):
    rows = inputs.result_rows(spark, sf).select("query_id", "side", F.array("c0", "c1", "c2").alias("values"))
    means = results.entry_and_output_accuracy(rows).agg(F.avg("entry_accuracy"), F.avg("output_accuracy")).first()
    assert [round(x, 4) for x in means] == [30.4277, 73.8873]


def test_result_verdicts(spark):
    rows = [(1, "gold", ["5", "x"]), (1, "pred", ["5", "y"])]
    rows += [(2, "gold", [str(i)]) for i in range(3)] + [(2, "pred", [str(i)]) for i in (2, 1, 0)]
    rows += [(3, "gold", [str(i)]) for i in range(3)] + [(3, "pred", [str(i)]) for i in (0, 1, 7)]
    rows += [(4, "gold", [str(i % 6)]) for i in range(12)] + [(4, "pred", [str(i % 4)]) for i in range(12)]
    rows += [(5, "gold", [None])] * 11 + [(5, "pred", [None])] * 11
    rows += [(6, "gold", ["a"]), (6, "pred", ["a"]), (6, "pred", ["a"])]
    got = {r["query_id"]: r["correct"] for r in results.compare_results(result_frame(spark, rows)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_compare_results_with_several_golds(spark):
    rows = [(1, "gold", 0, ["a"]), (1, "gold", 1, ["b"]), (1, "pred", 0, ["b"])]  # the second gold matches
    rows += [(2, "gold", 0, ["a"]), (2, "gold", 0, ["b"]), (2, "gold", 1, ["b"]), (2, "pred", 0, ["a"]), (2, "pred", 0, ["c"])]
    rows += [(3, "gold", 0, ["a"])]  # the run failed
    rows += [(5, "gold", 1, ["a"])]  # the first gold is empty, and so is the prediction
    rows += [(6, "gold", 0, [str(i)]) for i in range(12)] + [(6, "gold", 1, [str(i % 6)]) for i in range(12)]
    rows += [(6, "pred", 0, [str(i % 6)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "query_id long, side string, gold_no int, values array<string>")
    asked = [(1, 2, False), (2, 2, False), (3, 1, True), (4, 1, False), (5, 2, False), (6, 2, False)]
    compared = results.compare_results(frame, spark.createDataFrame(asked, "query_id long, n_golds int, failed boolean"))
    sizes = {(r["query_id"], r["gold_no"]): (r["gold_size"], r["pred_size"], r["missing"], r["unequal"]) for r in compared.collect()}
    assert sizes == {
        (1, 0): (1, 1, 1, 2), (1, 1): (1, 1, 0, 0), (2, 0): (2, 2, 1, 2), (2, 1): (1, 2, 1, 3), (3, 0): (1, None, 1, 1),
        (4, 0): (0, 0, 0, 0), (5, 0): (0, 0, 0, 0), (5, 1): (1, 0, 1, 1), (6, 0): (12, 12, 6, 12), (6, 1): (12, 12, 0, 0),
    }
    best = {r["query_id"]: (r["same_size"], r["correct"], r["by_first_gold"]) for r in results.best_comparison(compared).collect()}
    assert best == {
        1: (True, True, False), 2: (True, False, False), 3: (False, False, False), 4: (True, True, True),
        5: (True, True, True), 6: (True, True, False),
    }
    report = results.size_report(compared).first()
    assert (report["total"], report["failed"], report["n_empty"], report["correct_empty"], report["correct_by_other_gold"]) == (6, 1, 2, 2, 2)


def test_error_percentage(spark):
    status = spark.createDataFrame([(1, None), (2, "timeout"), (3, None), (4, "no table")], "query_id long, error string")
    assert results.error_percentage(status).first()[0] == 50.0
    assert results.error_percentage(status.limit(0)).first()[0] is None


def test_execution_scores_drop_repeats(spark):
    rows = [(1, "gold", ["a"]), (1, "gold", ["a"]), (1, "pred", ["a"]), (2, "gold", ["b"])]
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r["query_id"]: r for r in results.execution_scores(result_frame(spark, rows), queries).collect()}
    assert got[1]["accuracy"] and got[1]["f1"] == 1.0
    assert got[2]["recall"] == 0.0 and got[2]["precision"] == 1.0
    assert got[3]["accuracy"] and got[3]["recall"] == 0.0


def test_majority_vote_tie(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (1, 3, "a"), (2, 0, "x"), (2, 1, "y"), (2, 2, "y")]
    frame = spark.createDataFrame(rows, "q int, run int, p string")
    got = {r["q"]: r["p"] for r in votes.majority_vote(frame, "q", "run", "p").collect()}
    assert got == {1: "a", 2: "y"}


def test_spread_join_keeps_every_row(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"))
    dims = rows.groupBy("k").agg(F.count("*").alias("n"))
    for n in (None, "n"):
        joined = joins.spread_join(rows, dims, ["k"], ["id"], n=n)
        assert joined.count() == 1000 and joined.where("n = 700").count() == 700
        kept = joins.spread_join(rows, dims.where("n < 700"), ["k"], ["id"], "left", n=n)
        assert kept.count() == 1000 and kept.where("n IS NULL").count() == 700


def test_sequence_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(1)
        rows = [(rng.choice("ab"), i, rng.choice([0, 1])) for i in range(200)]
        seq = sequence.ordered(spark.createDataFrame(rows, "g string, i int, v int").repartition(7), ["g", "i"])
        assert seq.select("_part").distinct().count() > 1
        placed = sequence.with_running_sum(sequence.with_previous(sequence.with_position(seq), ["i"], ["g"]), F.col("v"), "s")
        got = placed.orderBy("pos").collect()
        previous, total = None, 0
        for pos, (row, (g, i, v)) in enumerate(zip(got, sorted(rows)), 1):
            total += v
            assert (row["g"], row["i"], row["pos"], row["s"]) == (g, i, pos, total)
            assert row["prev_i"] == (previous[1] if previous and previous[0] == g else None)
            previous = (g, i)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_consecutive_repeats_keep_lone_last_row(spark):
    texts = ["select a", "SELECT A", "select a b", "select z", "select z", "q", "last"]
    rows = [("f", i, t) for i, t in enumerate(texts)] + [("g", 0, "only")]
    frame = spark.createDataFrame(rows, "g string, i int, s string")
    got = sorted((r["g"], r["i"]) for r in log_context.drop_consecutive_repeats(frame, "i", "g", "s").collect())
    # Pairs (0,1), then 2 alone, (3,4), then 5 and 6; text 2 holds text 1, so 0..2 are one stretch.
    assert got == [("f", 0), ("f", 2), ("f", 3), ("f", 5), ("f", 6), ("g", 0)]


def brute_table_log(rows, cap, budget):
    """Tables by name; shortest unused texts first; the budget is looked at on entering a table."""
    out = []
    for scope in sorted({r[1] for r in rows}):
        left, used = budget, set()
        names = sorted({t for r in rows if r[1] == scope for t in r[3]})
        for name in names:
            if left <= 0:
                break
            taken = 0
            for key, _, sql, tables in sorted((r for r in rows if r[1] == scope), key=lambda r: (len(r[2]), r[0])):
                if name in tables and sql not in used and taken < cap:
                    used.add(sql)
                    taken += 1
                    left -= 1
                    out.append((scope, name, taken, key))
    return sorted(out)


def test_table_log_once_against_walk(spark):
    rng = random.Random(11)
    rows = [
        (i, rng.choice("xy"), "q" * rng.randint(1, 6), sorted(rng.sample("ABCD", rng.randint(1, 3)))) for i in range(60)
    ]
    frame = spark.createDataFrame(rows, "i long, s string, sql string, t array<string>")
    for cap, budget, block in ((2, 3, 32), (3, 7, 1), (1, 100, 2)):
        got = log_context.table_log_once(frame, "i", "s", "sql", F.col("t"), cap, budget, block)
        assert sorted(tuple(r) for r in got.collect()) == brute_table_log(rows, cap, budget)


def test_table_log_once_of_many_tables(spark):
    """More tables than a block holds, most of which share one text and take nothing."""
    names = [f"t{i:03d}" for i in range(90)]
    rows = [(0, "x", "q", names)] + [(i, "x", "q" * (i % 4 + 1) + str(i), [names[3 * i]]) for i in range(1, 20)]
    frame = spark.createDataFrame(rows, "i long, s string, sql string, t array<string>")
    for budget, block in ((50, 8), (6, 3)):
        got = log_context.table_log_once(frame, "i", "s", "sql", F.col("t"), 2, budget, block)
        assert sorted(tuple(r) for r in got.collect()) == brute_table_log(rows, 2, budget)
    assert log_context.table_log_once(frame.limit(0), "i", "s", "sql", F.col("t"), 2, 5).count() == 0


def brute_overlap(rows, k):
    out = []
    for i, a in rows:
        scored = []
        for j, b in rows:
            if i != j:
                score = len(set(a) & set(b)) - (abs(len(a) - len(b)) / len(a) if len(a) != len(b) else 0)
                scored.append((-score, j))
        out += [(i, rank, j, round(-s, 9)) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_overlapping_queries_against_all_pairs(spark):
    rng = random.Random(5)
    names = [f"t{i}" for i in range(8)]
    rows = [(i, rng.sample(names, rng.choice([1, 1, 2, 2, 3, 5]))) for i in range(60)]
    frame = spark.createDataFrame(rows, "i long, t array<string>")
    got = catalog_match.overlapping_queries(frame, "i", F.col("t"), 5)
    assert sorted((r["i"], r["rank"], r["other_i"], round(r["score"], 9)) for r in got.collect()) == brute_overlap(rows, 5)


@pytest.mark.parametrize("hot", [False, True])
def test_overlapping_queries_of_any_size(spark, hot):
    """Sets of 1 to 40 tables, repeated ones among them, with and without a table that all sets hold."""
    rng = random.Random(7)
    names = [f"t{i}" for i in range(60)]
    rows = [(i, rng.sample(names[: rng.choice([12, 30, 60])], rng.randint(1, 12)) if i % 2 else rng.sample(names, rng.randint(1, 40))) for i in range(120)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(20)]
    rows = [(i, sorted({*t, "hot"}) if hot else t) for i, t in rows]
    frame = spark.createDataFrame(rows, "i long, t array<string>")
    got = catalog_match.overlapping_queries(frame, "i", F.col("t"), 5)
    assert sorted((r["i"], r["rank"], r["other_i"], round(r["score"], 9)) for r in got.collect()) == brute_overlap(rows, 5)


def test_owning_database_last_and_none(spark):
    catalog = spark.createDataFrame([("d1", "A"), ("d1", "B"), ("d2", "A")], "db string, t string")
    log = spark.createDataFrame([(1, ["A"]), (2, ["A", "B"]), (3, ["Z"]), (4, [])], "i long, m array<string>")
    got = {r["i"]: r["owner"] for r in catalog_match.owning_database(log, "i", F.col("m"), catalog, "db", "t").collect()}
    assert got == {1: "d2", 2: "d1", 3: None, 4: None}


def brute_leaders(rows, threshold):
    leaders = []
    for key, sql in sorted(rows):
        grams = set(sql.split(" "))
        if not any(len(g & grams) / max(len(g), len(grams)) > threshold for _, g in leaders):
            leaders.append((key, grams))
    return sorted(k for k, _ in leaders)


def test_leaders_against_scan(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        base = "select a b c d e f from t".split() if rng.random() < 0.5 else "update x set y z w v u".split()
        words = [w if rng.random() < 0.85 else rng.choice("pqrst") for w in base]
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "i long, s string")
    for threshold in (0.8, 0.6):
        got = sorted(r["i"] for r in clustering.leader_templates(frame, "i", "s", threshold).collect())
        assert got == brute_leaders(rows, threshold)


def test_top_similar_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(90, 5)).round(1)
    vectors[7] = 0
    vectors[20] = vectors[21]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")
    got = similarity.top_similar(frame, frame, 4, block_rows=16, skip_same_id=True).collect()
    norms = np.linalg.norm(vectors, axis=1)
    want = set()
    for i, v in enumerate(vectors):
        scores = []
        for j, w in enumerate(vectors):
            if i != j and norms[i] > 0 and norms[j] > 0:
                scores.append((-round(float(v @ w / norms[i] / norms[j]), 9), j))
        want |= {(i, rank, j) for rank, (_, j) in enumerate(sorted(scores)[:4], 1)}
    assert {(r["q_id"], r["rank"], r["t_id"]) for r in got} == want


def test_top_similar_leaves_out_far_groups(spark):
    """Tight groups far apart: queries meet their own group and the few near it, and the answer stays exact."""
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(12, 16)), 40, axis=0) + rng.normal(scale=0.02, size=(480, 16))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")
    got = similarity.top_similar(frame, frame, 5, block_rows=16, skip_same_id=True, centres=24).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 9)
    np.fill_diagonal(scores, -2)
    want = {(i, rank, j) for i, row in enumerate(scores) for rank, j in enumerate(np.lexsort((np.arange(480), -row))[:5].tolist(), 1)}
    assert {(r["q_id"], r["rank"], r["t_id"]) for r in got} == want

    pivots = similarity._pivots(frame, 24)
    grouped = similarity._grouped(frame, pivots)
    layout = similarity._layout(grouped, grouped, len(pivots), 16)
    asked = similarity._with_near_centres(grouped, grouped, pivots, layout, 5, True).collect()
    pairs = sum(layout.t_blocks[c] for r in asked for c in r.near)
    assert pairs < 0.4 * len(asked) * sum(layout.t_blocks)


def test_blocks_grow_with_the_vectors(spark):
    """Four times the rows are sent to about as many blocks, so what is sent grows in proportion; large blocks are scored in parts."""
    import numpy as np

    def blocks(n):
        rows = spark.range(n).select("id", (F.col("id") % 64).cast("int").alias("centre"), F.lit(0.5).alias("angle"))
        layout = similarity._layout(rows, rows, 64)
        return sum(layout.q_blocks), sum(layout.t_blocks)

    assert max(blocks(150_000) + blocks(600_000)) <= 2 * similarity.BLOCKS
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 6))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 9)
    np.fill_diagonal(scores, -2)
    q = frame.select("id", "vector").toPandas()
    q["vector"] = list(unit)
    before, similarity.SCORES = similarity.SCORES, 1000
    try:
        parts = list(similarity._scores(q, q, True))
    finally:
        similarity.SCORES = before
    assert [at for at, _ in parts] == list(range(0, 200, 5))
    assert np.allclose(np.nan_to_num(np.concatenate([x for _, x in parts]), nan=-2), scores)
    want = {(i, rank, j) for i, row in enumerate(scores) for rank, j in enumerate(np.lexsort((np.arange(200), -row))[:3].tolist(), 1)}
    assert {(r["q_id"], r["rank"], r["t_id"]) for r in similarity.top_similar(frame, frame, 3, skip_same_id=True).collect()} == want


def test_top_similar_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id long, vector array<double>")
    assert similarity.top_similar(one, empty, 3).collect() == similarity.top_similar(empty, one, 3).collect() == []
    assert [r["t_id"] for r in similarity.top_similar(one, one, 3).collect()] == [1]


def test_samples(spark):
    frame = spark.range(100).select("id", F.when(F.col("id") < 90, "a").otherwise("b").alias("level"))
    assert sampling.seeded_sample(frame, "id", 7, 1).collect() == sampling.seeded_sample(frame.repartition(5), "id", 7, 1).collect()
    quota = {r["level"]: r["quota"] for r in sampling.proportional_quota(frame, "level", 15).collect()}
    assert quota == {"a": 13, "b": 2}  # 13.5 and 1.5 round half to even, the largest level gives one back
    assert sampling.proportional_sample(frame, "id", "level", 15, 3).count() == 15
    assert sampling.head_and_tail(frame.limit(20), "id", 15, 1).count() == 20


def test_examples_exclude_the_query(spark):
    log = spark.createDataFrame([(i, "d") for i in range(4)], "i long, g string").withColumn("n", F.col("i"))
    got = catalog_match.examples_without_self(log, "i", "g", ["n"], 2).collect()
    assert {(r["i"], r["example"]) for r in got} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)}
    lone = log.limit(1)
    assert catalog_match.examples_without_self(lone, "i", "g", ["n"], 2).count() == 0


def test_shape_of_query_log(spark, sf):
    log = inputs.query_log(spark, sf)
    assert log.count() == 1500
    assert log.where("gold_sql = pred_sql").count() == 1000
    assert log.select(sqltext.mask_literals(F.col("gold_sql"))).distinct().count() == 12


def test_latent_terms_against_svd(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefgh"), size=12, p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05])) for _ in range(40)]
    texts[0] += " zebra"  # in one document only: below min_df
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    got = {r["i"]: r["vector"] for r in clustering.latent_terms(frame, "i", F.split("s", " "), 3, min_df=2, max_share=0.9).collect()}
    vocabulary = [t for t in "abcdefgh" if 2 <= sum(t in x.split() for x in texts) <= 36]
    counts = np.array([[x.split().count(t) for t in vocabulary] for x in texts], dtype=float)
    idf = np.log((1 + 40) / (1 + (counts > 0).sum(axis=0))) + 1
    weights = counts * idf
    weights /= np.linalg.norm(weights, axis=1, keepdims=True)
    u, sizes, _ = np.linalg.svd(weights, full_matrices=False)
    want = u[:, :3] * sizes[:3]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    have = np.array([got[i] for i in range(40)])
    # Directions agree up to sign.
    assert np.abs(np.abs(have) - np.abs(want)).max() < 1e-6


def test_cluster_terms_small(spark):
    import math

    rows = [(1, "c", "a b c"), (2, "c", "a b d"), (3, "c", "x"), (4, "e", "a b")]
    frame = spark.createDataFrame(rows, "i long, g string, s string")
    got = {(r["g"], r["term"]): r["score"] for r in clustering.cluster_terms(frame, "i", "g", F.split("s", " ")).collect()}
    shared, rare = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    norm = math.sqrt(shared**2 + rare**2)
    assert abs(got["c", "a b"] - 2 * shared / norm) < 1e-8 and abs(got["c", "b c"] - rare / norm) < 1e-8
    assert got["e", "a b"] == 1.0


def test_terms_are_counted_in_place(spark):
    """One task's n-grams are never grouped as rows; documents of one key count together."""
    rows = [(1, "c", "a b a b"), (1, "c", "a b"), (None, "c", "x"), (2, None, "a a a"), (3, "e", None), *[(i, "f", "p q r") for i in range(10, 200)]]
    frame = spark.createDataFrame(rows, "i int, g string, s string")
    counts = clustering.term_counts(frame, ["g", "i"], F.split("s", " "), 2)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r["g"], r["i"], r["term"]): r["tf"] for r in counts.collect()}
    few = {k: v for k, v in got.items() if k[0] != "f"}
    assert few == {("c", 1, "a b"): 3, ("c", 1, "b a"): 1, (None, 2, "a a"): 2} and len(got) == 3 + 2 * 190


def test_latent_terms_send_no_vector_with_common_terms(spark, monkeypatch):
    """Terms above and below the share for a broadcast give the same sums, and weights in buckets are not dealt out again."""
    from quarrylog.session import bucketed

    weights = spark.createDataFrame([(d, f"t{d % k}", k, float(d + k)) for d in range(60) for k in (2, 3, 30)], "i int, term string, df int, w double")
    by_term = spark.createDataFrame([(f"t{j}", 2 if j < 2 else 3 if j < 3 else 30, [float(j), 1.0]) for j in range(30)], "term string, df int, v array<double>")
    weights = weights.drop("df").join(by_term.select("term", "df"), "term")
    table, forget = bucketed(weights.repartition(4, "i"), "i", 4)
    sums = {}
    for common in (1, 20, 1 << 15):
        monkeypatch.setattr(clustering, "COMMON", common)
        rows = clustering._sums_of_documents(table, by_term, "i", 2, 180).collect()
        sums[common] = {r["i"]: [round(x, 9) for x in r["v"]] for r in rows}
    assert len(sums[1]) == 60 and sums[1] == sums[20] == sums[1 << 15]
    vectors = spark.range(60).select(F.col("id").cast("int").alias("i"), F.array(F.lit(1.0)).alias("v"))
    plan = table.join(vectors.hint("shuffle_hash"), "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    forget()


def test_empty_logs(spark):
    from quarrylog.functions import vocab
    from quarrylog.operators import workload

    log = spark.createDataFrame([], "i long, g string, sql string")
    text = F.col("sql")
    assert {(r["total"], r["largest"]) for r in workload.category_totals(log, text, vocab.OCCURRENCE_PATTERNS).collect()} == {(0, 0)}
    assert workload.structure_averages(log, text).first()["n_complex"] == 0
    assert workload.profile(log, text).first()["n_queries"] == 0
    assert catalog_match.overlapping_queries(log, "i", sqltext.table_refs(text)).count() == 0
    assert log_context.drop_consecutive_repeats(log, "i", "g", "sql").count() == 0
    assert clustering.leader_templates(log, "i", "sql").count() == 0
    rows = spark.createDataFrame([], "query_id long, side string, values array<string>")
    assert results.entry_and_output_accuracy(rows).count() == 0


def test_first_per_group_beyond_the_early_limit(spark, monkeypatch):
    rows = spark.range(5000).select("id", (F.col("id") % 2).alias("g")).repartition(6)
    want = joins.first_per_group(rows, ["g"], [F.desc("id")], 40).orderBy("id").collect()
    monkeypatch.setattr(joins, "EARLY_RANK_LIMIT", 10)
    assert joins.first_per_group(rows, ["g"], [F.desc("id")], 40).orderBy("id").collect() == want


def test_cached_rows_turn_an_error_into_a_success(spark):
    status = spark.createDataFrame([(1, "timeout"), (2, "timeout"), (3, None), (4, "bad"), (None, "bad")], "query_id long, error string")
    cached = spark.createDataFrame([(1, 5), (1, 7), (2, 0), (9, 3), (None, 2)], "query_id long, n_rows long")
    share = lambda *args: results.error_percentage(*args).first()[0]
    assert (share(status), share(status, cached), share(status.limit(0), cached)) == (80.0, 60.0, None)
