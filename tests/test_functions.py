import pytest
from pyspark.sql import Row, functions as F

from quarrylog.functions import scores, sqltext, text, vectors
from quarrylog.operators import nl_scores


def one(spark, column, **values):
    frame = spark.createDataFrame([Row(**values)])
    return frame.select(column.alias("x")).first()["x"]


def sql(spark, fn, statement):
    return one(spark, fn(F.col("s")), s=statement)


def test_mask_literals(spark):
    assert sql(spark, sqltext.mask_literals, "SELECT a1 FROM t WHERE b = 'it''s' AND c > 1.5") == "SELECT a1 FROM t WHERE b = ? AND c > ?"


def test_table_refs(spark):
    refs = lambda s: sql(spark, sqltext.table_refs, s)
    assert refs("select * from w.a x, b as y where x.i = 'from z'") == ["A", "B"]
    assert refs("SELECT * FROM a LEFT JOIN b ON a.i = b.i JOIN c USING (i)") == ["A", "B", "C"]
    assert refs("WITH q AS (SELECT 1 FROM d), r AS (SELECT * FROM q) SELECT * FROM r JOIN e ON 1 = 1 -- FROM f") == ["D", "E"]
    assert refs("SELECT EXTRACT(YEAR FROM ts) FROM a WHERE x IS DISTINCT FROM y") == ["A"]
    assert refs("SELECT * FROM (SELECT i FROM a) s, b") == ["A"]  # documented limit: b is not seen
    assert refs("COMMIT") == []


def test_column_refs(spark):
    statement = "SELECT c.name AS n, SUM(o.total) FROM customer c JOIN orders o ON c.id = o.cid WHERE o.state = 'x' GROUP BY c.name"
    assert sorted(sql(spark, sqltext.column_refs, statement)) == ["CID", "ID", "NAME", "STATE", "TOTAL"]
    assert tuple(sql(spark, sqltext.owned_columns, statement)[0]) == ("CUSTOMER", "NAME")


@pytest.mark.parametrize("statement,expected", [
    ("SELECT a.x FROM t a WHERE a.y IN (SELECT a.z FROM u a WHERE a.v = b.w)", "T.X T.Y U.Z U.V B.W"),  # an inner alias hides the outer one
    ("SELECT a.x FROM t a WHERE EXISTS (SELECT 1 FROM u b WHERE b.k = a.k AND b.n > (SELECT AVG(a.n) FROM v c WHERE c.k = b.k))", "T.X U.K T.K U.N T.N V.K"),
    ("WITH big AS (SELECT o.k FROM orders o) SELECT b.k, c.n FROM big b JOIN customer AS c ON b.k = c.k", "ORDERS.K CUSTOMER.N CUSTOMER.K"),
    ("WITH p AS (SELECT q.x FROM q), r AS (SELECT p.x FROM p) SELECT s.x FROM s, r WHERE r.x = s.y", "Q.X S.X S.Y"),
    ("SELECT d.x, e.y FROM (SELECT a.x FROM t a) d JOIN w e ON d.x = e.x", "W.Y T.X W.X"),
    ("SELECT a.x FROM t a UNION SELECT a.x FROM u a", "T.X U.X"),
    ("SELECT s.t.x, COUNT(DISTINCT t.y) FROM s.t, u LEFT JOIN v ON u.k = v.k, w z WHERE z.k = 'a.b(c' GROUP BY t.y", "T.X T.Y U.K V.K W.K"),
    ("SELECT x FROM t", ""),
    ("COMMIT", ""),
    (") SELECT a.x FROM t a (", "T.X"),
])
def test_columns_by_scope(spark, statement, expected):
    got = sql(spark, sqltext.owned_columns, statement)
    assert [f"{c['table_name']}.{c['column_name']}" for c in got] == expected.split()


def test_prompts_show_the_log(spark, sf):
    """Every table that the log qualifies appears by its own name, with earlier queries."""
    import __spark_entry__

    found = __spark_entry__.queries()["f23_log_prompt"](spark, sf).collect()
    assert len(found) == 5
    for r in found:
        assert "CREATE TABLE CUSTOMER(" in r.prompt and "CREATE TABLE BIG(" not in r.prompt
        assert "REFERRED TO THE TABLE CUSTOMER" in r.prompt and "SQL: SELECT" in r.prompt


def test_generalise(spark):
    statement = "SELECT eid FROM Employee WHERE salary > 100000 AND name = 'Bob'"
    assert sql(spark, sqltext.generalise, statement) == (
        "SELECT column_1 FROM table_1 WHERE column_2 > number_value AND column_3 = string_value"
    )


def test_difficulty(spark):
    level = lambda s: sql(spark, sqltext.difficulty, s)
    assert level("SELECT a FROM t") == "easy"
    assert level("SELECT a FROM t JOIN u ON t.i = u.i") == "medium"
    assert level("SELECT a FROM t WHERE a = 1 AND b = 2 AND c LIKE 'x'") == "medium"
    assert level("SELECT a FROM t GROUP BY a") == "hard"
    assert level("SELECT a FROM t WHERE a IN (SELECT b FROM u)") == "extra"


def test_cte_bodies():
    parts = sqltext.cte_bodies("WITH a AS (SELECT ')' FROM t WHERE f(x) > 1), b AS (SELECT 1) SELECT * FROM a JOIN b")
    assert parts == [
        {"title": "a", "sql": "SELECT ')' FROM t WHERE f(x) > 1"},
        {"title": "b", "sql": "SELECT 1"},
        {"title": "main", "sql": "SELECT * FROM a JOIN b"},
    ]
    assert sqltext.cte_bodies("SELECT 1") == []


def test_annotate_ctes(spark):
    notes = F.array(
        *[F.struct(F.lit(t).alias("title"), F.lit(n).alias("note")) for t, n in (("a", "one"), ("b", "two"), ("main", "all"))]
    )
    got = one(spark, sqltext.annotate_ctes(F.col("s"), notes), s="WITH a AS (SELECT 1), b AS (SELECT 2) SELECT 3")
    assert got == "WITH -- one\na AS (SELECT 1), -- two\nb AS (SELECT 2)\n-- all\n SELECT 3"
    assert one(spark, sqltext.annotate_ctes(F.col("s"), F.slice(notes, 3, 1)), s="SELECT 3") == "-- all\nSELECT 3"


def test_rewrites(spark):
    assert sql(spark, sqltext.limit_to_rownum, "SELECT a FROM t LIMIT 5;") == "SELECT * FROM (SELECT a FROM t ) WHERE ROWNUM <=5"
    assert sql(spark, sqltext.limit_to_rownum, "SELECT a FROM t WHERE b = 'LIMIT 3'\nLIMIT\n5") == "SELECT * FROM (SELECT a FROM t WHERE b = 'LIMIT 3'\n) WHERE ROWNUM <=5"
    qualified = spark.sql("SELECT 'SELECT * FROM T$X, t' AS s").select(sqltext.qualify_tables(F.col("s"), F.array(F.lit("T$X")), "OWNER"))
    assert qualified.first()[0] == "SELECT * FROM OWNER.T$X, t"
    owned = sqltext.qualify_tables(F.col("s"), F.array(F.lit("T")), "OWNER")
    assert one(spark, owned, s="SELECT t.a FROM t, tt WHERE t.a = 1") == "SELECT OWNER.t.a FROM OWNER.t, tt WHERE OWNER.t.a = 1".replace("OWNER.t.a", "t.a")
    assert sql(spark, sqltext.strip_fence, "```sql\nSELECT 1\n```") == "SELECT 1"
    assert sql(spark, sqltext.sanitise_quoted, "SELECT `a b (c-d)`, `e` FROM t") == "SELECT `a_b_cd`, `e` FROM t"


def test_options(spark):
    assert sql(spark, text.clean_marker, "1. Show the name") == "Show the name"
    assert sql(spark, text.clean_marker, "Show the name") == "Show the name"
    assert sql(spark, text.split_numbered, "1. first long option 2. second long option") == ["first long option ", "second long option"]
    assert sql(spark, text.split_numbered, "1: first long option 2: second long option") == ["first long option ", "second long option"]
    assert sql(spark, text.split_candidates, "SELECT 1; ;SELECT 2;") == ["SELECT 1", "SELECT 2"]
    assert sql(spark, text.option_lines, "Option 1\n - Show names\nnote: x\n\nList all") == ["Show names", "List all"]


def test_short_option_lines_stay(spark):
    assert sql(spark, text.option_lines, "1. Yes\nNo\n2. All names\n3.") == ["Yes", "No", "All names", ""]
    assert sql(spark, lambda c: text.long_options(text.option_lines(c)), "1. Yes\nNo\n2. All names\n3.") == ["All names"]


def test_ngrams_and_numbers(spark):
    assert one(spark, text.ngrams(F.split("s", " "), 3), s="a b c d") == ["a b c", "b c d"]
    assert one(spark, text.ngrams(F.split("s", " "), 3), s="a b") == []
    assert one(spark, text.significant(F.col("v")), v=12345.0) == 12300.0
    assert one(spark, text.significant(F.col("v")), v=0.0) == 0.0


def test_normalise(spark):
    assert sql(spark, text.fold_accents, "Café naïve") == "Cafe naive"
    assert sql(spark, text.expand_contractions, "YOU'LL see, it can't fail: the dog's bone") == "You will see, it can not fail: the dogs bone"
    assert sql(spark, text.normalise, "The Café\nisn't (very) open. 24h!") == "cafe open h"


def test_set_scores_edges(spark):
    cases = [
        (["a", "b"], ["c", "b"], 0.5, 0.5, 0.5, False),
        ([], ["a"], 0.0, 0.0, 0.0, False),
        (["a"], [], 1.0, 0.0, 0.0, False),
        ([], [], 1.0, 0.0, 0.0, True),
    ]
    from quarrylog.operators import scoring

    frame = spark.createDataFrame([(i, g, p) for i, (g, p, *_) in enumerate(cases)], "i int, g array<string>, p array<string>")
    got = {r["i"]: r for r in scoring.set_scores(frame, ["i"], F.col("g"), F.col("p")).collect()}
    null_rule = {r["i"]: r for r in scoring.set_scores_null_rule(frame, ["i"], F.col("g"), F.col("p")).collect()}
    for i, (_, _, precision, recall, f1, accuracy) in enumerate(cases):
        assert (got[i]["precision"], got[i]["recall"], got[i]["f1"], got[i]["accuracy"]) == (precision, recall, f1, accuracy)
    assert (null_rule[3]["precision"], null_rule[3]["recall"], null_rule[3]["f1"]) == (1.0, 1.0, 1.0)


def test_evaluator_golden_case(spark):
    """Two queries over one table, one prediction wrong: all four averages are one half."""
    from quarrylog.operators import scoring

    rows = [(0, "SELECT * FROM TERMS;", "SELECT * FROM TERMS_ALL;"), (1, "SELECT * FROM TERMS;", "SELECT * FROM TERMS;")]
    frame = spark.createDataFrame(rows, "i int, g string, p string")
    scored = scoring.set_scores(frame, ["i"], sqltext.table_refs(F.col("g")), sqltext.table_refs(F.col("p")))
    assert tuple(scoring.macro_summary(scored).first()) == (0.5, 0.5, 0.5, 0.5)


def test_cosine(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 0.0]) == 1.0
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) is None


def test_overlap(spark):
    assert one(spark, scores.overlap_ratio(F.col("a"), F.col("b")), a=["x", "y"], b=["x", "y", "z"]) == 2 / 3
    assert one(spark, scores.table_overlap(F.col("a"), F.col("b")), a=["x", "y"], b=["x", "y", "z"]) == 1.5


def _lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_lcs_against_table():
    from hypothesis import given, strategies as st

    @given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
    def check(a, b):
        assert nl_scores.lcs_length(a, b) == _lcs(a, b)

    check()


def test_bleu(spark):
    rows = [
        (0, "the cat sat on the mat", "the cat sat on the mat"),
        (1, "the cat sat on the mat", "the the the the"),
        (2, "a b c d e f", "a b c d"),
        (3, "", "a b"),
        (4, "a b", ""),
    ]
    frame = spark.createDataFrame(rows, "i int, r string, g string")
    import math

    plain = {r["i"]: r["bleu"] for r in nl_scores.bleu(frame, ["i"], "r", "g").collect()}
    assert plain[0] == 1.0 and plain[1] == plain[3] == plain[4] == 0.0
    assert abs(plain[2] - math.exp(1 - 6 / 4)) < 1e-12
    smooth = {r["i"]: r["bleu"] for r in nl_scores.bleu(frame, ["i"], "r", "g", smooth=True).collect()}
    want = math.exp(1 - 6 / 4) * math.exp((math.log(2 / 4) + math.log(0.1 / 3) + math.log(0.1 / 2) + math.log(0.1 / 1)) / 4)
    assert abs(smooth[1] - want) < 1e-12


def test_joined_text_equals_sentence_score(spark):
    """Joining turn texts first and scoring the joined pair gives the same BLEU, short texts included."""
    turns = [(1, 0, "ref", "a b"), (1, 1, "gen", "a"), (1, 2, "ref", "c"), (1, 3, "gen", "b"), (1, 4, "ref", "d e"), (1, 5, "gen", "c d"), (1, 6, "gen", ""), (1, 7, "gen", "e x y")]
    frame = spark.createDataFrame(turns, "g int, t int, side string, text string")
    joined = nl_scores.joined_text_scores(frame, "g", ["t"], F.col("side"), "text").first()
    pair = spark.createDataFrame([(1, "a b c d e", "a b c d e x y")], "g int, r string, p string")
    assert abs(joined["bleu"] - nl_scores.bleu(pair, ["g"], "r", "p").first()["bleu"]) < 1e-12
    assert abs(joined["rouge_1"] - pair.select(nl_scores.rouge_1(F.col("r"), F.col("p")).alias("x")).first()["x"]) < 1e-12


def test_short_numbers_print_as_three_digits(spark):
    values = [0.0, 1.0, -2.5, 0.04, 12.34, 99.96, 100.0, 999.0, 999.6, 1000.0, 4605.0, 4615.0, -123456.0, 0.000123456, 0.0000123456, 1e20, 7.0]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in frame.select(text.short_number(F.col("x"))).collect()]
    assert got == [f"{v:.3g}" for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in odd.select(text.short_number(F.col("x"))).collect()] == [None, None, None]


def test_catalog_names_need_a_mark_on_both_sides(spark):
    sql = "SELECT * FROM t JOIN x.T$1 ON (t.a = ta.t) WHERE t"
    names = F.array(F.lit("T"), F.lit("T$1"))
    got = spark.createDataFrame([(sql,)], "s string").select(sqltext.catalog_names(F.col("s"), names, "DW")).first()[0]
    assert got == "SELECT * FROM  'DW-t' JOIN x. 'DW-T$1' ON ( 'DW-t'.a = ta. 'DW-t') WHERE t"


def test_write_words_with_and_without_case(spark):
    from quarrylog.operators import workload

    log = spark.createDataFrame([("delete from t",), ("DELETE FROM t",), ("SELECT 1",), (None,)], "sql string")
    counts = lambda cased: log.agg(*workload.write_words(F.col("sql"), cased)).first()["delete"]
    assert (counts(True), counts(False)) == (1, 2)


def test_all_forms_of_a_column_question(spark):
    from quarrylog.operators import prompts

    asked = prompts.column_questions(F.lit("c"), F.array(F.lit("1")), F.array(F.lit("1")), F.array(F.lit("PHONE"), F.lit("TITLE")))
    rows = {r.form: r.question for r in spark.range(1).select(F.inline(asked)).collect()}
    assert set(rows) == {"select", "check", "new"} and all("PHONE, TITLE" in q for q in rows.values())
