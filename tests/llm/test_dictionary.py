from evidara.llm.dictionary import collapse, format_groups

SCHEMA = "mention_id long, doc_id string, kind string, name string, aliases array<string>, id long, code int"
KEYS = {"id_col": "mention_id", "exact": ["doc_id", "kind"], "written": ["name"], "bags": ["aliases"]}


def found(spark, rows):
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], SCHEMA)
    return {r["mention_id"]: (r["first_id"], r["copies"]) for r in format_groups(df, **KEYS).collect()}


def test_writing_order_and_repeats(spark):
    rows = [
        (5, "d", "k", "ABC-12", ["x y", "Q"]),
        (3, "d", "k", " abc12. ", ["q!", "X-Y"]),
        (4, "d", "k", "abc12", ["q", "xy", "xy"]),  # repeats count
        (6, "d", "k2", "abc12", ["q", "xy"]),
        (7, "e", "k", "abc12", ["q", "xy"]),
        (8, "d", "k", "abc1", ["2", "q", "xy"]),  # letters don't move between fields
    ]
    got = found(spark, rows)
    assert got[5] == (3, 2) and got[3] == (3, 2)
    assert all(got[i] == (i, 1) for i in (4, 6, 7, 8))


def test_nulls_empties_case_and_empty_table(spark):
    rows = [(1, None, None, None, None), (2, None, None, "-", []), (3, None, None, "", [None]), (4, None, None, "", [""]), (None, "d", "k", "n", None), (9, "d", "k", "straße Σ", None), (10, "d", "k", "STRASSE σ", [])]
    got = found(spark, rows)
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 9: (9, 2), 10: (9, 2)}
    assert found(spark, []) == {}


def test_collapse_counts(spark):
    df = spark.createDataFrame([(i, "d", "k", "A b" if i % 2 else "ab", None, 0, 0) for i in range(1, 8)], SCHEMA)
    assert [(r["mention_id"], r["copies"]) for r in collapse(df, **KEYS).collect()] == [(1, 7)]
