from catena.llm.exact_dedup import exact_dedup, mark_copies


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in rows)


def test_cases(spark):
    long = "wort " * 50_000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long + "x"), (6, long + "y"), (7, long + "x"), (8, "b"), (9, "a"), (10, "c" * 80 + "1"), (11, "c" * 80 + "2")]
    df = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id long, text string, lang string, keep_id int")
    got = sorted(tuple(r) for r in mark_copies(df).select("doc_id", "keep_id", "group_size", "kept").collect())
    assert got == brute(rows)
    kept = exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 6, 7, 8, 9, 10, 11]


def test_empty_and_repeats(spark):
    schema = "doc_id long, text string"
    assert mark_copies(spark.createDataFrame([], schema)).count() == 0
    got = mark_copies(spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], schema)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (1, 1, 2, True), (1, 1, 2, True)]
