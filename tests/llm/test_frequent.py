from braidwork.llm.frequent import frequent_values, top_values


def test_top_and_threshold(spark):
    rows = [(7, 1)] * 50 + [(8, None)] * 30 + [(None, 2)] * 20 + [(i, i) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "h bigint, s bigint").withColumnRenamed("s", "n")
    got = {tuple(r) for r in frequent_values(df, ["h", "n"], 10).collect()}
    assert got == {("h", 7, 50), ("h", 8, 30), ("n", 1, 50), ("n", 2, 20)}  # 20 of 200 is one in 10
    assert [tuple(r)[1:] for r in top_values(df, "h", 3).collect()] == [(7, 50), (8, 30), (100, 1)]


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], "h bigint")
    assert frequent_values(df, ["h"], 10).count() == 0
    assert frequent_values(spark.createDataFrame([(None,)] * 3, "h bigint"), ["h"], 10).count() == 0
