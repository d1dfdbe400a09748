from pyspark.sql import functions as F

from flowseg.functions import tables


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("k"))
    out = tables.with_row_index(df.repartition(6), "k", F.desc("v")).orderBy("idx").collect()
    assert [r["idx"] for r in out] == list(range(1000))
    assert [(r["k"], r["v"]) for r in out] == sorted([(r["k"], r["v"]) for r in out], key=lambda t: (t[0], -t[1]))


def test_salted_lookup_equals_broadcast(spark):
    """One key holds half of the rows; NULL and unknown keys keep NULLs."""
    keys = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    df = spark.range(600).select("id", keys.alias("k"))
    lookup = df.filter("k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"))
    a = sorted(map(tuple, tables.lookup_join(df, lookup, "k", "n").collect()), key=str)
    salted = tables.lookup_join(df, tables.materialize(lookup), "k", "n", rows=5)
    assert sorted(salted.columns) == ["id", "k", "n"]
    assert sorted(map(tuple, salted.select("k", "id", "n").collect()), key=str) == a
    assert salted.count() == 600


def test_pointers_reach_their_roots(spark):
    chain = [(0, max(0, i - 1)) for i in range(40)]
    df = spark.createDataFrame([(1, i, p) for i, (_, p) in enumerate(chain)] + [(2, 5, 5), (2, 9, 5)], "g int, v int, p int")
    out = tables.follow_pointers(df, ["g"], "v", "p").collect()
    assert {(r["g"], r["v"]): r["p"] for r in out} == {**{(1, i): 0 for i in range(40)}, (2, 5): 5, (2, 9): 5}


def test_salted_join_of_a_table_without_plain_columns(spark):
    left = spark.createDataFrame([("a", [1.0]), ("a", [2.0]), (None, [3.0])], "k string, v array<double>")
    lookup = spark.createDataFrame([("a", 2, 7)], "k string, n long, x long")
    for df in (left, left.select("k")):
        got = tables.lookup_join(df, lookup, "k", "n", rows=0)
        assert sorted(r["x"] or 0 for r in got.collect()) == [0, 7, 7]


def test_heavy_keys_fill_no_task_of_a_salted_join(spark):
    """One key holds a third of the rows, NULL another fifth, and rows of a key are equal."""
    keys = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 701))
    df = spark.range(30_000).select(keys.alias("k"))
    lookup = tables.materialize(df.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = tables.lookup_join(df, lookup, "k", "n", rows=0).withColumn("part", F.spark_partition_id())
        sizes = sorted(r["count"] for r in out.groupBy("part").count().collect())
        assert sum(sizes) == 30_000 and len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
        assert out.filter("k IS NOT NULL AND n IS NULL").isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
