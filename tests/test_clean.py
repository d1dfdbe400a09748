import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.operators import clean
from flowseg.sources.files import parse_zeek
from flowseg.specs import SPECS

LINES = [
    "#fields\tts\tuid",
    "1.5\tC1\t10.0.0.1\t5000\t10.0.0.9\t80\ttcp\thttp\t0.5\t100\t0\tSF\t-\t-\t0\tShAD\t3\t220\t2\t180\t-   Malicious   DDoS",
    "2.5 C2 10.0.0.2 5001 10.0.0.9 53 udp - - - - S0 - - 0 D 1 40 0 0 - Benign -",
    "3.5\tC3\tshort",
    "4.5 C4 10.0.0.2 0x1F 10.0.0.9 99999999999 udp - oops - - S0 T - 0 D 1 40 0 0 - malicious -",
]


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    return parse_zeek(lines, SPECS["iot23"])


def test_zeek_lines(parsed):
    good, bad = parsed
    assert good.schema.names == SPECS["iot23"].schema.names
    rows = {r["uid"]: r for r in good.collect()}
    assert set(rows) == {"C1", "C2", "C4"}
    one, two = rows["C1"], rows["C2"]
    assert (one["label"], one["detailed_label"], one["id_orig_p"], one["orig_bytes"]) == (1, "DDoS", 5000, 100)
    assert two["service"] is None and two["duration"] is None and two["orig_bytes"] is None
    assert (two["label"], two["detailed_label"]) == (0, "Benign")
    assert [tuple(r) for r in bad.collect()] == [(LINES[3], 3)]


def test_values_that_do_not_parse_become_null(parsed):
    row = parsed[0].filter("uid = 'C4'").first()
    assert row["id_orig_p"] is None and row["id_resp_p"] is None and row["duration"] is None
    assert row["local_orig"] is None and row["label"] == 0


def test_binary_label_is_exact(spark):
    df = spark.createDataFrame([("Malicious",), ("malicious",), (None,), ("Benign",)], "l string")
    out = clean.binary_label(df, "l", "Malicious")
    assert [r["l"] for r in out.collect()] == [1, 0, 0, 0]
    assert out.schema["l"].dataType == T.IntegerType()


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_uid_numbers_copies_wherever_they_are(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(clean, "is_small", lambda df: df.limit(broadcast_rows + 1).count() <= broadcast_rows)
    rows = [("a", 1)] * 7 + [("b", None)] * 2 + [(None, 3)]
    df = spark.createDataFrame([(x, y, i % 3) for i, (x, y) in enumerate(rows)], "x string, y int, s long")
    out = clean.add_uid(df, columns=["x", "y"])
    assert out.columns == ["x", "y", "s", "uid"]
    ids = sorted(r["uid"] for r in out.collect())
    assert len(set(ids)) == len(rows)
    assert sorted(int(r["uid"].split("-")[1]) for r in out.collect() if r["x"] == "a") == list(range(7))
    assert sorted(r["uid"] for r in clean.add_uid(df.repartition(5), columns=["x", "y"]).collect()) == ids
    assert clean.add_uid(df.limit(0), columns=["x", "y"]).count() == 0


def test_uid_leaves_rows_of_a_scan_where_they_are(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 150).alias("x"), F.lit("payload").alias("wide"))
    df.repartition(3).write.parquet(f"{tmp_path}/rows")
    out = clean.add_uid(spark.read.parquet(f"{tmp_path}/rows"), scan=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("wide") and "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    rows = out.collect()
    assert len({r["uid"] for r in rows}) == 400 and {r["uid"].split("-")[1] for r in rows} == {"0", "1", "2"}
