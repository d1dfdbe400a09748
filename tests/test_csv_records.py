from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.operators import enrich
from flowseg.sources import files
from flowseg.specs import SPECS

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("b", T.StringType())])
LINES = ["x,1,y", 'x,"2",y', "x,n/a,y", "x,-,-", '"x,1",3,y', "short,1", '"short,1,z",1', "x,1,y,more", '"a\\",b",4,y', "x", "x,1,y"]


@pytest.fixture(params=[False, True])
def spec(request, spark, tmp_path):
    lines = (["h1,h2,h3"] if request.param else []) + LINES
    (tmp_path / "part.csv").write_text("\n".join(lines) + "\n")
    return replace(SPECS["unsw"], path=str(tmp_path), file_glob="*.csv", schema=SCHEMA, header=request.param, labels=("b",), positive_label=None)


def test_records_of_another_width_are_rejected(spark, spec):
    good, bad = files.parse_csv_flows(spark, spec)
    assert sorted((r["value"], r["n_fields"]) for r in bad.collect()) == [('"short,1,z",1', 2), ("short,1", 2), ("x", 1), ("x,1,y,more", 4)]
    want = [("x", 1, "y"), ("x", 2, "y"), ("x", None, "y"), ("x", None, None), ("x,1", 3, "y"), ('a",b', 4, "y"), ("x", 1, "y")]
    rows = good.collect()
    assert sorted((str(r["a"]), str(r["n"]), str(r["b"])) for r in rows) == sorted((str(a), str(n), str(b)) for a, n, b in want)
    assert len({r["uid"] for r in rows}) == len(want)
    # a few columns only, or none, must reject the same records
    assert good.count() == len(want) and sorted(str(r["n"]) for r in good.select("n").collect()) == sorted(str(n) for _, n, _ in want)
    assert bad.count() == 4


def test_all_records_stay_without_rejects(spark, spec):
    assert files.read_csv_flows(spark, spec).count() == len(LINES)


def test_no_rejects(spark, tmp_path):
    (tmp_path / "part.csv").write_text("x,1,y\n")
    plain = replace(SPECS["unsw"], path=str(tmp_path), file_glob="*.csv", schema=SCHEMA, labels=("b",))
    good, bad = files.parse_csv_flows(spark, plain)
    assert good.count() == 1 and bad.count() == 0


def test_profile_copies_no_rows(spark):
    rows = [("s", "d1", 1, 0), ("s", "d1", 2, 5), ("s", None, 2, None), (None, "d2", None, 0), (None, "d3", 7, 1), ("t", None, None, 0)]
    df = spark.createDataFrame(rows, "`s.ip` string, d string, p int, r long")
    profile = enrich.source_profile(df, "s.ip", "d", "p", "r")
    assert "Expand" not in profile._jdf.queryExecution().toString()
    got = {r["s.ip"]: tuple(r)[1:] for r in profile.collect()}
    assert got == {"s": (1, 2, 3, 1 / 3), None: (2, 1, 2, 0.5), "t": (0, 0, 1, 1.0)}
    assert profile.filter(F.col("total_flows") == 0).isEmpty()
    assert enrich.source_profile(df.limit(0), "s.ip", "d", "p", "r").count() == 0
