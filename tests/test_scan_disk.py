"""What zeek_scan leaves on disk beside the log files that are read."""

from pathlib import Path

from pyspark.sql import functions as F

from flowseg.plans import catalog
from flowseg.plans.flows import COLUMNS
from tests.test_reads import TYPES


def test_lines_are_stored_once_as_text_and_packed_elsewhere(spark, monkeypatch, tmp_path):
    types = {c: TYPES.get(c, "double" if c in ("duration", "prediction") else "string") for c in COLUMNS}
    rows = spark.range(4000).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5000)).cast(t).alias(c) for i, (c, t) in enumerate(types.items())])
    monkeypatch.setattr(catalog, "flows", lambda *_: rows)
    monkeypatch.setattr(catalog, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    whole = catalog.zeek_lines(spark, "").filter("NOT startswith(value, '#')").count()
    assert catalog.zeek_scan(spark, "").agg(F.sum("n_flows")).first()[0] == whole
    stored = [p for p in Path(tmp_path).rglob("*") if p.is_file()]
    text = [p for p in stored if p.suffix == ".txt"]
    assert {"/".join(p.relative_to(tmp_path).parts[1:-1]) for p in text} == {"capture-1/logs", "capture-2/logs/older"}
    beside = sum(p.stat().st_size for p in stored if p not in text)
    assert beside < 0.6 * sum(p.stat().st_size for p in text)
    assert spark.read.csv(f"{tmp_path}/zeek/capture-1/other").count() == 4000
