"""Queries whose flows come from a join compute them once, however many steps read them."""

import pytest
from pyspark.sql import functions as F

from flowseg.plans import catalog
from flowseg.plans.flows import COLUMNS

TYPES = {"src_port": "int", "dst_port": "int", "orig_bytes": "long", "resp_bytes": "long", "orig_pkts": "int", "orig_ip_bytes": "long", "label": "int", "clusterId": "int"}


@pytest.mark.parametrize("name", ["zeek_scan", "rescale_behaviour", "label_encode_large"])
def test_flows_are_computed_once(spark, monkeypatch, name):
    types = {c: TYPES.get(c, "double" if c in ("duration", "prediction") else "string") for c in COLUMNS}
    rows = spark.range(60).select(*[((F.col("id") + i) % (60 if c == "uid" else 7)).cast(t).alias(c) for i, (c, t) in enumerate(types.items())])
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    monkeypatch.setattr(catalog, "flows", lambda *_: rows.mapInPandas(counted, rows.schema))
    assert getattr(catalog, name)(spark, "").count() > 0
    assert seen.value == 60
