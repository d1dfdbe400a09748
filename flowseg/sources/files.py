"""Scans of CSV and Zeek-style text logs, and the parquet stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.functions.columns import quoted
from flowseg.functions.tables import materialize
from flowseg.operators import clean
from flowseg.specs import FlowSpec

RECORD = "_csv_record"


def _scan_csv(spark: SparkSession, spec: FlowSpec, schema: T.StructType, **options) -> DataFrame:
    reader = spark.read.options(**options).schema(schema)
    return reader.csv(f"{spec.path}/{spec.file_glob}", header=spec.header, nullValue=clean.MISSING, nanValue="NaN")


def _finish_csv(df: DataFrame, spec: FlowSpec) -> DataFrame:
    if spec.generated_uid:
        df = clean.add_uid(df, spec.uid, spec.schema.names, scan=True)
    if spec.positive_label is not None:
        df = clean.binary_label(df, spec.label, spec.positive_label)
    return df


def read_csv_flows(spark: SparkSession, spec: FlowSpec) -> DataFrame:
    """CSV flows under the fixed schema; a header line is skipped, its names are ignored.

    A short record is filled up with NULLs, a long one is cut.
    """
    return _finish_csv(_scan_csv(spark, spec, spec.schema), spec)


def csv_arity(record: Column) -> Column:
    """Number of comma-separated fields; commas inside quotes don't separate."""
    bare = F.regexp_replace(record, r'"(?:[^"\\]++|\\.)*+"', "")
    return F.size(F.split(bare, ",", -1))


def parse_csv_flows(spark: SparkSession, spec: FlowSpec) -> tuple[DataFrame, DataFrame]:
    """Flows of the records with the right number of fields, and the rejected records.

    Rejects are ``(value, n_fields)``, as those of ``parse_zeek``, and are stored apart, since they
    are few. Values that do not parse are no reason to reject: they become NULL.
    """
    schema = T.StructType([*spec.schema.fields, T.StructField(RECORD, T.StringType())])
    # the scan fills this column for records of another width and for those with a value that does not parse;
    # with pruned columns it would count the fields of the pruned record
    records = _scan_csv(spark, spec, schema, columnNameOfCorruptRecord=RECORD, columnPruning=False)
    # Spark refuses scans that need the record column alone, so nothing of a data column is added to it
    record = F.concat(RECORD, F.coalesce(F.left(quoted(spec.schema.names[0]).cast("string"), F.lit(0)), F.lit("")))
    n_fields = csv_arity(record)
    wrong = F.coalesce(n_fields != len(spec.schema), F.lit(False))
    rejects = materialize(records.filter(wrong).select(record.alias("value"), n_fields.alias("n_fields")))
    return _finish_csv(records.filter(~wrong).drop(RECORD), spec), rejects


def read_zeek_lines(spark: SparkSession, path: str, file_glob: str = "*conn.log.labeled") -> DataFrame:
    """Raw lines of every matching file below ``path``."""
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", file_glob)
        .text(path)
    )
    if not lines.inputFiles():
        raise FileNotFoundError(f"no {file_glob} below {path}")
    return lines


def parse_zeek(lines: DataFrame, spec: FlowSpec) -> tuple[DataFrame, DataFrame]:
    """Typed flows of the lines with the right number of fields, and the rejected lines."""
    fields = clean.split_fields(clean.drop_comments(lines))
    good, bad = clean.keep_arity(fields, len(spec.schema))
    defaults = {spec.attack: spec.label_default} if spec.label_default else None
    flows = clean.project_schema(good, spec.schema, defaults=defaults)
    if spec.positive_label is not None:
        flows = clean.binary_label(flows, spec.label, spec.positive_label)
    return flows, bad.select("value", F.size("fields").alias("n_fields"))


def read_zeek_conn(spark: SparkSession, spec: FlowSpec) -> DataFrame:
    return parse_zeek(read_zeek_lines(spark, spec.path, spec.file_glob), spec)[0]


def load_flows(spark: SparkSession, spec: FlowSpec) -> DataFrame:
    """Raw flows of a dataset by its kind."""
    readers = {"csv": read_csv_flows, "zeek": read_zeek_conn}
    return readers[spec.kind](spark, spec)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
