"""Allow and Block rules from predictions and micro-segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseg.functions.columns import quoted

# The rule table's columns and actions.
SEGMENT, ACTION = "Micro-segment", "Action"
TUPLE = ("SIP", "SPort", "DIP", "DPort", "Proto")
ALLOW, BLOCK = "Allow", "Block"
NOISE = -1


def _allowed(prediction: str, cluster: str) -> Column:
    return (F.col(prediction) == 0.0) & (F.col(cluster) != NOISE)


def _blocked(prediction: str, cluster: str) -> Column:
    return (F.col(prediction) == 1.0) | (F.col(cluster) == NOISE)


def _rows(df: DataFrame, five_tuple: dict[str, str], cluster: str, action: Column) -> DataFrame:
    return df.select(
        F.col(cluster).alias(SEGMENT),
        *[quoted(five_tuple[c]).alias(c) for c in TUPLE],
        action.alias(ACTION),
    ).distinct()


def allow_rules(
    df: DataFrame, five_tuple: dict[str, str], cluster: str = "cluster_id", prediction: str = "prediction"
) -> DataFrame:
    """Distinct connections predicted benign inside a segment."""
    return _rows(df.filter(_allowed(prediction, cluster)), five_tuple, cluster, F.lit(ALLOW))


def block_rules(
    df: DataFrame, five_tuple: dict[str, str], cluster: str = "cluster_id", prediction: str = "prediction"
) -> DataFrame:
    """Distinct connections predicted malicious, or outside every segment."""
    return _rows(df.filter(_blocked(prediction, cluster)), five_tuple, cluster, F.lit(BLOCK))


def rule_table(
    df: DataFrame, five_tuple: dict[str, str], cluster: str = "cluster_id", prediction: str = "prediction"
) -> DataFrame:
    """All rules, ordered by segment and action.

    No row satisfies both conditions, so one CASE in one scan gives the union of
    the two branches. The 5-tuple ends the sort key: it spreads a segment that
    holds most of the rules over many range partitions.
    """
    action = F.when(_allowed(prediction, cluster), ALLOW).when(_blocked(prediction, cluster), BLOCK)
    rules = _rows(df, five_tuple, cluster, action).filter(F.col(ACTION).isNotNull())
    return rules.orderBy(quoted(SEGMENT), ACTION, *TUPLE)


def write_rules(rules: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; ``single_file`` only for rule sets meant for one device."""
    (rules.coalesce(1) if single_file else rules).write.mode("overwrite").option("header", True).csv(path)
