"""Per-source behaviour profiles and their use as features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseg.functions.columns import quoted
from flowseg.functions.tables import BROADCAST_ROWS, lookup_join, materialize
from flowseg.operators.features import assemble, standardize

# Names of the profile's columns.
PROFILE = ["distinct_dst_ips", "distinct_dst_ports", "total_flows", "zero_resp_ratio"]


def source_profile(
    df: DataFrame, src_ip: str, dst_ip: str, dst_port: str, response_bytes: str, exact: bool = True
) -> DataFrame:
    """One row per source: distinct targets and ports, flows, share of unanswered flows.

    The flows reduce to (source, target) pairs, which also carry the flow counts, and
    to (source, port) pairs, so a source that owns most flows is spread over its
    targets, and no row is copied for the second distinct count: both kinds of pairs
    are added up by source together. ``df`` is read once for each kind.
    ``exact=False`` keeps sketches instead of pairs, in one reading.
    NULL targets and ports are not counted; NULL is a source of its own.
    """
    silent = F.sum(F.when(quoted(response_bytes) == 0, 1).otherwise(0))
    flows = F.count(F.lit(1))
    source = quoted(src_ip)
    if not exact:
        return df.groupBy(source).agg(
            F.approx_count_distinct(quoted(dst_ip)).alias(PROFILE[0]),
            F.approx_count_distinct(quoted(dst_port)).alias(PROFILE[1]),
            flows.alias(PROFILE[2]),
            (silent / flows).alias(PROFILE[3]),
        )
    known, none = F.col("_target").isNotNull().cast("long"), F.lit(0).cast("long")
    ips = df.groupBy(source, quoted(dst_ip).alias("_target")).agg(flows.alias("_flows"), silent.alias("_silent"))
    ports = df.select(source, quoted(dst_port).alias("_target")).distinct()
    pairs = ips.select(source, known.alias("_ip"), none.alias("_port"), "_flows", "_silent").unionByName(
        ports.select(source, none.alias("_ip"), known.alias("_port"), none.alias("_flows"), none.alias("_silent"))
    )
    return pairs.groupBy(source).agg(
        F.sum("_ip").alias(PROFILE[0]),
        F.sum("_port").alias(PROFILE[1]),
        F.sum("_flows").alias(PROFILE[2]),
        (F.sum("_silent") / F.sum("_flows")).alias(PROFILE[3]),
    )


def add_behaviour(df: DataFrame, profile: DataFrame, src_ip: str, rows: int = BROADCAST_ROWS, written: bool = False) -> DataFrame:
    """The profile of its source on every flow.

    ``total_flows`` says which sources are heavy, so the join salts them when
    the profile is too large to broadcast. The profile is written first unless it is ``written`` already.
    """
    return lookup_join(df, profile if written else materialize(profile), src_ip, PROFILE[2], rows)


def rescale_behaviour(
    df: DataFrame,
    scaled: str = "scaled_features",
    out: str = "enriched_features",
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Standardize the profile columns and append them to the scaled features."""
    raw, fresh = "_behaviour_raw", "_behaviour_scaled"
    fit_frame = assemble(fit_on, PROFILE, raw) if fit_on is not None else None
    df = standardize(assemble(df, PROFILE, raw), raw, fresh, fit_frame)
    return assemble(df, [scaled, fresh], out).drop(raw, fresh)
