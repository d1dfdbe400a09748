"""Readers and writers of flow logs and stage tables."""

from flowseg.sources.files import (
    load,
    load_flows,
    read_csv_flows,
    read_zeek_conn,
    read_zeek_lines,
    save,
)
from flowseg.sources.stages import stage, stage_exists, stage_mark

__all__ = [
    "load",
    "load_flows",
    "read_csv_flows",
    "read_zeek_conn",
    "read_zeek_lines",
    "save",
    "stage",
    "stage_exists",
    "stage_mark",
]
