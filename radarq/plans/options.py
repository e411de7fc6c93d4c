"""A recorder's options, from any mapping of its keys."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SOURCE_KEYS = ("name", "group_ip", "port", "source_ip", "interface_ip")


@dataclass(frozen=True)
class RecorderOptions:
    """Keys of a recorder; radar_definition lists (name, group, port, source, interface) one after the other."""

    enabled: bool = True
    source: str = "file"
    source_file: str = ""
    source_file_gps_version: int = 0
    radar_definition: tuple = field(default=())
    timed: int = 0
    timed_stats_interval: int = 0
    mode_scrm: bool = False
    dest_localhost: bool = True
    dest_screen_crc: bool = False
    dest_file: str = ""
    dest_file_region: str = ""
    dest_file_extension: str = "ast"
    dest_file_format: str = "ast"
    dest_file_timestamp: bool = True
    dest_file_nodirectory: bool = False
    dest_file_compress: bool = False
    dest_filter_selection: str = ""

    @classmethod
    def from_mapping(cls, given: Mapping[str, Any]) -> RecorderOptions:
        """Unknown keys are errors, and so are values of a wrong kind."""
        known = {f.name: f for f in fields(cls)}
        for k, v in given.items():
            if k not in known:
                raise ValueError(f"unknown option {k!r}")
            if not isinstance(v, type(known[k].default) if k != "radar_definition" else (tuple, list)):
                raise ValueError(f"option {k!r} can't be {v!r}")
        made = cls(**{k: tuple(v) if k == "radar_definition" else v for k, v in given.items()})
        if len(made.radar_definition) % len(SOURCE_KEYS):
            raise ValueError("radar_definition takes five values a source")
        if made.source not in ("file", "multicast", "broadcast") or made.dest_file_format not in ("ast", "gps", "gps2", "era"):
            raise ValueError("unknown source or file format")
        return made

    @property
    def recording_format(self) -> str:
        """How source_file is framed: by its ending and version."""
        if not self.source_file.endswith("gps"):
            return "ast"
        return {0: "auto", 1: "gps1", 2: "gps2"}[self.source_file_gps_version]

    def sources(self, spark: SparkSession) -> DataFrame:
        n, d = len(SOURCE_KEYS), self.radar_definition
        rows = [(i, *(str(x) for x in d[i * n : i * n + 2]), int(d[i * n + 2]), *(str(x) for x in d[i * n + 3 : i * n + 5])) for i in range(len(d) // n)]
        return spark.createDataFrame(rows, "position int, name string, group_ip string, port int, source_ip string, interface_ip string")
