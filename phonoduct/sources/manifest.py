"""The arguments of a run, beside its output."""

from __future__ import annotations

import json
from enum import Enum
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from phonoduct.sources.files import write_text


def _plain(x):
    if isinstance(x, Path):
        return str(x)
    if isinstance(x, Enum):
        return x.value
    if hasattr(x, "_asdict"):
        return {k: _plain(v) for k, v in x._asdict().items()}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x


def manifest(arguments: dict) -> str:
    """JSON with sorted keys; DataFrames and sessions are left out."""
    kept = {k: v for k, v in arguments.items() if not isinstance(v, DataFrame) and k != "spark"}
    return json.dumps(_plain(kept), sort_keys=True, indent=2, ensure_ascii=False, default=str)


def save_arguments(arguments: dict, folder: str, spark: SparkSession | None = None) -> None:
    """Write arguments.json into a folder of any file system the session knows."""
    write_text(spark or SparkSession.getActiveSession(), f"{folder}/arguments.json", manifest(arguments))
