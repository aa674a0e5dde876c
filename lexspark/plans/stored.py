"""Indexes that several queries of a session read: written once to the shared folder, then read."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from lexspark.session import shared_folder

T = TypeVar("T")
_WRITTEN: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None], read: Callable[[SparkSession, str], T]) -> T:
    """What ``read`` makes of the folder that ``write`` has filled for this session and these tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/{name}-{len(_WRITTEN)}"
        write(path)
        _WRITTEN[key] = path
    return read(spark, _WRITTEN[key])
