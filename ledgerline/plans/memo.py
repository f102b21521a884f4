"""Per-application memo for phase artifacts.

The reference hands phase outputs (trained models, prediction tables) from
one phase to the next through files.  Here a phase output is computed once
per Spark application: DataFrames are reliably checkpointed to the shared
folder (lineage cut, survives executor loss), models and scalars are kept as
objects.  Keys are ``name|data directory`` and are kept with the version of
that data, so different or changed inputs never mix.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import shared_dir
from ledgerline.sources.tables import data_version

_STORE: dict[tuple[str, str, str], Any] = {}


def remember(spark: SparkSession, key: str, build: Callable[[], Any]) -> Any:
    k = (spark.sparkContext.applicationId, key, data_version(spark, key.partition("|")[2]))
    if k not in _STORE:
        val = build()
        if isinstance(val, DataFrame):
            shared_dir(spark)
            val = val.checkpoint(eager=True)
        _STORE[k] = val
    return _STORE[k]
