"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that workers need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="footmesh-"), "footmesh.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``, which all executors share, so that a lost
    executor loses nothing. On one machine a folder is made up where that is unset; a cluster without it
    is refused, as its executors share no temporary folder. Checkpoints of frames that are no longer
    used are removed by the engine where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="footmesh-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def map_groups(
    df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], Iterator[pd.DataFrame]], schema: str, order: list[str] | None = None
) -> DataFrame:
    """Run ``fn(key, rows)`` once a group and let it yield any number of frames.

    Unlike ``applyInPandas`` a group's output may be streamed in parts, so a group of few rows and
    many results needs no memory for all of them at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now: tuple | None = None
        for frame in frames:
            if frame.empty:
                continue
            new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
            new[0] = True
            starts = [*new.nonzero()[0], len(frame)]
            for a, b in zip(starts, starts[1:]):
                part = frame.iloc[a:b]
                key = tuple(part[k].iloc[0] for k in keys)
                if held and key != now:
                    yield from fn(now, pd.concat(held, ignore_index=True))
                    held = []
                now = key
                held.append(part)
        if held:
            yield from fn(now, pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInPandas(run, schema)


def stripped(c: Column) -> Column:
    """Without white space at either end, Unicode kinds included; empty text becomes null."""
    return F.nullif(F.regexp_replace(c, r"(?U)^[\s​﻿]+|[\s​﻿]+$", ""), F.lit(""))
