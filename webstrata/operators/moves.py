"""Carrying out plans that move, copy or link files of an archive.

A move may go to where another move comes from: chains, swaps and longer circles. Joins of sources and targets find
those moves. They are done in two steps with a barrier between: all of them first leave for names of
their own, then all arrive. So no order is needed within a step, and tasks may run anywhere and be run
again. A journal in the shared folder says which step is over, so a plan that was broken off can be resumed.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.plans.runtime import cut

ACTIONS = ("move", "copy", "hardlink", "symlink")


def checked(plan: DataFrame) -> DataFrame:
    """``plan`` (source, target, action) with ``waits``: whether the move has to leave before it can arrive.

    Raises for targets that two rows share, for unknown actions, and for copies of or links to files
    that the plan moves or overwrites, whose result would depend on the order.
    """
    rows = cut(plan.select("source", "target", "action").where(F.col("source") != F.col("target")))
    twice = rows.groupBy("target").count().where("count > 1")
    sources = rows.groupBy("source").agg(F.count_if(F.col("action") == "move").alias("moves"), F.count(F.lit(1)).alias("uses"))
    torn = sources.where("moves > 1 or (moves = 1 and uses > 1)").select("source")
    moved = rows.where("action = 'move'").select(F.col("source").alias("_moved"))
    read = rows.where("action <> 'move'").select(F.col("source").alias("_read"))
    lost = rows.join(read, F.col("target") == F.col("_read"), "left_semi").select("target")
    odd = rows.where(~F.col("action").isin(*ACTIONS)).select("action")
    for found, what in ((odd, "unknown action"), (twice, "several files for one target"), (torn, "a file that is moved has other uses"), (lost, "a file that is copied or linked is overwritten")):
        one = found.first()
        if one is not None:
            raise ValueError(f"{what}: {one[0]}")
    return cut(rows.join(moved, F.col("target") == F.col("_moved"), "left").withColumn("waits", F.col("_moved").isNotNull()).drop("_moved"))


def _place(folder: str, path: str) -> str:
    place = os.path.normpath(os.path.join(folder, path))
    if not place.startswith(os.path.normpath(folder) + os.sep):
        raise ValueError(f"{path} is not below {folder}")
    return place


def _step(rows: DataFrame, folder: str, name: str, overwrite: bool) -> DataFrame:
    """One step of all rows, by the tasks that hold them: leave, arrive or (for those that need not wait) do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, target, action in zip(batch["source"], batch["target"], batch["action"]):
                here, there = _place(folder, source), _place(folder, target)
                os.makedirs(os.path.dirname(there), exist_ok=True)
                between = f"{there}.moving"
                if name == "leave":
                    if os.path.lexists(here) and not os.path.lexists(between):
                        os.rename(here, between)
                    continue
                if os.path.lexists(there) and not overwrite and (name == "arrive" and os.path.lexists(between) or name == "do" and os.path.lexists(here) and not _same(here, there, action)):
                    raise FileExistsError(there)
                if name == "arrive":
                    if os.path.lexists(between):
                        os.replace(between, there)
                elif action == "move":
                    if os.path.lexists(here):
                        os.replace(here, there)
                elif not _same(here, there, action):
                    part = f"{there}.{os.getpid()}.part"
                    {"copy": shutil.copyfile, "hardlink": os.link, "symlink": lambda a, b: os.symlink(os.path.relpath(a, os.path.dirname(there)), b)}[action](here, part)
                    os.replace(part, there)
            yield batch[["target", "action"]]

    return rows.select("source", "target", "action").mapInPandas(run, "target string, action string")


def _same(here: str, there: str, action: str) -> bool:
    """Whether a copy or link is there already."""
    if action == "move" or not os.path.lexists(there):
        return False
    if action == "symlink":
        return os.path.islink(there) and os.path.realpath(there) == os.path.realpath(here)
    if action == "hardlink":
        return os.path.samefile(here, there)
    with open(here, "rb") as a, open(there, "rb") as b:
        while True:
            x, y = a.read(1 << 20), b.read(1 << 20)
            if x != y or not x:
                return x == y


def relocate(plan: DataFrame, folder: str, journal: str, overwrite: bool = False) -> int:
    """Carry out a plan (source, target, action; paths below ``folder``, which all machines share); the number of rows.

    ``journal`` is a folder for the progress of this plan, new for each plan. Copies and links are made first, from
    files that the plan leaves alone; then moves leave, then they arrive. ``overwrite`` lets files go that are in the way.
    """
    spark = plan.sparkSession
    os.makedirs(journal, exist_ok=True)

    def once(name: str, rows: DataFrame) -> None:
        done = f"{journal}/{name}"
        if not os.path.exists(f"{done}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(done)

    once("plan", checked(plan))
    rows = spark.read.parquet(f"{journal}/plan")
    waiting = rows.where("action = 'move' and waits")
    once("1-link", _step(rows.where("action <> 'move'"), folder, "do", overwrite))
    once("2-leave", _step(waiting, folder, "leave", overwrite))
    once("3-move", _step(rows.where("action = 'move' and not waits"), folder, "do", overwrite))
    once("4-arrive", _step(waiting, folder, "arrive", overwrite))
    return rows.count()
