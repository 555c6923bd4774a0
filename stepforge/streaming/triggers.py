"""Retrieval triggers of live trajectories: each fires at the first step whose state matches its target, and never again.

A stream of steps (trajectory, step, observation, url) is joined with the table of targets (trajectory, target_observation,
target_url), and whether a step matches is told row by row. What must outlive a batch is one row a trajectory: the step it
fired at. It is kept in Spark's state store with the stream's checkpoint, so a restarted stream, or a lost executor, neither
fires again nor forgets.

Defined results: of the matching steps of one batch the smallest fires; a later batch never moves it, whatever its steps;
trajectories without a target never fire; steps without a trajectory or number are left out; repeated steps are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stepforge.functions.similarity import state_match

FIRED = "trajectory string, step long"


def matching_steps(steps: DataFrame, targets: DataFrame, least: float = 0.95) -> DataFrame:
    """trajectory and step of the steps that match their trajectory's target."""
    wanted = targets.select("trajectory", "target_observation", "target_url")
    known = steps.filter("trajectory is not null and step is not null").join(wanted, "trajectory")
    matched = state_match(F.col("observation"), F.col("target_observation"), F.col("url"), F.col("target_url"), least)
    return known.filter(matched).select(F.col("trajectory").cast("string"), F.col("step").cast("long"))


def _once(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    steps = [part["step"].min() for part in rows if len(part)]
    if not state.exists and steps:
        state.update((int(min(steps)),))
        yield pd.DataFrame({"trajectory": [key[0]], "step": [int(min(steps))]})


def once_triggers(steps: DataFrame, targets: DataFrame, least: float = 0.95) -> DataFrame:
    """The stream of fired triggers (trajectory, step) of a stream of ``steps``."""
    found = matching_steps(steps, targets, least)
    return found.groupBy("trajectory").applyInPandasWithState(_once, FIRED, "step long", "append", GroupStateTimeout.NoTimeout)


def first_triggers(steps: DataFrame, targets: DataFrame, least: float = 0.95) -> DataFrame:
    """The same of a finished table: each trajectory's first matching step."""
    return matching_steps(steps, targets, least).groupBy("trajectory").agg(F.min("step").alias("step"))


#: Schedules that do not look at states: from a step's number, and where the retrieval is asked for.
SCHEDULES = ("none", "at_start", "every", "asked", "asked_until", "once_at")


def scheduled(name: str, step, asked=None, every: int = 10, limit: int = 0):
    """Whether a step retrieves under a schedule: never, at step 0, at each ``every``-th, where asked, where asked before
    step ``limit``, or at step ``limit`` alone. A null step never does."""
    if name not in SCHEDULES:
        raise ValueError(f"unknown schedule {name!r}")
    asked = F.coalesce(asked, F.lit(False)) if asked is not None else F.lit(False)
    tests = {"none": F.lit(False), "at_start": step == 0, "every": step % every == 0, "asked": asked, "asked_until": asked & (step < limit), "once_at": step == limit}
    return F.coalesce(step.isNotNull() & tests[name], F.lit(False))
