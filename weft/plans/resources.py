"""What a task asks of executors: cores and memory, as a profile of Spark's stage-level scheduling.

Clusters whose manager can schedule by stage (YARN, Kubernetes, standalone) get a profile for the stages of a mapped task; elsewhere, as with a local master, the
session's own executors do the work and the hint has no effect.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession

# From this number on, cores are given in units of which 1024 make one.
UNITS, UNIT = 64, 1024


def _number(raw: Any) -> float | None:
    """A positive number, also if it is given as text; None for others."""
    try:
        x = float(str(raw).strip())
    except ValueError:
        return None
    return x if math.isfinite(x) and x > 0 else None


@dataclass(frozen=True)
class Compute:
    """cpus: cores of a task, parts of one too. memory: MB of an executor."""

    cpus: float | None = None
    memory: int | None = None

    @staticmethod
    def of(raw: dict[str, Any] | None) -> Compute | None:
        """From `cpu` and `memory`; None if neither is a positive number."""
        raw = raw if isinstance(raw, dict) else {}
        cpus, memory = _number(raw.get("cpu")), _number(raw.get("memory"))
        if cpus is not None and cpus >= UNITS:
            cpus /= UNIT
        return Compute(cpus, math.ceil(memory) if memory else None) if cpus or memory else None


def schedulable(spark: SparkSession) -> bool:
    """Whether the cluster manager takes profiles."""
    return spark.sparkContext.master.startswith(("yarn", "k8s:", "spark:"))


def profile(compute: Compute, new_executors: bool) -> ResourceProfile:
    """new_executors: with dynamic allocation executors are started for the profile; without it only what a task takes can be told."""
    builder = ResourceProfileBuilder()
    builder.require(TaskResourceRequests().cpus(max(1, math.ceil(compute.cpus or 1))))
    if new_executors:
        own = ExecutorResourceRequests().cores(max(1, math.ceil(compute.cpus or 1)))
        builder.require(own.memory(f"{compute.memory}m") if compute.memory else own)
    return builder.build


def profile_for(spark: SparkSession, compute: Compute | None) -> ResourceProfile | None:
    """The profile for a mapped task's stages; None where there is no hint or the cluster can't follow it."""
    if compute is None or not schedulable(spark):
        return None
    return profile(compute, spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true")
