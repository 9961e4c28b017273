"""Which device a detector or model runs on, and the resource profile of its stage."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In the order of choice.
CUDA, MPS, CPU = "cuda", "mps", "cpu"
log = logging.getLogger(__name__)


def chosen(asked: Column, cuda: Column, mps: Column) -> Column:
    """What was asked for, else the first device that is there."""
    return F.when(F.coalesce(asked, F.lit("")) != "", asked).when(cuda, CUDA).when(mps, MPS).otherwise(CPU)


def device(asked: str | None = None) -> str:
    """The same within a task, for functions that load a model there."""
    if asked:
        return asked
    try:
        import torch
    except ImportError:
        return CPU
    if torch.cuda.is_available():
        return CUDA
    mps = getattr(torch.backends, "mps", None)
    return MPS if mps is not None and mps.is_available() else CPU


def profile(asked: str | None, cores: int = 1, gpus: float = 1, memory: str | None = None) -> ResourceProfile | None:
    """The profile of a stage on a device: a GPU (or share of one) a task for cuda; for cpu its cores alone; none where nothing is asked for."""
    if not asked:
        return None
    tasks = TaskResourceRequests().cpus(cores)
    executors = ExecutorResourceRequests().cores(max(1, cores))
    if memory:
        executors = executors.memory(memory)
    if asked == CUDA:
        tasks, executors = tasks.resource("gpu", gpus), executors.resource("gpu", max(1, int(gpus)))
    return ResourceProfileBuilder().require(tasks).require(executors).build


def can_hold(spark: SparkSession) -> bool:
    """Whether the cluster manager gives stages profiles of their own; a session on one machine does not."""
    return not spark.sparkContext.master.startswith("local")


def on_device(df: DataFrame, run: Callable, schema: str, wanted: ResourceProfile | None) -> DataFrame:
    """df.mapInPandas(run, schema) with a profile, where the cluster holds them; else without, which the log says."""
    if wanted is None:
        return df.mapInPandas(run, schema)
    if not can_hold(df.sparkSession):
        log.warning("No resource profiles on master %s: the stage runs with what its executors have.", df.sparkSession.sparkContext.master)
        return df.mapInPandas(run, schema)
    return df.mapInPandas(run, schema, profile=wanted)
