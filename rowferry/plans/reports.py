"""Reports over the run log: listings with job names, the newest runs and the operations summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowferry.operators.paging import newest


def run_report(runs: DataFrame, jobs: DataFrame, status: str = "") -> DataFrame:
    """Runs with their job's name, newest first; runs of a deleted job stay, nameless.

    Spark broadcasts the job list when its size allows and shuffles it when not.
    """
    picked = runs.where(F.col("status") == status) if status else runs
    names = jobs.select(F.col("id").alias("task_id"), F.col("name").alias("task_name"))
    return picked.join(names, "task_id", "left").orderBy(F.col("id").desc())


def latest_runs(runs: DataFrame, jobs: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` runs; they are picked before the names are looked up."""
    names = jobs.select(F.col("id").alias("task_id"), F.col("name").alias("task_name"))
    return newest(runs, "id", n).join(names, "task_id", "left").orderBy(F.col("id").desc())


def job_runs(runs: DataFrame, job_id: int, n: int = 0) -> DataFrame:
    """One job's runs, newest first."""
    mine = runs.where(F.col("task_id") == job_id)
    return newest(mine, "id", n) if n else mine.orderBy(F.col("id").desc())


def latest_files(runs: DataFrame) -> DataFrame:
    """Per job: its newest run, and the file of its newest successful run that wrote one."""
    with_file = (F.col("status") == "success") & (F.coalesce("file_path", F.lit("")) != "")
    return runs.groupBy("task_id").agg(
        F.max("id").alias("last_run"),
        F.max_by("status", "id").alias("last_status"),
        F.max_by("file_path", F.when(with_file, F.col("id"))).alias("file_path"),
    )


def run_summary(endpoints: DataFrame, jobs: DataFrame, runs: DataFrame, today) -> DataFrame:
    """One row of counts: endpoints, jobs, running jobs and runs started on ``today``."""
    zero = F.lit(0).cast("long")
    names = ["endpoints", "jobs", "running_jobs", "runs_today"]

    def part(df: DataFrame, **counts) -> DataFrame:
        return df.agg(*[counts.get(n, F.max(zero)).alias(n) for n in names])

    day = F.to_date(F.col("start_time")) == F.lit(today).cast("date")
    rows = (
        part(endpoints, endpoints=F.count("*"))
        .unionByName(part(jobs, jobs=F.count("*"), running_jobs=F.count_if(F.col("status") == "running")))
        .unionByName(part(runs, runs_today=F.count_if(day)))
    )
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
