"""Constants of the recordings as tables (SRC18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SESSIONS = (40, 40, 32, 30, 40, 32, 40, 30)
TRIALS_PER_SESSION = 750


def sessions(spark: SparkSession) -> DataFrame:
    """(subject, n_sessions, n_trials)."""
    return spark.createDataFrame([(i, n, n * TRIALS_PER_SESSION) for i, n in enumerate(SESSIONS)], "subject int, n_sessions int, n_trials int")


def epochs(spark: SparkSession) -> DataFrame:
    """(part, first, n_trials) of the fast-presentation recording."""
    return spark.createDataFrame([("main", 0, 22_248), ("validation", 22_248, 2_400)], "part string, first int, n_trials int")


def run_grid(spark: SparkSession) -> DataFrame:
    """(subject, session, run) of the object recording: three subjects, twelve sessions, ten runs."""
    r = lambda n, name: spark.range(1, n + 1).selectExpr(f"cast(id as int) as {name}")
    return r(3, "subject").crossJoin(r(12, "session")).crossJoin(r(10, "run"))
