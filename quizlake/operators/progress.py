"""Attempts over time, for every user and module at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.functions.text import iso_minutes, percent_text
from quizlake.operators.keys import rank_rows

# The column headings of the history report.
HISTORY_HEADINGS = {
    "timestamp": "Date & Time",
    "score": "Score",
    "total": "Total",
    "percentage": "Percentage (%)",
}


def progress_summary(performance: DataFrame) -> DataFrame:
    """Attempts, mean of the percentages and best percentage; partial sums before the shuffle."""
    return performance.groupBy("user_id", "module_id").agg(
        F.count("*").alias("attempts"),
        F.avg("percentage").alias("average"),
        F.max("percentage").alias("best"),
    )


def progress_metrics(summary: DataFrame) -> DataFrame:
    """The summary as the three tiles a user sees."""
    return summary.select(
        "user_id",
        "module_id",
        F.col("attempts").alias("total_attempts"),
        percent_text(F.col("average")).alias("average_score"),
        percent_text(F.col("best")).alias("best_score"),
    )


def trend(performance: DataFrame) -> DataFrame:
    """Points of the progress line, in time order within user and module.

    A range-partitioned sort: the rows of a hot user spread over many ranges. performance_id
    settles equal times.
    """
    return performance.select(
        "user_id", "module_id", "performance_id", "timestamp", "percentage"
    ).orderBy("user_id", "module_id", "timestamp", "performance_id")


def placed(performance: DataFrame) -> DataFrame:
    """Attempts with their place in time from 1 within user and module, a null time first.

    The order is data here, for readers that get rows in any order. No user's attempts are sorted in
    one task: places are counted over ranges.
    """
    return rank_rows(performance, ["timestamp", "performance_id"], "place", ["user_id", "module_id"])


def trend_places(performance: DataFrame) -> DataFrame:
    """The points of ``trend`` with their places along the line."""
    return placed(performance).select("user_id", "module_id", "place", "performance_id", "timestamp", "percentage")


def history(performance: DataFrame) -> DataFrame:
    """The history report with minute precision and display headings, each attempt with its place.

    The attempt's id stays as the key, since minutes alone do not tell attempts apart.
    """
    return placed(performance).select(
        "user_id",
        "module_id",
        "performance_id",
        "place",
        iso_minutes(F.col("timestamp")).alias("timestamp"),
        "score",
        "total",
        "percentage",
    ).withColumnsRenamed(HISTORY_HEADINGS)
