"""Checks of scenes, as frames of violations."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_violations(scenes: DataFrame, shortest: int = 50, longest: int = 2000) -> DataFrame:
    """``(id, severity, message)`` of ``scenes(id, chapter_title, word_count)``: empty is an error, short or long a warning.

    A null count counts as empty; a null title shows as ``-``.
    """
    n = F.coalesce("word_count", F.lit(0))
    title = F.coalesce("chapter_title", F.lit("-"))
    severity = F.when(n == 0, "error").when((n < shortest) | (n > longest), "warning")
    message = F.when(n == 0, F.lit("empty")).when(n < shortest, F.concat(F.lit("too short: "), n, F.lit(f" < {shortest}, chapter "), title)).otherwise(F.concat(F.lit("too long: "), n, F.lit(f" > {longest}, chapter "), title))
    return scenes.select("id", severity.alias("severity"), message.alias("message")).where("severity is not null")


def combined(*results: DataFrame) -> DataFrame:
    """The violations of several validators as one frame: what is an error in any of them is one in the whole."""
    return reduce(DataFrame.unionByName, results)


def summary(violations: DataFrame) -> DataFrame:
    """``(severity, n)``."""
    return violations.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def assert_valid(violations: DataFrame) -> None:
    """Raise if there is any error."""
    worst = violations.where("severity = 'error'").limit(1).collect()
    if worst:
        raise ValueError(f"invalid scene {worst[0].id}: {worst[0].message}")
