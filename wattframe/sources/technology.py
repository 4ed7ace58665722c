"""Technology-cost tables: one CSV file per year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The columns keywords may name, and the years that exist.
COLUMNS = ["technology", "parameter", "value", "unit"]
YEARS = [2020, 2025, 2030, 2035, 2040, 2045, 2050]


def read_costs(spark: SparkSession, year: int, pattern: str) -> DataFrame:
    """Costs of one year with a ``year`` column; ``pattern`` holds ``%d`` for the year.

    An empty value is NULL; one that is no number fails the job.
    """
    if year not in YEARS:
        raise ValueError(f"no data for {year}; years are {YEARS}")
    costs = spark.read.option("header", True).csv(pattern % year)
    return costs.withColumns({"value": _number(F.col("value")), "year": F.lit(year)})


def _number(text: Column) -> Column:
    number = text.try_cast("double")
    bad = F.raise_error(F.format_string("not a number: %s", text))
    return F.when(number.isNull() & (F.trim(text) != ""), bad).otherwise(number)


def read_all_costs(spark: SparkSession, pattern: str, years: list[int] = YEARS) -> DataFrame:
    """Costs of several years in one table."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        (read_costs(spark, year, pattern) for year in years),
    )


def filter_costs(costs: DataFrame, **keywords: str | float) -> DataFrame:
    """Rows that equal every keyword, reduced to ``COLUMNS``; without keywords all of it."""
    unknown = set(keywords) - set(COLUMNS)
    if unknown:
        raise ValueError(f"cannot filter by {sorted(unknown)}")
    if not keywords:
        return costs
    matches: Column = reduce(
        lambda a, b: a & b, (F.col(name) == F.lit(value) for name, value in keywords.items())
    )
    return costs.select(*COLUMNS).filter(matches)
