"""Include and exclude rules over paths."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str  # substring, regex or inverted
    pattern: str


def parse_rules(text: str) -> list[Rule]:
    """One rule per line; blank lines don't count. r/ begins a regular expression, R/ an inverted one; anything else is a substring."""
    kinds = {"r/": "regex", "R/": "inverted"}
    return [Rule(kinds[line[:2]], line[2:]) if line[:2] in kinds else Rule("substring", line) for line in text.splitlines() if line.strip()]


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether Java's engine takes the pattern; one that it doesn't take matches nothing."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JError, PySparkException):
        return False
    return True


def matches(path: Column, rule: Rule, spark: SparkSession) -> Column:
    if rule.kind == "substring":
        return path.contains(F.lit(rule.pattern))
    hit = path.rlike(rule.pattern) if valid_pattern(spark, rule.pattern) else F.lit(False)
    return ~hit if rule.kind == "inverted" else hit


def any_match(path: Column, rules: list[Rule], spark: SparkSession) -> Column:
    return reduce(or_, (matches(path, r, spark) for r in rules), F.lit(False))


def mark_excluded(df: DataFrame, exclude: list[Rule], include: list[Rule] = (), path: str = "path") -> DataFrame:
    """Adds excluded and reincluded: a row is out if an exclude rule matches and no include rule does.

    Include rules mean nothing without exclude rules. The rules become one column expression, so they are pushed into
    the scan's stage and nothing is joined.
    """
    spark, c = df.sparkSession, F.col(path)
    out, back = any_match(c, list(exclude), spark), any_match(c, list(include), spark)
    return df.withColumn("excluded", out & ~back).withColumn("reincluded", out & back)


def kept(df: DataFrame, exclude: list[Rule], include: list[Rule] = (), path: str = "path") -> DataFrame:
    return mark_excluded(df, exclude, include, path).where(~F.col("excluded")).drop("excluded", "reincluded")


def suffix_filter(df: DataFrame, suffixes: list[str], hidden: bool = False, name: str = "name") -> DataFrame:
    """Names that end in one of the suffixes; hidden ones only if asked for. No suffix: no row."""
    ends = reduce(or_, (F.endswith(F.col(name), F.lit(s)) for s in suffixes), F.lit(False))
    return df.where(ends if hidden else ends & ~F.startswith(F.col(name), F.lit(".")))


def rule_rows(spark: SparkSession, exclude: list[Rule], include: list[Rule] = ()) -> DataFrame:
    rows = [("exclude", r.kind, r.pattern) for r in exclude] + [("include", r.kind, r.pattern) for r in include]
    return spark.createDataFrame(rows, "scope string, kind string, pattern string")
