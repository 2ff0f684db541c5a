"""Grade expressions. A grade is one value such as 第3级 or L2, or several joined by slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The special grades, most important first.
CORE, IMPORTANT = "核心数据", "重要数据"


def parts(grade: Column) -> Column:
    return F.filter(F.transform(F.split(grade, "/"), strip), lambda x: x != "")


def choose_grade(grade: Column, highest: bool = True) -> Column:
    """Of several grades 第n级 the one with the largest number (or, not highest, the smallest); others as they are."""
    numbers = F.transform(F.regexp_extract_all(grade, F.lit(r"第(\d+)级"), F.lit(1)), lambda x: x.cast("int"))
    chosen = F.array_max(numbers) if highest else F.array_min(numbers)
    return F.when(~F.contains(grade, F.lit("/")) | (F.size(numbers) == 0), grade).otherwise(F.concat(F.lit("第"), chosen, F.lit("级")))


def lowest_grade(grade: Column) -> Column:
    """The grade that a tree node shows: the special ones win, else the part with the largest number, the first of equals.

    A single grade comes back untouched.
    """

    def rank(x: Column, i: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("long"))
        return F.struct(
            F.when(x == CORE, 1).when(x == IMPORTANT, 2).otherwise(3).alias("tier"),
            F.when(x.isin(CORE, IMPORTANT), F.lit(0)).otherwise(-F.coalesce(F.array_max(numbers), F.lit(0))).cast("long").alias("order"),
            i.alias("i"),
            x.alias("grade"),
        )

    own = parts(grade)
    return F.when(F.size(own) <= 1, grade).otherwise(F.array_min(F.transform(own, rank))["grade"])


def normal_grade(grade: Column) -> Column:
    """A part of a grade, as the special one that it contains."""
    return F.when(F.contains(grade, F.lit(CORE)), F.lit(CORE)).when(F.contains(grade, F.lit(IMPORTANT)), F.lit(IMPORTANT)).otherwise(grade)


def grade_tier(grade: Column) -> Column:
    return F.when(F.contains(grade, F.lit(CORE)), 1).when(F.contains(grade, F.lit(IMPORTANT)), 2).otherwise(3)


def scene_type(grade: Column) -> Column:
    """3 for core data, 2 for important data, else 1."""
    return F.when(F.contains(grade, F.lit(CORE)), 3).when(F.contains(grade, F.lit(IMPORTANT)), 2).otherwise(1)
