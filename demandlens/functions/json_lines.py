"""Lines that hold one JSON value each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlens.functions.text import SPACE


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_one_value(text: Column) -> Column:
    """Whether a trimmed line is one value: not none, not two, and nothing behind it.

    Spark's parser stops after the first value. Only a single one is right both as an
    array's element and as a field.
    """
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return as_element.isNotNull() & as_field.isNotNull()


def one_value(text: Column) -> Column:
    """The value of a trimmed line, NULL where it is not exactly one."""
    return F.when(is_one_value(text), F.try_parse_json(text))
