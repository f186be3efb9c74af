"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder as shared_folder

#: The characters that count as white space (Unicode, as str.isspace has them).
WHITE_SPACE = r"\x09-\x0d\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The characters that don't, as ranges: a negated class of this many ranges is matched ten times slower.
WORD_SIGN = r"[\x00-\x08\x0e-\x1b!-\x{84}\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]"
#: A line that is, trimmed, a figure or equation marker.
MARKER_LINE = r"(?m)^[" + WHITE_SPACE + r"&&[^\n\r]]*<!-- (?:figure|equation): \d+ -->[" + WHITE_SPACE + r"&&[^\n\r]]*$"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without_marker_lines(text: Column) -> Column:
    return F.regexp_replace(text, MARKER_LINE, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, where plain columns would be repeated by the optimizer."""
    return F.transform(F.array(value), body)[0]
