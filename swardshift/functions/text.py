"""First-match string edits and tolerant parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strict import as_col


def replace_first(x: Column | str, literal: str, by: str) -> Column:
    """Replace the first occurrence of a literal only."""
    c = as_col(x)
    at = F.instr(c, literal)
    tail = F.substr(c, at + len(literal))
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.lit(by), tail)).otherwise(c)


def remove_first(x: Column | str, literal: str) -> Column:
    return replace_first(x, literal, "")


def strip_last_suffix(x: Column | str, sep: str = "_") -> Column:
    """Drop everything from the last separator on; unchanged without one."""
    s = re.escape(sep)
    return F.regexp_replace(as_col(x), f"{s}[^{s}]*$", "")


def truncate(x: Column | str, width: int = 50) -> Column:
    """At most ``width`` characters, the last three of a cut text being dots."""
    c = as_col(x)
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))).otherwise(c)


def to_number(x: Column | str) -> Column:
    """Parse a number; NULL where the text is none."""
    return as_col(x).try_cast("double")


def layer_year(name: Column | str) -> Column:
    """Year from the ``_yyyymm`` stamp in a raster layer name."""
    return F.regexp_extract(as_col(name), r"_(\d{4})\d{2}", 1).try_cast("int")


def layer_month(name: Column | str) -> Column:
    return F.regexp_extract(as_col(name), r"_\d{4}(\d{2})", 1).try_cast("int")
