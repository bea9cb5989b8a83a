"""Column predicates shared by plans: blank texts, violated rules, present classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space, as a regular-expression class.
WHITE_SPACE = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def is_blank(text: Column) -> Column:
    """True for null and for texts of white space only (no-break spaces included)."""
    return text.isNull() | text.rlike(f"^[{WHITE_SPACE}]*$")


def has_boxes(boxes: Column) -> Column:
    """At least one entry; null counts as none."""
    return F.coalesce(F.size(boxes), F.lit(0)) > 0


def is_violated(violation: Column) -> Column:
    """Not null, and with a box entry or a reason that isn't blank."""
    return F.coalesce(
        violation.isNotNull() & (has_boxes(violation["bounding_box"]) | ~is_blank(violation["reason"])), F.lit(False)
    )
