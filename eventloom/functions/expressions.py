"""Expressions about evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column) -> Column:
    """c, evaluated once a row where it stands. Without this the optimizer may copy an array into a lambda that uses it, and evaluate it again for each element. The condition always holds; an expression with a row counter is not copied."""
    return F.when(F.monotonically_increasing_id() >= 0, c)
