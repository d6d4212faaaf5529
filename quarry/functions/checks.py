"""Row-level checks that survive column pruning.

``assert_true`` in a column that is later dropped is pruned away by the
optimizer; ``guard`` ties the assertion to a value that the query keeps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guard(value, condition: Column, message: str | Column) -> Column:
    """`value` when `condition` holds; the query fails with `message` otherwise."""
    v = F.col(value) if isinstance(value, str) else value
    msg = message if isinstance(message, Column) else F.lit(message)
    return F.when(F.assert_true(condition, msg).isNull(), v)
