"""User-written table functions: rows of a partition in order, with a state, to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def table_function(step: Callable[[object, Row], tuple[object, Iterable[tuple]]], returns: str, start: object = None, finish: Callable[[object], Iterable[tuple]] | None = None) -> Callable[[DataFrame, list[str], list[str]], DataFrame]:
    """An operator ``run(df, partition_by, order_by)`` from a Python function.

    ``step(state, row)`` gives the next state and the rows to put out; every
    partition begins with ``start`` and ends with the rows of ``finish(state)``.
    Rows stream through, sorted by Spark: a partition is never held as a whole,
    and its state is all that grows with it.  Nulls in the keys are one
    partition; in the order they come first; an empty table gives no rows.
    """

    class Rows:
        def __init__(self):
            self.state, self.begun = start, False

        def eval(self, row: Row):
            self.begun = True
            self.state, out = step(self.state, row)
            yield from out

        def terminate(self):
            if self.begun and finish is not None:
                yield from finish(self.state)

    function = F.udtf(Rows, returnType=returns)
    return lambda df, partition_by, order_by: function(df.asTable().partitionBy(*partition_by).orderBy(*order_by))
