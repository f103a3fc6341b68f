"""Tables of any column names: inside an operator columns are c0, c1, ..., so that its own names can't clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Plain:
    """``df``: the table with columns c0, c1, ...; ``back``: what a select needs to name them as before."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.df = docs.toDF(*(f"c{i}" for i in range(len(self.names))))

    def name(self, column: str) -> str:
        """The new name of a column, which is matched as Spark does, without regard to case."""
        exact = [i for i, c in enumerate(self.names) if c == column] or [i for i, c in enumerate(self.names) if c.lower() == column.lower()]
        return f"c{exact[0]}"

    def back(self) -> list[Column]:
        return [F.col(f"c{i}").alias(c) for i, c in enumerate(self.names)]
