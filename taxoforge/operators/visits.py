"""What users plug in: a visitor of whole entities, and keys to count per line."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Visitor(Protocol):
    """Made once per task; its rows are tuples of the schema's columns."""

    def visit(self, subject: str, facts: dict[str, list[str]]) -> Iterable[tuple]:
        """Rows for one entity: its objects by predicate, both in order."""

    def result(self) -> Iterable[tuple]:
        """Rows for all that the task has seen, at its end."""


def visit_entities(triples: DataFrame, make: Callable[[], Visitor], schema: str) -> DataFrame:
    """The rows that visitors give for the entities of triples (s, p, o), repeated triples once. An entity's triples come
    together in one task, which holds one entity at a time."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        visitor, at, facts = make(), None, {}
        for pdf in batches:
            rows: list[tuple] = []
            for s, p, o in zip(pdf["s"], pdf["p"], pdf["o"]):
                if facts and s != at:
                    rows += visitor.visit(at, facts)
                    facts = {}
                at = s
                facts.setdefault(p, []).append(o)
            yield pd.DataFrame(rows, columns=names)
        rows = list(visitor.visit(at, facts)) if facts else []
        yield pd.DataFrame(rows + list(visitor.result()), columns=names)

    return triples.select("s", "p", "o").distinct().repartition("s").sortWithinPartitions("s", "p", "o").mapInPandas(run, schema)


def count_keys(lines: DataFrame, keys: Callable[[Column], Column], column: str = "value") -> DataFrame:
    """key, n: how often the lines give each key; ``keys`` makes an array of keys of a line."""
    return lines.select(F.explode(keys(F.col(column))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def entity_function(visitors: dict[str, tuple[Callable[[], Visitor], str]]) -> type:
    """A table function of SQL for named visitors, each with the schema of its rows:

    ``SELECT * FROM f(TABLE(triples), 'name')`` calls the visitor for each subject, with its distinct triples in order.
    Its schema follows the name; the table is dealt and sorted by what the function itself asks for. ``result`` is called
    after each subject, as the function knows no end of a task. Register with ``spark.udtf.register``.
    """
    schemas = {name: StructType.fromDDL(ddl) for name, (_, ddl) in visitors.items()}

    class Entities:
        @staticmethod
        def analyze(table: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or not {"s", "p", "o"} <= set(table.dataType.names):
                raise ValueError("the first argument must be a table with s, p and o")
            if name.value not in schemas:
                raise ValueError(f"no visitor is called {name.value}")
            return AnalyzeResult(schemas[name.value], partitionBy=[PartitioningColumn("s")], orderBy=[OrderingColumn("p"), OrderingColumn("o")])

        def __init__(self) -> None:
            self.subject: str | None = None
            self.facts: dict[str, list[str]] = {}
            self.name = ""

        def eval(self, row: Row, name: str) -> None:
            self.subject, self.name = row["s"], name
            known = self.facts.setdefault(row["p"], [])
            if not known or known[-1] != row["o"]:  # in order, so a repeated triple follows itself
                known.append(row["o"])

        def terminate(self) -> Iterator[tuple]:
            if self.facts:
                visitor = visitors[self.name][0]()
                yield from visitor.visit(self.subject, self.facts)
                yield from visitor.result()

    return udtf(Entities)
