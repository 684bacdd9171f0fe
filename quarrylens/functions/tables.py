"""Table functions for SQL: the facts of source files, and grades of the steps of an episode."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

KINDS = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType(), "array<int>": ArrayType(IntegerType()), "array<string>": ArrayType(StringType())}


def _need(table: AnalyzeArgument, *names: str) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE")
    have = {f.name for f in table.dataType.fields}
    if missing := [n for n in names if n not in have]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return table.dataType


class AstFacts:
    """ast_facts(TABLE(files)): the node table of files (path, text), as operators.astfacts gives it; other columns of the table
    come along under their names with file_ before them."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        from quarrylens.operators import astfacts

        own = _need(files, "path", "text")
        more = [StructField(f"file_{f.name}", f.dataType) for f in own.fields if f.name not in ("path", "text")]
        return AnalyzeResult(StructType([*(StructField(c, KINDS[t]) for c, t in astfacts.COLUMNS.items()), *more]))

    def eval(self, row) -> Iterator[tuple]:
        from quarrylens.operators import astfacts

        rest = [row[n] for n in row.__fields__ if n not in ("path", "text")]
        for r in astfacts.facts(row["path"], row["text"]):
            yield (*(r.get(c) for c in astfacts.COLUMNS), *rest)


class DeltaScores:
    """delta_scores(TABLE(metrics)): each step of an episode, with the score of every number in the table against that of the
    episode's first step: the share that is gone, 1 where there was nothing. The table has episode_id and step, and
    is dealt by the first and read in the order of the second, whatever the query says."""

    @staticmethod
    def analyze(metrics: AnalyzeArgument) -> AnalyzeResult:
        own = _need(metrics, "episode_id", "step")
        scored = [f.name for f in own.fields if f.name not in ("episode_id", "step") and f.dataType.typeName() in ("integer", "long", "double", "float", "short")]
        if not scored:
            raise ValueError("the table has no numbers to score")
        keys = [StructField(n, own[n].dataType) for n in ("episode_id", "step")]
        return AnalyzeResult(StructType([*keys, *(StructField(f"{n}_score", DoubleType()) for n in scored)]), partitionBy=[PartitioningColumn("episode_id")], orderBy=[OrderingColumn("step")])

    def __init__(self) -> None:
        self.first = None

    def eval(self, row) -> Iterator[tuple]:
        names = [n for n in row.__fields__ if n not in ("episode_id", "step") and (row[n] is None or isinstance(row[n], (int, float)) and not isinstance(row[n], bool))]
        now = [row[n] for n in names]
        self.first = self.first or now
        yield (row["episode_id"], row["step"], *(None if a is None or b is None else 1.0 if b <= 0 else min(1.0, max(0.0, (b - a) / b)) for a, b in zip(now, self.first, strict=True)))


def register(spark: SparkSession) -> None:
    spark.udtf.register("ast_facts", udtf(AstFacts))
    spark.udtf.register("delta_scores", udtf(DeltaScores))
