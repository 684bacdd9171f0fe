"""Diffs go to Python in batches of few rows, however long their texts are."""

from __future__ import annotations

from quarrylens.operators import patches


def test_diffs_are_not_held_by_arrow_batches(spark):
    texts = spark.createDataFrame([("a\nb\n", "a\nc"), (None, "x\n"), ("", None)], "old string, new string")
    changes = texts.select("old", "new", patches.line_changes("old", "new").alias("l"))
    made = changes.select("new", "l.added", "l.removed", patches.patched("old", "l.diff").alias("text"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert {tuple(r) for r in made.collect()} == {("a\nc", 1, 1, "a\nc"), ("x\n", 1, 0, None), (None, 0, 0, "")}
