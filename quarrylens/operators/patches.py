"""Unified diffs and edits of snapshots."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@")
#: Fixed value: how a diff says that the line before ends without a line break.
NO_BREAK = "\\ No newline at end of file"


def _lines(text: str) -> list[str]:
    """Lines with their \n; other line ends are part of a line, as in the counts of a diff."""
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def apply_diff(original: str, diff: str) -> str:
    """The text with every hunk put in at its line, moved by what earlier hunks added; context isn't compared.

    A hunk has as many old and new lines as its header says, whatever they begin with; an empty line is context. A hunk
    without old lines goes in behind the line that its header names.
    """
    out, shift, lines = _lines(original), 0, _lines(diff)
    at = 0
    while at < len(lines):
        head = HUNK.match(lines[at])
        at += 1
        if not head:
            continue
        old, more = (int(x) if x is not None else 1 for x in head.groups()[1:])
        place, gone, new = max(0, int(head[1]) - (1 if old else 0)) + shift, 0, []
        while at < len(lines) and (gone < old or len(new) < more or lines[at].startswith(NO_BREAK)):
            line = lines[at]
            at += 1
            if line.startswith(NO_BREAK):
                if new and lines[at - 2][0] != "-":
                    new[-1] = new[-1].removesuffix("\n")
                continue
            mark = line[0] if line[0] in "+-" else " "
            gone += mark != "+"
            if mark != "-":
                new.append(line[1:] if line[0] in "+ " else line)
        out[place : place + gone] = new
        shift += len(new) - gone
    return "".join(out)


# Texts are of any length, and an Arrow batch counts rows alone: plain UDFs hold a hundred rows at a time.


@F.udf(StringType(), useArrow=False)
def patched(original: str | None, diff: str | None) -> str | None:
    """apply_diff on columns; null in, null out."""
    return None if original is None or diff is None else apply_diff(original, diff)


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (path, text) after edits (path, seq, new_content, unified_diff), those of a path in the order of seq; an edit
    with both or neither kind of change is left out, and the rest apply."""
    valid = edits.where(F.col("new_content").isNull() != F.col("unified_diff").isNull())
    per = valid.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "new_content", "unified_diff"))).alias("edits"))
    return files.join(per, "path", "full").select("path", _edited("text", F.transform("edits", lambda e: F.struct(e["new_content"].alias("n"), e["unified_diff"].alias("d")))).alias("text"))


@F.pandas_udf(StringType())
def _edited(text: pd.Series, edits: pd.Series) -> pd.Series:
    out = []
    for t, es in zip(text, edits, strict=True):
        for e in es if es is not None else ():
            t = e["n"] if e["n"] is not None else apply_diff(t or "", e["d"])
        out.append(t)
    return pd.Series(out, dtype=object)


@F.udf(StructType([StructField("added", IntegerType()), StructField("removed", IntegerType()), StructField("diff", StringType())]), useArrow=False)
def line_changes(old: str | None, new: str | None) -> tuple[int, int, str]:
    """How many lines two texts add and take away, and their unified diff in hunks; a null text has no lines."""
    lines = list(difflib.unified_diff(_lines(old or ""), _lines(new or ""), "a", "b"))
    body = lines[2:]
    return sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body), "".join(x if x.endswith("\n") else f"{x}\n{NO_BREAK}\n" for x in lines)
