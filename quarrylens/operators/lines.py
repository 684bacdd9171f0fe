"""Source lines: rules that read lines, search with context, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.paths import glob_match
from quarrylens.functions.text import basic_regex, rstrip, strip

#: What ends a line, as str.splitlines() has it.
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
MAX_LENGTH = 80


def split_lines(text: Column) -> Column:
    """The lines of a text, cut at every line break there is, without an empty last one."""
    cut = F.split(text, BREAKS, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def source_lines(files: DataFrame, universal: bool = True) -> DataFrame:
    """path, lineno (from 1), text of files (path, text): cut at every line break there is, without an empty last line;
    or at newlines only, as SQL does."""
    cut = split_lines(F.col("text")) if universal else F.split("text", "\n", -1)
    return files.where("text is not null").select("path", F.posexplode(cut).alias("at", "text")).select("path", (F.col("at") + 1).alias("lineno"), "text")


def too_long(text: Column, limit: int = MAX_LENGTH) -> Column:
    """C002: longer than limit, unless it is a comment of one address, one word, or marked for a linter."""
    s = strip(text)
    address = s.startswith("#") & s.contains("http") & ~F.ltrim(s, F.lit("# ")).contains(" ")
    return (F.length(text) > limit) & ~(address | text.contains("pylint:") | text.contains("noqa") | ~s.contains(" "))


def bare_semicolon(text: Column) -> Column:
    """F003: a semicolon outside of quotes; quotes don't go over lines, and comment lines are exempt. Quoted parts, the
    last one closed or not, are cut out from the left."""
    s = strip(text)
    unquoted = F.regexp_replace(s, "\"[^\"]*(\"|$)|'[^']*('|$)", "")
    return s.contains(";") & ~s.startswith("#") & unquoted.contains(";")


def line_violations(lines: DataFrame, limit: int = MAX_LENGTH, ignore: tuple[str, ...] = ()) -> DataFrame:
    """rule, path, line, context: F001 to F004 and C002 from one pass over the lines, without the rules to ignore."""
    text = F.col("text")
    stripped = strip(text)
    before = Window.partitionBy("path").orderBy("lineno").rowsBetween(Window.unboundedPreceding, -1)
    blanks = F.col("lineno") - F.coalesce(F.last(F.when(stripped != "", F.col("lineno")), True).over(before), F.lit(0)) - 1
    kept = lines.withColumn("blanks", blanks)
    hit = lambda rule, test, context: F.when(test, F.struct(F.lit(rule).alias("rule"), context.alias("context")))
    none = F.lit("")
    found = F.array(
        hit("F001", rstrip(text) != text, F.substring(text, -10, 10)), hit("F004", text.startswith("\t"), none), hit("F003", bare_semicolon(text), F.substring(stripped, 1, 40)),
        hit("C002", too_long(text, limit), F.concat(F.lit("len="), F.length(text))), hit("F002", text.rlike("^(def |class |async def )") & (F.col("lineno") > 1) & (F.col("blanks") < 2), F.substring(stripped, 1, 40)))
    return kept.select("path", F.col("lineno").alias("line"), F.explode(F.filter(found, lambda x: x.isNotNull() & ~x["rule"].isin(*ignore))).alias("v")).select("v.rule", "path", "line", "v.context")


def read_lines(lines: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Lines start to end of each file, both counted in; without an end up to line 100, so that a later start finds nothing."""
    return lines.where(F.col("lineno").between(start or 1, end or 100))


def grep(lines: DataFrame, pattern: str, ignore_case: bool = False, context: int = 0, limit: int | None = None, glob: str | None = None) -> DataFrame:
    """path, lineno, text, hit: lines that hold a basic regular expression, at most limit of them for each file, with context
    around them."""
    lines = lines.where(glob_match(F.element_at(F.split("path", "/"), -1), glob)) if glob else lines
    hits = lines.where(F.col("text").rlike(("(?i)" if ignore_case else "") + basic_regex(pattern))).select("path", F.col("lineno").alias("at"))
    if limit:
        hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("at"))).where(F.col("nth") <= limit).drop("nth")
    near = hits.select("path", F.explode(F.sequence(F.col("at") - context, F.col("at") + context)).alias("lineno"), "at")
    near = near.groupBy("path", "lineno").agg(F.max(F.col("lineno") == F.col("at")).alias("hit"))
    return lines.join(near, ["path", "lineno"])
