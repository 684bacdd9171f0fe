"""Scalar functions on text and records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What Python's str.strip takes for white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def basic_regex(pattern: str) -> str:
    """The Java pattern of a POSIX basic regular expression: braces, parentheses, bars, plus and question mark are plain unless
    a backslash stands before them, a star at the start is plain, anchors count at the ends only."""
    out, at, start = [], 0, True
    while at < len(pattern):
        c, after = pattern[at], pattern[at + 1 : at + 2]
        if c == "\\" and after:
            out.append({"<": r"\b", ">": r"\b"}.get(after) or (after if after in "(){}|+?" else "\\" + after))
            start = after in "(|"
            at += 2
            continue
        if c == "[":
            end = pattern.find("]", at + 2 + (after == "^"))
            while end > 0 and pattern[end - 1] == ":" and pattern.rfind("[:", at + 1, end - 1) > pattern.rfind(":]", at + 1, end - 1):
                end = pattern.find("]", end + 1)  # that was the end of a class such as [:alpha:]
            if end < 0:
                out.append("\\[")
            else:
                inner = re.sub(r"\[:(\w+):\]", lambda m: POSIX.get(m[1], ""), pattern[at + 1 : end].replace("\\", "\\\\"))
                out.append("[" + re.sub(r"(?<!^)\[|&&", lambda m: "".join("\\" + x for x in m[0]), inner) + "]")
                at = end
        elif c == "*" and start:
            out.append("\\*")
        elif c == "^":
            out.append("^" if start else "\\^")
        elif c == "$":
            out.append("$" if at + 1 == len(pattern) or pattern[at + 1 : at + 3] in ("\\)", "\\|") else "\\$")
        else:
            out.append("\\" + c if c in "(){}|+?" else c)
        start = c == "^" and start
        at += 1
    return "".join(out)


#: Named classes of characters in Java patterns.
POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "blank": r"\p{Blank}", "xdigit": r"\p{XDigit}"}


def csv_line(text: Column, separator: str = ",") -> Column:
    return F.transform(F.split(text, f"\\Q{separator}\\E", -1), lambda x: F.trim(x))


def key_value(text: Column, separator: str = "=") -> Column:
    """A map of one entry, or null without a separator."""
    parts = F.split(text, f"\\Q{separator}\\E", 2)
    return F.when(F.size(parts) == 2, F.create_map(F.trim(parts[0]), F.trim(parts[1])))


def normalize_score(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - lo, hi - lo))))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def slugify(text: Column) -> Column:
    """Lower case, only letters, digits, underscores and single hyphens, none at the ends."""
    kept = F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), "^-+|-+$", "")


def counts_in(text: Column, word: str) -> Column:
    """The number before a word such as passed, failed or error in a tool's report; 0 without one."""
    found = F.regexp_extract(text, rf"(\d+) {word}", 1)
    return F.when(found == "", 0).otherwise(found.cast("int"))


def iso_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def strip_fence(text: Column) -> Column:
    """JSON out of a Markdown code fence."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def arrow(before: Column, after: Column) -> Column:
    return F.concat(before.cast("string"), F.lit(" → "), after.cast("string"))


#: Fixed value: what stands behind a text that has been cut.
CUT = "\n… [truncated to 8 KB]"


def truncate_bytes(text: Column, limit: int | Column = 8192, said: str = CUT) -> Column:
    """A text of up to limit bytes as it is; of a longer one the first limit bytes and what is said of the cut, with a
    replacement character for one that is cut. An empty text is null."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.make_valid_utf8(F.encode(text, "UTF-8").substr(F.lit(1), limit.cast("int")).cast("string"))
    return F.when(F.octet_length(text) <= limit, F.when(text != "", text)).otherwise(F.concat(head, F.lit(said)))
