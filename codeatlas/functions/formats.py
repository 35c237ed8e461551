"""Lines of printed answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


def match_line(path: Column, line: Column, text: Column, captures: Column) -> Column:
    """path:line, the first 80 characters of a match's first line, and its captures in brackets."""
    head = F.left(X.trimmed(F.split(text, "\n")[0]), F.lit(80))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(captures)), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit("  "), head, F.when(pairs != "", F.concat(F.lit("  ["), pairs, F.lit("]"))).otherwise(""))


def match_count(n: int, more: bool) -> str:
    """The last line of a list of matches."""
    return f"{n} match{'' if n == 1 else 'es'}{' (truncated)' if more and n else ''}"


def result_line(path: Column, is_hub: Column, score: Column, importers: Column) -> Column:
    """A search result: path, whether it is a hub, its score with two digits, and its first two importers."""
    who = F.array_join(F.slice(importers, 1, 2), ", ")
    return F.concat(F.lit("  "), path, F.when(is_hub, " [hub]").otherwise(""), F.lit("  score="), F.format_string("%.2f", score), F.when(who != "", F.concat(F.lit(" <- "), who)).otherwise(""))


def evidence_line(matches: Column) -> Column:
    """The first three pieces of evidence: kind and value, and the line of symbols."""
    symbol = lambda m: F.concat(F.coalesce(F.concat(m["symbol_kind"], F.lit(":")), F.lit("")), m["value"], F.coalesce(F.concat(F.lit("@"), m["line"].cast("string")), F.lit("")))
    one = lambda m: F.when(m["kind"] == "symbol", symbol(m)).otherwise(F.concat_ws(":", m["kind"], m["value"]))
    return F.array_join(F.transform(F.slice(matches, 1, 3), one), " | ")


def padded(text: Column, width: int) -> Column:
    """A table cell: cut or filled with blanks to width."""
    return F.rpad(F.coalesce(text, F.lit("")), width, " ")
