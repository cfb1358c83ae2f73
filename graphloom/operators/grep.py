"""Line search over whole documents, after a node filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import is_literal, to_jvm


def lines(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each line: the other columns, line (from 1) and text, without line ends and without a line after the last."""
    keep = [c for c in docs.columns if c != raw]
    parts = F.split(F.col(raw), "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = docs.select(*keep, F.posexplode(whole).alias("_pos", "_line"))
    return rows.select(*keep, (F.col("_pos") + 1).alias("line"), F.regexp_replace("_line", r"\r\z", "").alias("text"))


def grep(docs: DataFrame, pattern: str, where: Column | None = None, raw: str = "raw") -> DataFrame:
    """First match of a pattern in each line: the other columns, line, text, start and end in bytes, end excluded.

    The filter runs before lines are made.  A pattern without metacharacters is
    searched as it stands; a bad one is refused at once.  Null documents have no
    lines; the empty pattern matches every line at 0.
    """
    if where is not None:
        docs = docs.where(where)
    text = F.col("text")
    if is_literal(pattern):
        at, found = F.instr(text, pattern), F.lit(pattern)
        if pattern:
            docs = docs.where(F.contains(raw, F.lit(pattern))) if "\n" not in pattern else docs
        hit = text.contains(pattern)
        at = F.lit(1) if not pattern else at
    else:
        jvm = to_jvm(pattern)
        hit = text.rlike(jvm)
        found = F.regexp_extract(text, f"(?:{jvm})", 0) if jvm.startswith("(?d)") else F.regexp_extract(text, jvm, 0)
        at = F.regexp_instr(text, F.lit(jvm))
    keep = [c for c in docs.columns if c != raw]
    start = F.octet_length(F.substring(text, F.lit(1), at - 1))
    out = lines(docs, raw).where(hit).select(*keep, "line", "text", start.alias("start"), F.octet_length(found).alias("_n"))
    return out.select(*keep, "line", "text", "start", (F.col("start") + F.col("_n")).alias("end"))


def fit_window(text: str, start: int, end: int, width: int = 512) -> str:
    """A line cut to a width of bytes around its match, with an ellipsis where something is left out."""
    raw = text.encode()
    if len(raw) <= width:
        return text
    room = max(width - (end - start), 0)
    low = max(0, min(start - room // 2, len(raw) - width))
    high = min(len(raw), low + width)
    body = raw[low:high].decode("utf-8", "ignore")
    return ("…" if low else "") + body + ("…" if high < len(raw) else "")


def highlight(text: str, start: int, end: int, before: str = "\x1b[1m", after: str = "\x1b[0m") -> str:
    """A line with its match, given in bytes, between two marks."""
    raw = text.encode()
    return raw[:start].decode("utf-8", "ignore") + before + raw[start:end].decode("utf-8", "ignore") + after + raw[end:].decode("utf-8", "ignore")
