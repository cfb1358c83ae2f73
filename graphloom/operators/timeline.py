"""The timeline: yearly and monthly periods with their documents in order of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a period entry's line.
ENTRY = r"^- (?:cites:: )?\[\[([^\]|]+)(?:\|[^\]]+)?\]\](?: — .*)? — (\d{4}-\d{2}-\d{2})$"


def periods(published: Column) -> Column:
    """Codes of the year and of the month of a date."""
    return F.array(F.date_format(published, "yyyy"), F.date_format(published, "yyyy-MM"))


def granularity(code: Column) -> Column:
    """yearly or monthly; null for what is no period."""
    month = F.try_to_timestamp(F.concat(code, F.lit("-01")), F.lit("yyyy-MM-dd"))
    return F.when(code.rlike(r"^\d{4}$"), "yearly").when(code.rlike(r"^\d{4}-\d{2}$") & month.isNotNull(), "monthly")


def heading(code: Column) -> Column:
    """A period's title: the year, or the month's name and the year."""
    return F.when(granularity(code) == "monthly", F.date_format(F.try_to_timestamp(F.concat(code, F.lit("-01")), F.lit("yyyy-MM-dd")), "MMMM yyyy")).otherwise(code)


def cascade(codes: Column) -> Column:
    """Distinct periods with the year of each month, in order."""
    months = F.filter(codes, lambda c: granularity(c) == "monthly")
    return F.array_sort(F.array_distinct(F.concat(F.filter(codes, lambda c: granularity(c).isNotNull()), F.transform(months, lambda c: F.substring(c, 1, 4)))))


def entries(documents: DataFrame, extra: str | None = None) -> DataFrame:
    """(period, granularity, doc_id, published, seq): each document once in each of its periods.

    ``documents`` has doc_id, published and seq, and perhaps a column of more periods.
    """
    codes = periods(F.col("published"))
    codes = cascade(F.concat(codes, F.coalesce(F.col(extra), F.array().cast("array<string>")))) if extra else codes
    rows = documents.where("published is not null").select("doc_id", "published", "seq", F.explode(codes).alias("period"))
    first = rows.groupBy("period", "doc_id").agg(F.min("seq").alias("seq"), F.min_by("published", "seq").alias("published"))
    return first.select("period", granularity(F.col("period")).alias("granularity"), "doc_id", "published", "seq")


def positions(rows: DataFrame) -> DataFrame:
    """Entries with pos: by date, and those of one date in order of arrival.

    Entries are numbered within their day, and the days of a period by what
    came before, so no task holds more than a day of a period.
    """
    rows = rows.withColumn("_day", F.to_date("published"))
    days = rows.groupBy("period", "_day").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("period").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("period", "_day").orderBy("seq", "doc_id"))
    numbered = rows.withColumn("_at", inner).join(days.select("period", "_day", before.alias("_before")), ["period", "_day"])
    return numbered.withColumn("pos", (F.col("_before") + F.col("_at")).cast("int")).select(*[c for c in rows.columns if c != "_day"], "pos")


def entry_line(doc_id: Column, title: Column, authors: Column, published: Column) -> Column:
    """The text of a period's entry."""
    title = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" — *"), title, F.lit("*"), F.when(F.size(authors) > 0, F.concat(F.lit(" ("), F.array_join(authors, ", "), F.lit(")"))).otherwise(""))).otherwise("")
    return F.concat(F.lit("- cites:: [["), doc_id, F.lit("]]"), title, F.lit(" — "), F.date_format(published, "yyyy-MM-dd"))


def parse_entry(line: Column) -> Column:
    """struct(doc_id, published) of an entry's line; null for any other."""
    return F.when(line.rlike(ENTRY), F.struct(F.regexp_extract(line, ENTRY, 1).alias("doc_id"), F.to_timestamp(F.regexp_extract(line, ENTRY, 2), "yyyy-MM-dd").alias("published")))


def remove(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries without those of removed documents (column id)."""
    return rows.join(removed.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
