"""Scalar functions and table functions of the engine for SQL text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.functions.prerequisites import least_courses


class Cells(HTMLParser):
    """Rows of the tables of a page: (table, row, cells), texts squashed."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, list[str]]] = []
        self.table = self.row = -1
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr" and self.table >= 0:
            self.row += 1
            self.rows.append((self.table, self.row, []))
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1][2].append(" ".join("".join(self.cell).split()))
            self.cell = None


class HtmlTables:
    """Table function: html to (table, row, cells)."""

    def eval(self, html: str) -> Iterator[tuple]:
        parser = Cells()
        parser.feed(html or "")
        yield from parser.rows


class Occurrences:
    """Table function: text and a word to the spans (start, end) of the word, upper and lower case alike."""

    def eval(self, text: str, needle: str) -> Iterator[tuple]:
        text, needle = (text or "").lower(), (needle or "").lower()
        at = text.find(needle) if needle else -1
        while at >= 0:
            yield at, at + len(needle)
            at = text.find(needle, at + len(needle))


def register(spark: SparkSession) -> None:
    """Make ``least_courses``, ``html_tables`` and ``occurrences`` known to SQL."""
    spark.udf.register("least_courses", F.udf(least_courses, "int", useArrow=True))
    spark.udtf.register("html_tables", F.udtf(HtmlTables, returnType="table_no: int, row_no: int, cells: array<string>"))
    spark.udtf.register("occurrences", F.udtf(Occurrences, returnType="start: int, stop: int"))
