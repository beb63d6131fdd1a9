"""Tables and images of Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.functions.markdown import BLANK, PIPE_LINE

_DASHES = rf"{BLANK}*+:?-++:?{BLANK}*+"
_DELIMITER = rf"{PIPE_LINE}{_DASHES}(?:\|{_DASHES})*+\|?{BLANK}*+\n"
_IMAGE_REFERENCE = r"!\[[^\]\n]*\]\([^)\n]*\)"


def _tables(text: Column) -> Column:
    """Tables, each as one string: a header, a line of dashes, and the pipe lines that follow."""
    table = rf"(?Umd)^{PIPE_LINE}.*+\n{_DELIMITER}(?:{PIPE_LINE}.*+\n)*+"
    return F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(table), F.lit(0))


def _rows(table: Column) -> Column:
    """Rows of a table as arrays of cells, without its second line."""
    lines = F.split(F.rtrim(table, F.lit("\n")), "\n", -1)
    content = F.filter(lines, lambda line, i: i != 1)

    def cells(line: Column) -> Column:
        inner = F.regexp_replace(line, rf"(?U)\A{BLANK}*+\||(?<!\\)\|{BLANK}*+\z", "")
        return F.transform(
            F.split(inner, r"(?<!\\)\|", -1),
            lambda c: F.replace(F.regexp_replace(c, rf"(?U)\A{BLANK}++|{BLANK}++\z", ""), F.lit("\\|"), F.lit("|")))

    return F.transform(content, cells)


def extract_tables(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """Cells ``(key, table_no, row_no, col_no, value)``; tables count from 1, row 0 is the header."""
    tables = docs.select(key, F.posexplode(_tables(F.col(col))).alias("t", "table"))
    rows = tables.select(key, (F.col("t") + 1).alias("table_no"), F.posexplode(_rows(F.col("table"))).alias("row_no", "r"))
    return rows.select(key, "table_no", "row_no", F.posexplode("r").alias("col_no", "value"))


def csv_tables(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """Each table as CSV text ``(key, table_no, csv)`` with minimal quoting and a header line."""
    def quoted(cell: Column) -> Column:
        return (F.when(cell.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"')))
                .otherwise(cell))

    def line(row: Column) -> Column:
        return F.when((F.size(row) == 1) & (row[0] == ""), '""').otherwise(
            F.array_join(F.transform(row, quoted), ","))

    return (docs.select(key, F.posexplode(_tables(F.col(col))).alias("t", "table"))
            .select(key, (F.col("t") + 1).alias("table_no"),
                    F.array_join(F.transform(_rows(F.col("table")), line), "\n").alias("csv")))


def count_artifacts(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """Number of tables and images per document, whatever the export options are."""
    images = rf"{C.IMAGE_PLACEHOLDER}|{_IMAGE_REFERENCE}"
    return docs.select(key, F.size(_tables(F.col(col))).alias("n_tables"),
                       F.regexp_count(F.col(col), F.lit(images)).alias("n_images"))


def image_mode(text: Column, include: Column) -> Column:
    """Local images as ``images/<base name>`` where ``include`` holds, a placeholder elsewhere; locations stay."""
    local = r"(!\[[^\]\n]*\]\()(?![A-Za-z][A-Za-z0-9+.-]*:)(?:[^)\n]*/)?([^)/\n]+\))"
    relative = F.regexp_replace(text, local, "$1images/$2")
    hidden = F.regexp_replace(text, _IMAGE_REFERENCE, C.IMAGE_PLACEHOLDER)
    return F.when(include, relative).otherwise(hidden)


def apply_image_mode(docs: DataFrame, include: Column, col: str = "text") -> DataFrame:
    """``image_mode`` on a column."""
    return docs.withColumn(col, image_mode(F.col(col), include))
