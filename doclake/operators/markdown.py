"""Markdown rules on tables of documents: ``DataFrame -> DataFrame``, usable with ``df.transform``.

A document is one row, so none of these shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions import entities
from doclake.functions import markdown as rules


def _on_column(rule: Callable[[Column], Column]) -> Callable[..., DataFrame]:
    def apply(docs: DataFrame, col: str = "text") -> DataFrame:
        return docs.withColumn(col, rule(F.col(col)))
    apply.__name__ = rule.__name__
    apply.__doc__ = rule.__doc__
    return apply


unescape = _on_column(entities.unescape)
strip_private_glyphs = _on_column(rules.strip_private_glyphs)
fix_bullets = _on_column(rules.fix_bullets)
merge_headings = _on_column(rules.merge_headings)
join_wrapped = _on_column(rules.join_wrapped)
normalize_depths = _on_column(rules.normalize_depths)
despace = _on_column(rules.despace)
tighten = _on_column(rules.tighten)
leftover_symbols = _on_column(rules.leftover_symbols)
collapse_spaces = _on_column(rules.collapse_spaces)
relevel_headings = _on_column(rules.relevel_headings)
clean_markdown = _on_column(rules.clean_markdown)
