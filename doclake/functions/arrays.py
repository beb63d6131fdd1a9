"""Column idioms on arrays and strings that the built-in functions lack.

Everything here composes built-in higher-order functions, so it stays in the JVM and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Running fold: ``step(state, item) -> (new state, integer output)``; the outputs as an array of strings.

    A fold copies its accumulator at every step. Therefore the outputs gather in one string, which copies
    fast, and the fold runs in blocks of about the square root of the length: a document of a million lines
    stays cheap.
    """
    def folded(state: Column, codes: Column) -> Column:
        return F.struct(state.alias("state"), codes.alias("codes"))

    def fold_block(state: Column, block: Column) -> Column:
        def merge(acc, item):
            new_state, output = step(acc["state"], item)
            return folded(new_state, F.concat(acc["codes"], output.cast("string"), F.lit(",")))
        return F.aggregate(block, folded(state, F.lit("")), merge)

    def over_blocks(xs: Column) -> Column:
        length = F.greatest(F.lit(MIN_BLOCK), F.ceil(F.sqrt(F.size(xs)))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(xs), length), lambda i: F.slice(xs, i, length))
        codes = F.aggregate(
            blocks, folded(zero, F.lit("")),
            lambda acc, block: let(fold_block(acc["state"], block),
                                   lambda r: folded(r["state"], F.concat(acc["codes"], r["codes"]))),
            lambda acc: acc["codes"])
        return F.slice(F.split(codes, ","), F.lit(1), F.size(xs))

    return let(items, lambda xs: F.when(F.size(xs) > 0, over_blocks(xs)).otherwise(F.array().cast("array<string>")))


def replace_tokens(text: Column, pattern: str, compute: Callable[[Column], Column]) -> Column:
    """``regexp_replace`` with computed replacements.

    ``compute`` maps the array of all matches to an array of replacements of the same length. The
    pattern must not match the empty string.
    """
    def weave(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        gaps = F.split(t, pattern, -1)
        return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), compute(found)), gaps,
                                       lambda new, gap: F.concat(new, gap)), "")
    return let(text, weave)
