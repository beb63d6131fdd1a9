"""HTML character references as a column expression, in a single pass over the text."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.arrays import let, replace_tokens

REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)"
# Numbers that HTML maps to another character: zero, carriage return and the Windows-1252 range.
REMAPPED = {n: html.unescape(f"&#{n};") for n in (0, 13, *range(128, 160))}
_COMMON = {f"&{name}": html5[name] for name in ("amp;", "lt;", "gt;", "quot;", "nbsp;")}


def _literal_map(pairs: dict) -> Column:
    # parsed once by the optimizer; thousands of separate literals would only slow down planning
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _from_number(digits: Column, base: int, longest: int) -> Column:
    significant = F.regexp_replace(digits, "^0+", "")
    number = F.when(F.length(significant) <= longest,
                    F.conv(F.concat(F.lit("0"), significant), base, 10).cast("int"))

    def decode(n: Column) -> Column:
        low = n.bitwiseAND(0xFFFF)
        invalid = ((n.between(1, 31) & ~n.isin(9, 10, 12)) | (n == 127) | n.between(0xFDD0, 0xFDEF)
                   | low.isin(0xFFFE, 0xFFFF))
        return (F.when(F.coalesce(n > 0x10FFFF, F.lit(True)) | n.between(0xD800, 0xDFFF), "�")
                .when(n.isin(list(REMAPPED)), F.element_at(_literal_map(REMAPPED), n.cast("string")))
                .when(invalid, "")
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
    return let(number, decode)


def _named(token: Column) -> Column:
    names = _literal_map(html5)
    legacy = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    name = F.substring(token, 2, 40)

    def longest_prefix(t: Column) -> Column:
        prefix = F.regexp_extract(t, "^&(" + "|".join(legacy) + ")", 1)
        return F.when(prefix != "", F.concat(F.try_element_at(names, prefix),
                                             F.substring(t, F.length(prefix) + 2, F.length(t)))).otherwise(t)
    return F.coalesce(F.try_element_at(names, name), longest_prefix(token))


def _resolve(token: Column) -> Column:
    common = F.coalesce(*[F.when(token == name, char) for name, char in _COMMON.items()])
    return (F.when(common.isNotNull(), common)
            .when(token.rlike("^&#[0-9]"), _from_number(F.regexp_extract(token, "([0-9]+)", 1), 10, 7))
            .when(token.startswith("&#"), _from_number(F.regexp_extract(token, "[xX]([0-9a-fA-F]+)", 1), 16, 6))
            .otherwise(_named(token)))


def unescape(text: Column) -> Column:
    """``&amp;lt;`` becomes ``&lt;``: a replacement is not read again."""
    return let(text, lambda t: F.when(
        F.contains(t, F.lit("&")), replace_tokens(t, REFERENCE, lambda found: F.transform(found, _resolve))).otherwise(t))
