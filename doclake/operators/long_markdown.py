"""Markdown clean-up of documents too long for one row, on tables of lines.

The result is that of ``functions.markdown.clean_markdown`` on the whole text. A document is cut into blocks of
lines, each of which is cleaned as a text of its own; what crosses a border is handled in two ways:

* Rules that look at neighbouring lines never meet a border: blocks begin only at lines that neither join, nor are
  joined with, nor are set apart from the line above, whatever the rules make of both (``CUT``).
* Rules that carry a state along - the open symbol bullet, the stack of list indents, the heading levels - get it
  by a parallel scan: every block says what it does to any state, these effects are composed along the document
  (``scans.states_before``), and each block is cleaned from the state it starts in.

A run of lines without a possible border (notes below notes, items that all end in a comma) stays one block. A document
of no more lines than a block has nothing above or below it: it is one block, and all rules follow each other in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.functions import markdown as M
from doclake.functions.arrays import let
from doclake.operators.scans import states_before
from doclake.sources.scratch import freeze

LINES_PER_BLOCK = 1024
NO_LIMIT = 1 << 30

_SYMBOLS = "".join(C.BULLETS_BY_DEPTH).replace("-", "\\-")
# The line above ends in a character that no rule removes, so it stays where it is, and is not cut in mid-sentence.
_ABOVE = rf"(?<=[^\s\x1c-\x1fl{_SYMBOLS}-]\n)(?<!(?:{M.UNFINISHED})\n)"
# The line below has text, is no note and no bullet without text, and does not continue an item. It is a heading
# only where the line above cannot be a heading that holds a number alone.
_BELOW = (rf"(?=.*{M.INK})(?!{M.NOTE})(?!{M._empty_bullet('a')})(?! *(?:(?:- )?\[.?\] )?{M.SYMBOL} *\n)"
          rf"(?! *- (?:l )?[{_SYMBOLS} \t]*+(?:{M.CONTINUES}))"
          rf"(?:(?!#{{1,6}} )|(?<=[^{C.ROMAN_NUMERALS}\p{{Nd}}.)]\n))")
CUT = rf"(?Umd){_ABOVE}{_BELOW}"


def _joined(order: list[str], text: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), "")


def to_parts(lines: DataFrame, key: str, lines_per_block: int) -> DataFrame:
    """Parts ``key, part, head, tail`` of ``lines`` (``key, n, x``), the tail from the first line on where ``CUT`` allows a border.

    A first part that is not full is the whole document as a rule, and is left whole.
    """
    alone = (F.col("part") == 0) & (F.col("n_lines") < lines_per_block)
    cut = F.when(alone, F.array("text")).otherwise(F.split(M._strip_private_glyphs(F.col("text")), CUT, 2))
    parts = (lines.select(key, "n", F.concat("x", F.lit("\n")).alias("x"))
             .groupBy(key, F.floor(F.col("n") / lines_per_block).alias("part"))
             .agg(_joined(["n"], "x").alias("text"), F.count(F.lit(1)).alias("n_lines")).withColumn("cut", cut))
    return freeze(parts.select(key, "part", F.col("cut")[0].alias("head"), F.get("cut", F.lit(1)).alias("tail")), "parts")


def to_blocks(parts: DataFrame, key: str) -> DataFrame:
    """Blocks ``key, part, text`` that begin at the tails of ``parts``."""
    begins = parts.select(key, "part", F.when(F.col("tail").isNotNull(), F.col("part")).alias("begins"))
    # the lines before the first border of a part belong to the block that was begun last
    before = states_before(begins, key, "part", "begins", F.lit(-1), "bigint", lambda a, b: F.coalesce(b, a),
                           lambda effect, state: F.coalesce(effect, state), "block")
    heads = parts.join(before, [key, "part"]).select(key, "block", "part", F.lit(0).alias("side"), F.col("head").alias("text"))
    tails = (parts.filter(F.col("tail").isNotNull())
             .select(key, F.col("part").alias("block"), "part", F.lit(1).alias("side"), F.col("tail").alias("text")))
    return heads.unionByName(tails).groupBy(key, F.col("block").alias("part")).agg(_joined(["part", "side"], "text").alias("text"))


# --- the stack of list indents: what is at least ``m`` is closed, then ``p`` is opened -----------------------

def _indent_effect(t: Column) -> Column:
    tokens = F.regexp_extract_all(t, F.lit(M.DEPTH_TOKEN), F.lit(0))
    nothing = F.array().cast("array<int>")

    def step(acc, token):
        indent = F.length(token) - 2
        deeper = F.struct(F.least(acc["m"], indent).alias("m"),
                          F.concat(F.filter(acc["p"], lambda x: x < indent), F.array(indent)).alias("p"))
        return F.when(indent < 0, F.struct(F.lit(0).alias("m"), nothing.alias("p"))).otherwise(deeper)
    return F.aggregate(tokens, F.struct(F.lit(NO_LIMIT).alias("m"), nothing.alias("p")), step)


def _compose_indents(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["m"], b["m"]).alias("m"), _apply_indents(b, a["p"]).alias("p"))


def _apply_indents(effect: Column, stack: Column) -> Column:
    return F.concat(F.filter(stack, lambda x: x < effect["m"]), effect["p"])


# --- heading levels: few states, so an effect is the table of what becomes of each ---------------------------

_SIGNALLED, _OPEN = 5, 6       # levels 0 to 4 that a signal gave; none or 1 to 5 that an unsigned heading left open
_STATES = _SIGNALLED * _OPEN * 2


def _encoded(state: Column) -> Column:
    return (state["signalled"] * _OPEN * 2 + F.coalesce(state["open"], F.lit(0)) * 2 + state["seen"].cast("int")).cast("int")


def _decoded(code: Column) -> Column:
    open_ = F.floor(code / 2).cast("int") % _OPEN
    return F.struct(F.floor(code / (_OPEN * 2)).cast("int").alias("signalled"), F.when(open_ > 0, open_).alias("open"),
                    (code % 2 == 1).alias("seen"))


def _heading_effect(levels: Column) -> Column:
    """``levels``: of the headings of a block, null for one without number and symbol."""
    kind = "struct<signalled:int,open:int,seen:boolean>"
    behind = lambda code: F.aggregate(
        levels, _decoded(code).cast(kind), lambda state, level: M.heading_step(state, level)[0].cast(kind))
    return F.transform(F.sequence(F.lit(0), F.lit(_STATES - 1)), lambda code: _encoded(behind(code)))


def _short_and_long(lines: DataFrame, key: str, lines_per_block: int) -> tuple[DataFrame, DataFrame]:
    """Cleaned blocks ``key, part, text`` of the documents that have one part, a row each, and of the others."""
    parts = to_parts(lines.filter(F.col(key).isNotNull()), key, lines_per_block)
    several = freeze(parts.filter("part > 0").select(key).distinct(), "several")
    text = F.concat("head", F.coalesce("tail", F.lit("")))
    short = parts.join(several, key, "left_anti").select(key, "part", M.clean_lines(text).alias("text"))
    return short, _long_blocks(parts.join(several, key, "left_semi"), key)


def clean_blocks(lines: DataFrame, key: str = "doc_id", lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """Cleaned documents as blocks ``key, part, text`` in order of ``part``; every line ends with a newline.

    ``lines`` holds ``key, n, x``, with ``n`` counting from 0; null keys are left out.
    """
    short, long = _short_and_long(lines, key, lines_per_block)
    return short.unionByName(long)


def _long_blocks(parts: DataFrame, key: str) -> DataFrame:
    blocks = freeze(to_blocks(parts, key).withColumn("effect", M.open_bullet(F.col("text"))), "blocks")
    above = states_before(blocks, key, "part", "effect", F.lit(""), "string", lambda a, b: F.coalesce(b, a),
                          lambda effect, state: F.coalesce(effect, state), "above")

    def to_items(t: Column) -> Column:
        return let(let(t, M._merge_headings), M._join_wrapped)
    items = (blocks.join(above, [key, "part"])
             .select(key, "part", to_items(M.fix_bullets_below(F.col("text"), F.col("above"))).alias("text")))
    items = freeze(items.withColumn("effect", _indent_effect(F.col("text"))), "items")
    stacks = states_before(items, key, "part", "effect", F.array().cast("array<int>"), "array<int>",
                           _compose_indents, _apply_indents, "stack")

    def to_text(t: Column) -> Column:
        for rule in (M._despace, M._tighten, M._leftover_symbols, M._collapse_spaces):
            t = let(t, rule)
        return t
    text = (items.join(stacks, [key, "part"])
            .select(key, "part", to_text(let(F.col("text"), lambda t: M.normalize_below(t, F.col("stack")))).alias("text")))
    return _releveled(freeze(text, "texts"), key)


def _releveled(text: DataFrame, key: str) -> DataFrame:
    """Heading levels of the documents that have one marker throughout and a signal anywhere; the others stay."""
    headings = text.filter(F.col("text").rlike(rf"(?Umd)^{M.HEADING}")).select(
        key, "part", F.filter(M.heading_pieces(F.col("text")), lambda p: p["marker"] != "").alias("h"))
    headings = freeze(headings.select(key, "part", F.transform("h", lambda p: p["marker"]).alias("markers"),
                                      F.transform("h", lambda p: p["signal"]["level"]).alias("levels")), "headings")
    chosen = (headings.groupBy(key).agg(F.min(F.array_min("markers")).alias("low"), F.max(F.array_max("markers")).alias("high"),
                                        F.max(F.array_max("levels")).alias("signal"))
              .filter((F.col("low") == F.col("high")) & F.col("signal").isNotNull()).select(key))
    effects = headings.join(chosen, key, "left_semi").select(key, "part", _heading_effect(F.col("levels")).alias("effect"))
    states = states_before(effects, key, "part", "effect", F.lit(0), "int", lambda a, b: F.transform(a, lambda code: b[code]),
                           lambda effect, state: effect[state], "code")
    new = let(M.heading_pieces(F.col("text")), lambda pieces: M.releveled(pieces, _decoded(F.col("code"))))
    return (text.join(states, [key, "part"], "left")
            .select(key, "part", F.when(F.col("code").isNotNull(), new).otherwise(F.col("text")).alias("text")))


def clean_docs(lines: DataFrame, key: str = "doc_id", lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """``key, text`` of documents that fit a row once they are clean."""
    short, long = _short_and_long(lines, key, lines_per_block)
    whole = short.select(key, "text").unionByName(long.groupBy(key).agg(_joined(["part"], "text").alias("text")))
    return whole.select(key, F.substring("text", F.lit(1), F.length("text") - 1).alias("text"))
