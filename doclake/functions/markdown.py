"""Markdown repair rules as column expressions: ``text -> text``, one row per document.

A document stays one row from start to end, so the whole clean-up is a narrow map without any shuffle.
Internally every line ends with a newline (``_by_lines`` adds the last one and takes it off again), which
lets a rule drop a line together with its terminator.

Regular expressions use the flags ``U`` (Unicode classes), ``d`` (only ``\\n`` ends a line) and, where lines
matter, ``m``. Repetitions of groups are possessive: Java matches those in a loop, not by recursion, so
long runs cannot exhaust the stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.functions.arrays import let, replace_tokens, scan


def _class(chars: str) -> str:
    return "[" + chars.replace("-", "\\-").replace("[", "\\[").replace("]", "\\]") + "]"


# White space includes the four separator controls U+001C..U+001F.
WS = r"[\s\x1c-\x1f]"
BLANK = r"[[^\S\n]\x1c-\x1f]"          # white space within a line
INK = r"[^\s\x1c-\x1f]"                # anything that is not white space
HANGUL = "[가-힣]"
SYMBOL = _class("".join(C.BULLETS_BY_DEPTH))
ITEM = rf" *- (?={INK})"
HEADING = rf"#{{1,6}} +(?={INK})"
NUMBER_ONLY = C.NUMBER_ALONE
# A note starts with ※, * or **; stars count only when no further star follows (else it is emphasis).
NOTE_REST = rf"{BLANK}*(?=[^\s*\x1c-\x1f])"
STAR_REST = rf"{BLANK}*(?=[^\s*\x1c-\x1f][^*\n]*$)"
NOTE = rf"(?:- )?(?:※{NOTE_REST}|\*{{1,2}}{STAR_REST})"
PIPE_LINE = rf"{BLANK}*+\|"


def _symbol_prefix(name: str) -> str:
    """A symbol bullet; the same symbol may be repeated if blanks stand on both sides."""
    return rf" *- (?<{name}>{SYMBOL})(?:(?: +\k<{name}>(?= ))++ +| *)"


def _empty_bullet(name: str) -> str:
    return rf"(?:{_symbol_prefix(name)}{BLANK}*|- l(?: {BLANK}*)?)$"


def _by_lines(text: Column, rule: Callable[[Column], Column]) -> Column:
    return let(let(F.concat(text, F.lit("\n")), rule),
               lambda t: F.substring(t, F.lit(1), F.length(t) - 1))


# --- one function per rule, on newline-terminated text -----------------------

def _strip_private_glyphs(t: Column) -> Column:
    return F.regexp_replace(t, r"[\uE000-\uF8FF] *", "")


def _escape_notes(t: Column) -> Column:
    escaped = F.regexp_replace(t, rf"(?Umd)^(?:- )?※{NOTE_REST}", "※ ")
    escaped = F.regexp_replace(escaped, rf"(?Umd)^(?:- )?\*\*{STAR_REST}", r"\\*\\* ")
    escaped = F.regexp_replace(escaped, rf"(?Umd)^(?:- )?\*{STAR_REST}", r"\\* ")
    return F.when(t.rlike(rf"(?Umd)^{NOTE}"), escaped).otherwise(t)


def _fix_bullets(t: Column) -> Column:
    # Lines that hold nothing but a symbol vanish and leave no trace in the list depth.
    t = F.regexp_replace(t, rf"(?Umd)^ *(?:(?:- )?\[.?\] )?{SYMBOL} *\n", "")
    # Of adjacent bullets without text only the last one decides the depth.
    t = F.regexp_replace(t, rf"(?Umd)^{_empty_bullet('a')}\n(?={_empty_bullet('b')})", "")
    # A note directly below a line with text gets a blank line; bullets without text do not count as lines.
    t = let(t, lambda u: F.when(
        u.rlike(rf"(?Umd)^{NOTE}"),
        F.regexp_replace(
            u, rf"(?Umd)^(?!{_empty_bullet('a')})(?=.*{INK}).*+\n(?:{_empty_bullet('b')}\n)?(?={NOTE})", "$0\n"),
    ).otherwise(u))
    # The depth of a symbol bullet holds until the next one, or until other content ends the list. Cutting
    # the text at symbol bullets therefore turns the running depth into a property of each piece.
    pieces = F.split(t, rf"(?Umd)^(?={SYMBOL_BULLET})", -1)
    return F.array_join(F.transform(pieces, _fix_piece), "")


ENDS_LIST = rf"(?Umd)^(?=.*{INK})(?!{NOTE})(?! *- (?![{C.ORDINAL_STARTS}]){INK})(?s:.*)"
SYMBOL_BULLET = rf" *- {SYMBOL}|- l(?: |$)"


def _bullet_depth(head: Column) -> Column:
    symbol = F.regexp_extract(head, rf"\A *- ({SYMBOL})", 1)
    depth1, depth2 = (list(chars) for chars in C.BULLETS_BY_DEPTH[1:])
    return F.when(symbol.isin(depth1), 1).when(symbol.isin(depth2), 2).otherwise(0)


def open_bullet(t: Column) -> Column:
    """The symbol bullet whose list is open behind a text, as a short line of the same depth; empty if none is.

    Null where the text leaves open what was open before it.
    """
    def of_last(pieces: Column) -> Column:
        last = F.element_at(pieces, -1)
        head = F.substring_index(last, "\n", 1)
        bare = head.rlike(rf"(?Umd)\A{_empty_bullet('a')}")
        depth = _bullet_depth(head)
        symbol = F.when(depth == 2, C.BULLETS_BY_DEPTH[2][0]).when(depth == 1, C.BULLETS_BY_DEPTH[1][0]).otherwise(C.BULLETS_BY_DEPTH[0][0])
        line = F.concat(F.lit("- "), symbol, F.when(bare, "\n").otherwise(" x\n"))
        return (F.when(last.rlike(ENDS_LIST), "")
                .when(last.rlike(rf"\A(?: *- {SYMBOL}|- l[ \n])"), line))
    return let(F.split(t, rf"(?Umd)^(?={SYMBOL_BULLET})", -1), of_last)


def fix_bullets_below(t: Column, above: Column) -> Column:
    """``fix_bullets`` of newline-terminated text below the line that ``open_bullet`` gave for the text before it."""
    def drop_line(u: Column) -> Column:
        return F.when(above.endswith(" x\n"), F.regexp_replace(u, r"(?d)\A[^\n]*\n", "")).otherwise(u)
    return let(let(F.concat(above, t), _fix_bullets), drop_line)


def _fix_piece(piece: Column) -> Column:
    """One symbol bullet with the lines below it, or the lines before the first one."""

    def rewrite(p: Column) -> Column:
        head = p["head"]
        is_empty = head.rlike(rf"(?Umd)\A{_empty_bullet('a')}")
        depth = _bullet_depth(head)
        bullet = F.regexp_replace(
            head, F.lit(rf"(?Ud)\A(?:{_symbol_prefix('a')}|- l ){BLANK}*+(.*{INK}){BLANK}*\z"),
            F.concat(F.repeat(F.lit("  "), depth), F.lit("- $2\n")))
        # below a bullet without text the next item takes its place
        indent = F.repeat(F.lit("  "), depth + F.when(is_empty, 0).otherwise(1))
        below = F.substring(p["listed"], F.length(head) + 2, F.length(p["listed"]))
        children = F.regexp_replace(_escape_notes(below), F.lit(rf"(?Umd)^{ITEM}"), F.concat(indent, F.lit("- ")))
        return F.concat(F.when(is_empty, "").otherwise(bullet), children)

    def rewrite_all(p: Column) -> Column:
        rest = F.substring(p["piece"], F.length(p["listed"]) + 1, F.length(p["piece"]))
        return F.concat(rewrite(p), _escape_notes(rest))

    parts = F.struct(piece.alias("piece"), F.substring_index(piece, "\n", 1).alias("head"),
                     F.regexp_replace(piece, ENDS_LIST, "").alias("listed"))
    return F.when(piece.rlike(rf"\A(?: *- {SYMBOL}|- l[ \n])"), let(parts, rewrite_all)).otherwise(_escape_notes(piece))


def _merge_headings(t: Column) -> Column:
    return F.regexp_replace(
        t,
        rf"(?Umd)^(#{{1,6}}) +({NUMBER_ONLY}){WS}*\n#{{1,6}} +(?!{NUMBER_ONLY}{BLANK}*$)({INK}(?:.*{INK})?){BLANK}*$",
        "$1 $2 $3")


UNFINISHED = "|".join(C.UNFINISHED_ANYWHERE) + f"|[^가-힣](?:{'|'.join(C.UNFINISHED_WORDS)})"
CONTINUES = "|".join(C.CONTINUATION_ENDINGS) + rf"|(?:{'|'.join(C.CONTINUATION_WORDS)})(?={WS}|\z)"


def _join_wrapped(t: Column) -> Column:
    # \G resumes where the last join ended, so that chains of items are followed.
    return F.regexp_replace(
        t, rf"(?Umd)(^{ITEM}|(?!\A)\G)(.*+)(?:(?<={UNFINISHED})\n{ITEM}|\n *- (?={CONTINUES}))", "$1$2 ")


# The indent and dash of each item, or the first character of any other line with text.
DEPTH_TOKEN = rf"(?Umd)^(?:{ITEM}|(?! *- {INK})(?=.*{INK}).)"


def _normalize_depths(t: Column) -> Column:
    return normalize_below(t, F.array().cast("array<int>"))


def normalize_below(t: Column, open_indents: Column) -> Column:
    """``normalize_depths`` of newline-terminated text that starts below open list items of these indents."""
    def renumber(tokens: Column) -> Column:
        def step(stack, indent):
            levels = F.when(indent < 0, F.array().cast("array<int>")).otherwise(
                F.concat(F.filter(stack, lambda level: level < indent), F.array(indent)))
            return levels, F.size(levels)
        depths = scan(F.transform(tokens, lambda tok: F.length(tok) - 2), open_indents, step)
        return F.zip_with(tokens, depths, lambda tok, depth: F.when(depth == "0", tok).otherwise(
            F.concat(F.repeat(F.lit("  "), depth.cast("int") - 1), F.lit("- "))))

    return F.when(t.rlike(rf"(?Umd)^{ITEM}"), replace_tokens(t, DEPTH_TOKEN, renumber)).otherwise(t)


def _despace(t: Column) -> Column:
    run = rf"(?<!{HANGUL}){HANGUL}(?: {{1,3}}{HANGUL}){{3,}}+"

    def close_up(runs: Column) -> Column:
        # two or three blanks are a word break, a single one is letter-spacing; every blank that has no blank
        # right behind it goes, which empties single ones and leaves a word break one or two, then one of these
        return F.transform(runs, lambda r: F.regexp_replace(F.regexp_replace(r, " (?! )", ""), " +", " "))

    return F.when(t.rlike(run), replace_tokens(t, run, close_up)).otherwise(t)


def _tighten(t: Column) -> Column:
    # Each run of blanks is looked at once, at its first blank.
    after = _class(C.MIDDLE_DOTS + C.OPENING_BRACKETS)
    before = _class(C.MIDDLE_DOTS + C.CLOSING_BRACKETS)
    return F.regexp_replace(
        t, rf"(?= )(?<! )(?:(?<={after}) ++| ++(?={before})|(?<=') ++(?=\p{{Nd}}))", "")


def _leftover_symbols(t: Column) -> Column:
    for symbol in C.LEFTOVER_SYMBOLS:
        t = F.replace(t, F.lit(symbol), F.lit(C.LEFTOVER_REPLACEMENT))
    return t


def _collapse_spaces(t: Column) -> Column:
    # Table rows match first and as a whole, which keeps their inner spaces.
    return F.regexp_replace(t, rf"(?Umd)(^{PIPE_LINE}.*+)|( )(?<={INK} ) +", "$1$2")


def _signal(text: Column) -> Column:
    """Level and text of a heading; the level is null where neither number nor symbol gives one."""
    symbol = rf"(?Ud)^({SYMBOL}){WS}*({INK}.*)$"
    mark = F.regexp_extract(text, symbol, 1)
    level = (F.when(mark.isin(list(C.BULLETS_BY_DEPTH[0])), 2)
             .when(mark.isin(list(C.BULLETS_BY_DEPTH[1])), 3)
             .when(mark.isin(list(C.BULLETS_BY_DEPTH[2])), 4))
    for n, start in C.LEVEL_BY_START:
        level = level.when(text.rlike(f"(?Ud){start}"), n)
    return F.struct(level.alias("level"),
                    F.when(mark != "", F.regexp_extract(text, symbol, 2)).otherwise(text).alias("text"))


def heading_pieces(t: Column) -> Column:
    """The text cut before each heading: ``marker``, ``signal`` and the ``rest`` behind the title."""
    def read(piece: Column) -> Column:
        title = F.regexp_extract(piece, rf"(?Umd)\A#{{1,6}} +({INK}(?:.*{INK})?){BLANK}*$", 1)
        return F.struct(
            F.regexp_extract(piece, rf"(?Ud)\A(#{{1,6}}) +{INK}", 1).alias("marker"),
            _signal(title).alias("signal"),
            F.when(piece.rlike(rf"(?Ud)\A{HEADING}"), F.regexp_extract(piece, r"(?sd)\A[^\n]*(\n.*)\z", 1))
            .otherwise(piece).alias("rest"))
    return F.transform(F.split(t, rf"(?Umd)^(?={HEADING})", -1), read)


def heading_step(state: Column, signal: Column) -> tuple[Column, Column]:
    """What a heading with this level (null without number and symbol) makes of the state, and its level."""
    level = F.coalesce(signal, state["open"], state["signalled"] + 1)
    stays_open = (F.when(signal.isNull(), F.when(state["seen"], level))
                  .when(level > F.coalesce(state["open"], F.lit(7)), state["open"]))
    moved = F.struct(F.coalesce(signal, state["signalled"]).alias("signalled"), stays_open.alias("open"),
                     F.lit(True).alias("seen"))
    return moved, level


def no_heading_yet() -> Column:
    return F.struct(F.lit(0).alias("signalled"), F.lit(None).cast("int").alias("open"), F.lit(False).alias("seen"))


def releveled(pieces: Column, state: Column) -> Column:
    """The text of ``heading_pieces`` with levels from the signals, from a state on."""
    def step(state, p):
        moved, level = heading_step(state, p["level"])
        return F.when(p["heading"], moved).otherwise(state), F.when(p["heading"], level).otherwise(0)

    levels = scan(F.transform(pieces, lambda p: F.struct((p["marker"] != "").alias("heading"),
                                                         p["signal"]["level"].alias("level"))), state, step)
    lines = F.zip_with(pieces, levels, lambda p, level: F.when(level == "0", p["rest"]).otherwise(
        F.concat(F.repeat(F.lit("#"), F.least(level.cast("int"), F.lit(6))), F.lit(" "),
                 p["signal"]["text"], p["rest"])))
    return F.array_join(lines, "")


def _relevel_headings(t: Column) -> Column:
    def relevel(pieces: Column) -> Column:
        markers = F.array_distinct(F.filter(F.transform(pieces, lambda p: p["marker"]), lambda m: m != ""))
        signalled = F.exists(pieces, lambda p: p["signal"]["level"].isNotNull())
        return F.when((F.size(markers) == 1) & signalled, releveled(pieces, no_heading_yet()))

    return F.when(t.rlike(rf"(?Umd)^{HEADING}"), F.coalesce(let(heading_pieces(t), relevel), t)).otherwise(t)


# --- public column functions -------------------------------------------------

def strip_private_glyphs(text: Column) -> Column:
    """Remove private-use glyphs and the blanks after them."""
    return _strip_private_glyphs(text)


def fix_bullets(text: Column) -> Column:
    """Turn bullet symbols into list depth, drop bare symbols, set notes apart from lists."""
    return _by_lines(text, _fix_bullets)


def merge_headings(text: Column) -> Column:
    """Join a heading that holds only a number with the heading that follows it."""
    return _by_lines(text, _merge_headings)


def join_wrapped(text: Column) -> Column:
    """Join list items that were cut in the middle of a sentence."""
    return _by_lines(text, _join_wrapped)


def normalize_depths(text: Column) -> Column:
    """Renumber list depth from zero in every list block."""
    return _by_lines(text, _normalize_depths)


def despace(text: Column) -> Column:
    """Close up letter-spaced Hangul."""
    return let(text, _despace)


def tighten(text: Column) -> Column:
    """Remove blanks around middle dots, inside brackets and after a year apostrophe."""
    return _tighten(text)


def leftover_symbols(text: Column) -> Column:
    """Show symbol-font leftovers as a visible bullet."""
    return _leftover_symbols(text)


def collapse_spaces(text: Column) -> Column:
    """Collapse inner runs of blanks; indentation and table rows stay."""
    return _by_lines(text, _collapse_spaces)


def relevel_headings(text: Column) -> Column:
    """Recover heading levels from numbering and symbols where all headings share one level."""
    return _by_lines(text, _relevel_headings)


# The order is part of the result: de-spacing reads two blanks as a word break and must precede their
# collapse, and levels are recovered only once split headings are whole again.
RULES = (
    ("strip_private_glyphs", _strip_private_glyphs),
    ("fix_bullets", _fix_bullets),
    ("merge_headings", _merge_headings),
    ("join_wrapped", _join_wrapped),
    ("normalize_depths", _normalize_depths),
    ("despace", _despace),
    ("tighten", _tighten),
    ("leftover_symbols", _leftover_symbols),
    ("collapse_spaces", _collapse_spaces),
    ("relevel_headings", _relevel_headings),
)


def clean_lines(t: Column) -> Column:
    """All rules in order, on newline-terminated text."""
    for _, rule in RULES:
        t = let(t, rule)
    return t


def clean_markdown(text: Column) -> Column:
    """All rules in order."""
    return _by_lines(text, clean_lines)
