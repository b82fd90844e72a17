"""Bracket, escaping and lexical functions as built-in column expressions.

Everything here stays in the JVM. A null argument gives a null, unless noted.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.core import entities
from palisade.core.markup import NAME_PATTERN

BRACKETS, OPENERS, CLOSERS = "()[]{}", "([{", ")]}"


def is_matcher(c: Column) -> Column:
    """Whether the one-character string ``c`` is a bracket."""
    return c.isin(*BRACKETS)


def is_opener(c: Column) -> Column:
    return c.isin(*OPENERS)


def is_closer(c: Column) -> Column:
    return c.isin(*CLOSERS)


def is_matched(opener: Column, closer: Column) -> Column:
    """Whether the two are a pair, in this order."""
    return F.concat(opener, closer).isin("()", "[]", "{}")


def has_matcher(text: Column) -> Column:
    return text.rlike(r"[()\[\]{}]")


def count_matchers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[()\[\]{}]"))


def brackets_only(text: Column) -> Column:
    """The text's brackets, in order."""
    return F.regexp_replace(text, r"[^()\[\]{}]+", "")


def byte_position(data: Column, offset: Column) -> Column:
    """STRUCT(ofs, line, col) of a byte offset in a binary column: line and column
    count from 1, columns in bytes."""
    # ISO-8859-1 has one character a byte, so string positions are byte positions.
    before = F.substr(F.decode(data, "ISO-8859-1"), F.lit(1), offset.cast("int"))
    line = F.regexp_count(before, F.lit("\n")) + 1
    column = offset - F.length(before) + F.length(F.substring_index(before, "\n", -1)) + 1
    return F.struct(offset.cast("bigint").alias("ofs"), line.cast("int").alias("line"), column.cast("int").alias("col"))


def error_text(error: Column) -> Column:
    """``line:col msg`` of an error struct; null where there is none."""
    return F.when(error.isNotNull(), F.format_string("%d:%d %s", error["line"], error["col"], error["msg"]))


def text_stop(text: Column, error: Column) -> Column:
    """STRUCT(stop, closer, fault) of reading ``text`` to its end or to the first closer
    that nothing opened, which is not consumed: ``error`` is its ``bracket_error``.
    A null text gives a null; a pair that doesn't match gives a fault and no stop."""
    at_closer = F.coalesce(F.startswith(error["msg"], F.lit("unmatched closer")), F.lit(False))
    stop = F.when(at_closer, error["ofs"]).when(error.isNull(), F.octet_length(text).cast("bigint"))
    closer = F.when(at_closer, F.right(error["msg"], F.lit(1)))
    return F.when(text.isNotNull(), F.struct(stop.alias("stop"), closer.alias("closer"), F.when(~at_closer, error_text(error)).alias("fault")))


def unmatched_residue(text: Column, rounds: int) -> Column:
    """What is left of the brackets after ``rounds`` deletions of adjacent pairs:
    empty exactly for balanced text nested no deeper than ``rounds``."""
    out = brackets_only(text)
    for _ in range(rounds):
        for pair in ("()", "[]", "{}"):
            out = F.replace(out, F.lit(pair), F.lit(""))
    return out


# --- escaping --------------------------------------------------------------

ESC_AMP, ESC_LT, ESC_GT, ESC_APOS, ESC_QUOT = 1, 2, 4, 8, 16
ESC_ANGLE = ESC_LT | ESC_GT
ESC_BASIC = ESC_AMP | ESC_ANGLE
ESC_IN_QUOT = ESC_BASIC | ESC_QUOT
ESC_IN_APOS = ESC_BASIC | ESC_APOS


def xml_escape(text: Column, what: int = ESC_BASIC) -> Column:
    """References in place of the characters that the bits of ``what`` name."""
    for bit, char, name in ((ESC_AMP, "&", "amp"), (ESC_LT, "<", "lt"), (ESC_GT, ">", "gt"), (ESC_APOS, "'", "apos"), (ESC_QUOT, '"', "quot")):
        if what & bit:
            text = F.replace(text, F.lit(char), F.lit(f"&{name};"))
    return text


def html_escape(text: Column) -> Column:
    return xml_escape(text, ESC_BASIC)


def xml_cdata(text: Column) -> Column:
    """Raw text as CDATA sections; empty text gives nothing."""
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>")))


def tag_comment(text: Column) -> Column:
    return F.concat(F.lit("<!--"), F.replace(text, F.lit("--"), F.lit("-&#45;")), F.lit("-->"))


def tag_reference(name: Column) -> Column:
    return F.concat(F.lit("&"), name, F.lit(";"))


def is_void(name: Column) -> Column:
    return name.isin(*entities.VOID)


# --- lexical predicates ----------------------------------------------------


def is_xml_char(cp: Column) -> Column:
    return cp.isin(9, 10, 13) | cp.between(0x20, 0xD7FF) | cp.between(0xE000, 0xFFFD) | cp.between(0x10000, 0x10FFFF)


def is_xml_space(c: Column) -> Column:
    return c.isin(" ", "\r", "\n", "\t")


def is_name_byte(c: Column) -> Column:
    """Whether a character may be in a name of the markup: no space, no bracket."""
    return (c != "") & ~is_xml_space(c) & ~is_matcher(c)


def is_markup_reference(name: Column) -> Column:
    return name.rlike(r"\A[^ \t\r\n]+\z")


def is_sensitive(c: Column) -> Column:
    """Whether a bracket can suck space: all but parentheses."""
    return c.isin("[", "]", "{", "}")


def _name_start() -> str:
    return NAME_PATTERN[: NAME_PATTERN.index("][") + 1]


def is_name_start_char(c: Column) -> Column:
    return c.rlike(rf"\A{_name_start()}\z")


def is_name_char(c: Column) -> Column:
    return c.rlike(rf"\A{NAME_PATTERN[NAME_PATTERN.index('][') + 1 : -1]}\z")


def is_xml_name(name: Column) -> Column:
    return name.rlike(rf"\A{NAME_PATTERN}\z")


def is_xml_reference(name: Column) -> Column:
    return is_xml_name(name) | name.rlike(r"\A#([0-9]+|x[0-9a-fA-F]+)\z")


# --- entities --------------------------------------------------------------


def escape_name(bracket: Column, symbolic: bool = False) -> Column:
    """Reference name that stands for an unmatched bracket; null for anything else."""
    table = entities.SYMBOLIC_ESCAPES if symbolic else entities.DECIMAL_ESCAPES
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), bracket)


#: The extension of markup files where none are named.
EXTENSIONS = ("m",)


def is_markup_file(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether the path's last extension is one of these (without the dot); case matters."""
    return F.regexp_extract(path, r"\.([^./]+)\z", 1).isin(*extensions)
