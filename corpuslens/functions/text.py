"""Exact text and path helpers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line ends of the wide splitter (the narrow one knows only \\n, \\r and \\r\\n).
WIDE_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(_col(c), F.lit(WHITESPACE))


def unix_newlines(c: Column | str) -> Column:
    """Universal newlines. Plain replaces return early when nothing matches, unlike a regex."""
    return F.replace(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _without_final_newline(c: Column) -> Column:
    n = F.char_length(c)
    return (
        F.when(c.endswith("\r\n"), F.substring(c, F.lit(1), n - 2))
        .when(c.endswith("\n") | c.endswith("\r"), F.substring(c, F.lit(1), n - 1))
        .otherwise(c)
    )


def lines_array(c: Column | str) -> Column:
    """Lines without line ends; no phantom last line; an empty text has none."""
    c = _col(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(
        F.split(unix_newlines(_without_final_newline(c)), "\n")
    )


def wide_lines_array(c: Column | str) -> Column:
    """As lines_array, but also splitting at the other Unicode line boundaries."""
    c = _col(c)
    parts = F.split(c, WIDE_LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(c: Column | str) -> Column:
    """Number of lines from byte lengths alone: no array of lines is built."""
    c = _col(c)
    unix = unix_newlines(c)
    ends = F.octet_length(unix) - F.octet_length(F.replace(unix, F.lit("\n"), F.lit("")))
    open_end = (c != "") & ~c.endswith("\n") & ~c.endswith("\r")
    return (ends + open_end.cast("int")).cast("bigint")


def count_char(c: Column, char: str) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(char), F.lit("")))


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    path = _col(path)
    return F.when(path.contains("/"), F.regexp_replace(path, "(?s)/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column | str) -> Column:
    """Last suffix, lower case. Leading dots do not start a suffix: '.env' has none."""
    return F.regexp_extract(F.lower(basename(path)), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def stem(path: Column | str) -> Column:
    name = basename(path)
    return F.when(
        F.regexp_like(name, F.lit(r"(?s)^\.*[^.].*\.[^.]*$")), F.regexp_replace(name, r"(?s)\.[^.]*$", "")
    ).otherwise(name)


def strip_dot_slash(path: Column | str) -> Column:
    """Drops every leading '.' and '/', so './.github/x' becomes 'github/x'."""
    return F.ltrim(_col(path), F.lit("./"))


def normal_path(path: Column | str) -> Column:
    return F.ltrim(F.replace(_col(path), F.lit("\\"), F.lit("/")), F.lit("/"))


def safe_rel_path(path: Column | str) -> Column:
    """Struct(path, error): the path folded over '.' and '..'; an error if it leaves the root."""
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit(0).alias("low"), F.lit(0).alias("depth")
    )

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        skip = (part == "") | (part == ".")
        depth = F.when(skip, acc["depth"]).when(up, acc["depth"] - 1).otherwise(acc["depth"] + 1)
        parts = (
            F.when(skip, acc["parts"])
            .when(up, F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0))))
            .otherwise(F.concat(acc["parts"], F.array(part)))
        )
        return F.struct(parts.alias("parts"), F.least(acc["low"], depth).alias("low"), depth.alias("depth"))

    folded = F.aggregate(F.split(normal_path(path), "/"), start, step)
    # A dip below the root that comes back can only return to it by the root's own (unknown) name.
    escaped = folded["low"] < 0
    return F.struct(
        F.when(~escaped, F.array_join(folded["parts"], "/")).alias("path"),
        F.when(escaped, F.lit("path leaves the repository")).alias("error"),
    )


def decode_utf8(raw: Column | str) -> Column:
    """Bytes to text with bad bytes dropped, all inside the JVM.

    make_valid_utf8 marks bad bytes with U+FFFD, so a genuine U+FFFD is first written as an escape
    (U+E000 'b'), the marks are removed, and the escape is undone.
    """
    text = _col(raw).cast("string")
    mark, esc = F.lit("\ufffd"), F.lit("\ue000")
    escaped = F.replace(F.replace(text, esc, F.lit("\ue000a")), mark, F.lit("\ue000b"))
    cleaned = F.replace(F.make_valid_utf8(escaped), mark, F.lit(""))
    restored = F.replace(F.replace(cleaned, F.lit("\ue000b"), mark), F.lit("\ue000a"), esc)
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def char_indent(line: Column) -> Column:
    """Characters of leading whitespace."""
    return F.char_length(line) - F.char_length(lstrip(line))
