"""Text and number expressions. All run inside the JVM; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terminal colour sequences as written into log files, and how they begin.
ESCAPE = "\x1b"
ANSI_PATTERN = r"\x1B\[[0-9;]*[A-Za-z]"

# Units of a readable size, each 1024 times the one before.
SIZE_UNITS = ["bytes", "kB", "MB", "GB", "TB", "PB"]

# Bytes up to this many stay bytes; the other units go up to so many halves.
BYTES_LIMIT = 10240
HALVES_LIMIT = 20479


# Fixed value: how a time is written in the name of a backup, ``<base>_20240131_102030``.
STAMP_FORMAT = "yyyyMMdd_HHmmss"


def idiv(a: Column, n: int) -> Column:
    """Truncating integer division; ``/`` would give a double."""
    return F.call_function("div", a, F.lit(n))


def is_blank(c: Column) -> Column:
    """True for null as well as for the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def or_default(c: Column, default) -> Column:
    """The text itself, or the default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def strip_cr(c: Column) -> Column:
    """Drop one trailing carriage return."""
    return F.regexp_replace(c, r"\r\z", "")


def strip_ansi(c: Column) -> Column:
    """Drop colour sequences; lines without any, the most, skip the pattern."""
    return F.when(c.contains(ESCAPE), F.regexp_replace(c, ANSI_PATTERN, "")).otherwise(c)


def field(line: Column, n: int) -> Column:
    """The n-th whitespace-separated field counted from 1; null when there are fewer."""
    pattern = r"^\s*(?:\S+\s+){%d}(\S+)" % (n - 1)
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def dirname(path: Column) -> Column:
    """Directory part of a path: ``/a/b`` gives ``/a``, ``/a`` gives ``/``, ``a`` gives ``.``."""
    bare = F.when(path.rlike(r"^/+$"), F.lit("/")).otherwise(F.regexp_replace(path, r"/+$", ""))
    parent = F.regexp_replace(bare, r"/+[^/]*$", "")
    return (
        F.when(bare == "/", F.lit("/"))
        .when(~bare.contains("/"), F.lit("."))
        .when(parent == "", F.lit("/"))
        .otherwise(parent)
    )


def basename(path: Column) -> Column:
    """Last part of a path, without trailing slashes."""
    return F.when(path.rlike(r"^/+$"), F.lit("/")).otherwise(
        F.substring_index(F.regexp_replace(path, r"/+$", ""), "/", -1)
    )


def says_yes(c: Column) -> Column:
    """True for ``yes`` in any case; nothing else, and not null, confirms."""
    return F.coalesce(F.lower(c) == "yes", F.lit(False))


def stamped_name(base: Column, ts: Column) -> Column:
    """The name of a backup made at ``ts``."""
    return F.concat_ws("_", base, F.date_format(ts, STAMP_FORMAT))


def stamp_of(name: Column) -> Column:
    """The time in a backup's name as TIMESTAMP_NTZ; null when there is none or an impossible one."""
    pattern = r"^.*_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})/*$"
    return F.regexp_replace(name, pattern, "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz")


def whole_word(text: Column, word: str) -> Column:
    """True where the literal word stands between non-word characters or the text's ends."""
    literal = "".join("\\" + ch if not (ch.isalnum() or ch == "_") else ch for ch in word)
    return text.rlike(rf"(?<![A-Za-z0-9_]){literal}(?![A-Za-z0-9_])")


def pretty_size(size: Column) -> Column:
    """Bytes as text as database servers print them: the first unit that keeps the number short, half rounded away from 0."""
    text = F.when(F.abs(size) < BYTES_LIMIT, F.concat(size.cast("bigint").cast("string"), F.lit(" " + SIZE_UNITS[0])))
    for i, unit in enumerate(SIZE_UNITS[1:], start=1):
        halves = idiv(size, 1024**i // 2)
        rounded = idiv(halves + F.when(halves < 0, -1).otherwise(1), 2)
        shown = F.concat(rounded.cast("string"), F.lit(" " + unit))
        fits = size.isNotNull() if unit == SIZE_UNITS[-1] else F.abs(halves) < HALVES_LIMIT
        text = text.when(fits, shown)
    return text
