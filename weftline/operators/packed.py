r"""Splitting of cells that hold several values into one row per value.

Method: quoted spans are replaced by indexed placeholders, the rest is split at the delimiters, the spans come back by
array lookup, and the values are exploded with their positions. All of it is built-in column expressions, so it stays
inside the JVM.

Placeholders cannot collide with data: a placeholder is ``MARK index MARK``, pieces end at ``SEP``, and whatever the data
itself holds of MARK, SEP and ESC is written as ESC and a digit beforehand and turned back at the end. Quoted spans go
first; names that are never split and legal suffixes follow, numbered on. Any run of white space may stand around either.

Defined cases: a null, blank or delimiter-only cell gives no row; values are trimmed of all Unicode white space, lose one
pair of enclosing quotes, are dropped if empty, and keep their order; positions count the values kept, from 1; repeated
values and repeated rows stay; quotes inside a value are text; an unclosed quote is text; ``[..]`` and ``{..}`` around a
whole cell are brackets, not text; a business suffix (``, Inc.``) belongs to the value before it. A slash splits unless it
is inside a name of ``protected``, which the caller must give: no rule can tell ``A/B`` the name from ``A/B`` the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, SEP, ESC = "\ue000", "\ue001", "\ue002"
#: Delimiters that split wherever they stand outside quotes. A slash splits too, unless it is inside a protected name.
DELIMITERS = r"(?:<\s*/?\s*br\s*/?\s*>|[\r\n]+[ \t]*[-*•·][ \t]+|[,;|\t\r\n，；、·•/])"
# fixed values: legal suffixes that follow a comma without starting a new value
SUFFIXES = ("Inc", "Ltd", "LLC", "L.L.C", "S.A", "Co", "Corp", "GmbH", "PLC", "Pty", "B.V", "S.L", "LLP", "Limited")
_SPACE = r"[\s\u00a0\u2007\u202f\ufeff]"
_EDGE = rf"^{_SPACE}+|{_SPACE}+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){_EDGE}", "")


_CLOSE = r"(?=[ \x0B\f\u00a0]*+(?:$|[,;|\t\r\n，；、·•/\]}<]))"
#: A quoted span at a value's edges; group 1 is what stands before it, group 2 the span.
_QUOTED = (
    r"((?:^|[,;|\t\r\n，；、·•/\[{>]|[\r\n][ \t]*+[-*•·])[\s\u00a0]*+)"
    r"""(\"[^\"\\]*+(?:(?:\\.|\"\")[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+')""" + _CLOSE
)


def _names(suffixes: tuple[str, ...], protected: tuple[str, ...]) -> str:
    """The pattern of what must not be split besides quoted spans: legal suffixes and protected names."""
    suffix = rf",[ \u00a0]?(?:{'|'.join(s.replace('.', r'\.') for s in suffixes)})(?:\.|(?![\w])){_CLOSE}"
    names = "|".join(rf"(?i:\Q{n}\E)(?![\w])" for n in protected)
    return suffix + (f"|(?<![\\w])(?:{names})" if names else "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once; a column that is named twice would be computed twice."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _escape(c: Column) -> Column:
    c = F.replace(c, F.lit(ESC), F.lit(ESC + "2"))
    return F.replace(F.replace(c, F.lit(MARK), F.lit(ESC + "0")), F.lit(SEP), F.lit(ESC + "1"))


def _unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit(ESC + "0"), F.lit(MARK)), F.lit(ESC + "1"), F.lit(SEP))
    return F.replace(c, F.lit(ESC + "2"), F.lit(ESC))


def _restore(token: Column, spans: Column) -> Column:
    """Put the spans back: the odd parts between marks are span numbers."""
    return F.array_join(F.transform(F.split(token, MARK, -1), lambda p, i: F.when(i % 2 == 0, p).otherwise(F.get(spans, p.cast("int")))), "")


def _unquote(value: Column) -> Column:
    first, body = F.substring(value, 1, 1), F.substring(value, F.lit(2), F.length(value) - 2)
    quoted = (F.length(value) > 1) & (first == F.substring(value, -1, 1))
    unescape = lambda c: F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"\\(.)", "$1")).otherwise(c)
    return (
        F.when(quoted & (first == '"'), _trim(unescape(F.replace(body, F.lit('""'), F.lit('"')))))
        .when(quoted & (first == "'"), _trim(unescape(body)))
        .otherwise(value)
    )


def _numbered(text: Column, spans: Column, first) -> Column:
    """``text`` with the places of ``spans``, each now a MARK followed by SEP, as numbered placeholders from ``first``."""
    pieces = F.split(text, MARK + SEP, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(MARK), (i + first).cast("string"), F.lit(MARK))).otherwise(p)), "")


def split_values(cell: Column, protected: tuple[str, ...], delimiters: str = DELIMITERS, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The values of one cell as an array, in order."""
    names = _names(suffixes, protected)
    clean = lambda t: F.regexp_replace(t, rf"(?U){_EDGE}|^{_SPACE}*[-*•·]{_SPACE}+", "")
    none = F.array().cast("array<string>")

    def tokens(marked: Column, spans: Column) -> Column:
        # split() compiles its pattern anew for each row unless it is a single character; regexp_replace keeps it
        return F.transform(F.split(F.regexp_replace(marked, delimiters, SEP), SEP, -1), lambda t: F.when(F.contains(t, F.lit(MARK)), _restore(t, spans)).otherwise(t))

    def named(text: Column, quoted: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(names), F.lit(0))
        after = lambda more: F.when(F.size(more) > 0, _numbered(F.regexp_replace(text, names, MARK + SEP), more, F.size(quoted))).otherwise(text)
        return _let(found, lambda more: tokens(after(more), F.concat(quoted, more)))

    def quoted(escaped: Column) -> Column:
        # most cells hold no quote mark
        found = F.when(F.rlike(escaped, F.lit("[\"']")), F.regexp_extract_all(escaped, F.lit(_QUOTED), F.lit(2))).otherwise(none)
        after = lambda sp: F.when(F.size(sp) > 0, _numbered(F.regexp_replace(escaped, _QUOTED, "$1" + MARK + SEP), sp, F.lit(0))).otherwise(escaped)
        return _let(found, lambda sp: _let(after(sp), lambda text: named(text, sp)))

    # brackets around the whole cell
    bare = F.regexp_replace(_trim(cell.cast("string")), r"(?s)^[\[{](.*)[\]}]$", "$1")
    whole = lambda t: F.when(F.contains(t, F.lit(ESC)), _unescape(t)).otherwise(t)
    return F.filter(F.transform(F.transform(_let(_escape(bare), quoted), clean), lambda t: _unquote(whole(t))), lambda v: v != "")


def explode_values(df: DataFrame, key: str, fields: list[str], protected: tuple[str, ...], **how) -> DataFrame:
    """One row per value: ``key``, ``field``, ``pos`` from 1, ``value``. One scan, no shuffle, whatever the number of fields."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), split_values(F.col(f"`{f}`"), protected, **how).alias("items")) for f in fields))
    return (
        df.select(F.col(f"`{key}`").alias("id"), F.explode(cells).alias("cell"))
        .select("id", "cell.field", F.posexplode("cell.items").alias("at", "value"))
        .select("id", "field", (F.col("at") + 1).cast("int").alias("pos"), "value")
    )
