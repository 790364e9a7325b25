"""Several values packed in one field, split into one row per value with its position.

Quoted spans at the start of a value are replaced with indexed placeholders, the delimiters left are split on,
each placeholder is restored by array lookup and the values are exploded with positions. A placeholder is
U+E000, the span's index and U+E001; both signs are escaped in the field before (by U+E002 and a letter), so no text
can be mistaken for a placeholder. All of it is Column expressions: no shuffle and no Python.

Defined cases: null, empty and blank fields give no row; an unclosed quote is plain text; text after a closing quote
stays part of the value; brackets or braces around the whole field are dropped; a bracketed field is read as a JSON
array, and as a delimited list where it isn't valid JSON; JSON nulls are dropped; repeated values are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = r",;|\t\r\n"
OPEN, CLOSE, ESC = "\ue000", "\ue001", "\ue002"
_QUOTED = rf"""((?:^|[{DELIMITERS}])[^\S\t\r\n]*)("(?:[^"]|"")*+"|'(?:[^']|'')*+')"""
_BLANK = r"^[\s ]+|[\s ]+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def _escape(c: Column) -> Column:
    c = F.replace(c, F.lit(ESC), F.lit(ESC + "c"))
    return F.replace(F.replace(c, F.lit(OPEN), F.lit(ESC + "a")), F.lit(CLOSE), F.lit(ESC + "b"))


def _unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit(ESC + "a"), F.lit(OPEN)), F.lit(ESC + "b"), F.lit(CLOSE))
    return F.replace(c, F.lit(ESC + "c"), F.lit(ESC))


def _unquote(c: Column) -> Column:
    mark = F.substring(c, 1, 1)
    return F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.concat(mark, mark), mark)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's variable isn't expanded again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _delimited(field: Column) -> Column:
    """Values of a delimited list, untrimmed."""

    def split(safe: Column) -> Column:
        spans = F.regexp_extract_all(safe, F.lit(_QUOTED), F.lit(2))
        # the text between spans keeps each span's delimiter; the span alone becomes OPEN
        pieces = F.split(F.regexp_replace(safe, _QUOTED, f"$1{OPEN}"), OPEN)
        masked = F.array_join(
            F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), p))),
            "",
        )
        return _let(F.struct(spans.alias("spans"), masked.alias("masked")), lambda x: F.transform(F.split(x["masked"], f"[{DELIMITERS}]"), lambda v: restore(_trim(v), x["spans"])))

    def restore(v: Column, spans: Column) -> Column:
        at = F.regexp_extract(v, f"^{OPEN}(\\d+){CLOSE}", 1)
        rest = F.regexp_replace(v, f"^{OPEN}\\d+{CLOSE}", "")
        span = F.get(spans, F.nullif(at, F.lit("")).cast("int"))
        return _unescape(F.concat(F.coalesce(_unquote(span), F.lit("")), rest))

    return _let(_escape(field), split)


def split_values(field: Column) -> Column:
    """array<string> of the values in a packed field; null where the field is null."""

    def values(t: Column) -> Column:
        bracketed = t.startswith("[") & t.endswith("]") & (F.length(t) >= 2)
        braced = t.startswith("{") & t.endswith("}") & (F.length(t) >= 2)
        parsed = F.when(bracketed, F.from_json(t, "array<string>", {"mode": "PERMISSIVE"}))
        inner = F.when(bracketed | braced, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        return F.coalesce(parsed, _delimited(inner))

    return F.filter(F.transform(_let(_trim(field), values), _trim), lambda v: v.isNotNull() & (v != ""))


def explode_values(df: DataFrame, key: str = "id", field: str = "tags", value: str = "tag") -> DataFrame:
    """(key, pos, value), positions from 0 over the values kept."""
    return df.select(F.col(key).alias("id"), F.posexplode(split_values(F.col(field))).alias("pos", value))
