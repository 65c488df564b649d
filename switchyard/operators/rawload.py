"""Rows that fail to parse: raw CSV records are split into loaded rows and rejects with a reason.

Structure is checked on the record itself, with built-in string expressions: each quoted stretch becomes
one mark, and what is left shows whether quotes stand where they may and how many commas part fields. Values are checked
by dictionary: each distinct value of a column is cast once, the invalid ones form a dictionary of
(value, reason), which is joined back. Reasons are tested in the order quoting, columns, then the
columns' own checks in the order given.

Defined cases: a null or empty record has no 14 fields (`columns`); repeated records are each reported;
line breaks belong to the value where they stand, but for one at the very end of the record; JSON may be
nested to any depth and its numbers may have any length; extra columns of the input do not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.session import BROADCAST_BYTES, BROADCAST_ROWS, materialize

#: Columns of a seed export, in order.
SEED_COLUMNS = ("case_id", "scene_id", "label", "text", "route_type", "slots_json", "tags", "priority", "owner", "version", "enabled", "risk_level", "source", "notes")
_ESCAPE, _CUT = "\u0001", "\u0002"
_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def blank_trim(c: Column) -> Column:
    """Trims all white space, not only U+0020."""
    return F.regexp_replace(c, _BLANKS, "")


def _safe(raw: Column) -> Column:
    """The record without a final line break and with the two marks free for use."""
    whole = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r?\n\z|\r\z", "")
    return F.replace(F.replace(whole, F.lit(_ESCAPE), F.lit(_ESCAPE + "a")), F.lit(_CUT), F.lit(_ESCAPE + "b"))


def _once(c: Column) -> Column:
    """Keeps the optimizer from copying a costly expression into each of its uses."""
    return F.explode(F.array(c))


def _outline(safe: Column) -> Column:
    """The record with each quoted stretch as one mark; doubled quotes give neighbouring marks."""
    return F.regexp_replace(safe, '"[^"]*+"', _CUT)


def _structure(outline: Column, n_columns: int) -> Column:
    quoting = outline.contains('"') | outline.rlike(f"[^,{_CUT}]{_CUT}|{_CUT}[^,{_CUT}]")
    commas = F.length(outline) - F.length(F.replace(outline, F.lit(","), F.lit("")))
    return F.when(quoting, "quoting").when(commas != n_columns - 1, "columns")


def _fields(safe: Column) -> Column:
    """Cuts at the commas in the pieces that lie outside of quotes."""
    cut = F.transform(F.split(safe, '"', -1), lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", _CUT)).otherwise(p))
    return F.split(F.array_join(cut, '"'), _CUT, -1)


def _unquoted(field: Column) -> Column:
    inner = F.when(field.startswith('"'), F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)
    return F.replace(F.replace(inner, F.lit(_ESCAPE + "b"), F.lit(_CUT)), F.lit(_ESCAPE + "a"), F.lit(_ESCAPE))


def _refuse(name: str):
    raise ValueError(name)


def is_strict_json_object(text: str) -> bool:
    """One JSON object with JSON white space around it at most; no NaN or Infinity. Numbers may be of any length and nesting of any depth."""
    try:
        return isinstance(json.loads(text, parse_constant=_refuse, parse_int=str), dict)
    except RecursionError:
        return _is_object_by_tokens(text)
    except ValueError:
        return False


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([{}\[\]:,]))')


def _is_object_by_tokens(text: str) -> bool:
    """The same by a machine with a stack of its own, for nesting beyond the parser's depth."""
    stack: list[str] = []
    expect, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    first = True
    while at < end:
        m = _JSON_TOKEN.match(text, at)
        if not m:
            return False
        at, (string, scalar, mark) = m.end(), m.groups()
        if first and mark != "{":
            return False
        first = False
        if string is not None and expect in ("key", "key or end"):
            expect = "colon"
        elif (string is not None or scalar is not None) and expect in ("value", "value or end"):
            expect = "after"
        elif mark in ("{", "[") and mark is not None and expect in ("value", "value or end"):
            stack.append(mark)
            expect = "key or end" if mark == "{" else "value or end"
        elif mark in ("}", "]") and stack and stack[-1] == ("{" if mark == "}" else "[") and (expect == "after" or expect == ("key or end" if mark == "}" else "value or end")):
            stack.pop()
            expect = "after" if stack else "nothing"
        elif mark == ":" and expect == "colon":
            expect = "value"
        elif mark == "," and expect == "after":
            expect = "key" if stack[-1] == "{" else "value"
        else:
            return False
    return expect == "nothing"


@F.pandas_udf(T.BooleanType())
def _strict_object(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else is_strict_json_object(x)).astype(object)


def check_case_id(value: Column) -> Column:
    return ~F.coalesce(blank_trim(value), F.lit("")).rlike(r"\A[A-Za-z0-9_.\-]{1,64}\z")


def check_slots_json(value: Column) -> Column:
    return (blank_trim(value) != "") & ~_strict_object(value)


#: Column and the test for an invalid value, in the order of the reasons.
SEED_CHECKS: tuple[tuple[str, Callable[[Column], Column]], ...] = (("case_id", check_case_id), ("slots_json", check_slots_json))


def parse_records(df: DataFrame, key: str, raw: str, columns: tuple[str, ...] = SEED_COLUMNS) -> DataFrame:
    """key, one column for each field (null where the structure is broken) and `structure`: the reason or null."""
    cut = df.select(F.col(key).alias(key), _once(_safe(F.col(raw))).alias("_s"))
    cut = cut.select(key, "_s", _once(_outline(F.col("_s"))).alias("_o"))
    cut = cut.select(key, "_s", _once(_structure(F.col("_o"), len(columns))).alias("structure"))
    cut = cut.select(key, "structure", _once(F.when(F.col("structure").isNull(), _fields(F.col("_s")))).alias("_f"))
    return cut.select(key, "structure", *(F.when(F.col("structure").isNull(), _unquoted(F.col("_f")[i])).alias(c) for i, c in enumerate(columns)))


def invalid_values(parsed: DataFrame, checks) -> DataFrame:
    """Dictionary (column, value) of the invalid values; each distinct value of a column is checked once."""
    named = F.array(*(F.struct(F.lit(column).alias("column"), F.col(column).alias("value")) for column, _ in checks))
    distinct = parsed.where(F.col("structure").isNull()).select(F.inline(named)).distinct()
    bad = F.lit(False)
    for column, check in checks:
        bad = bad | F.coalesce(check(F.when(F.col("column") == column, F.col("value"))) & (F.col("column") == column), F.lit(False))
    return distinct.where(bad)


def _may_be_sent(dictionary: DataFrame) -> bool:
    size = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    return size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES


#: Parts that a hot value is spread over where the dictionary is joined by value.
SALTS = 16


def with_reasons(df: DataFrame, key: str, raw: str, columns: tuple[str, ...] = SEED_COLUMNS, checks=SEED_CHECKS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """parse_records with a column `reason`, null for rows that can be loaded; of the fields only those named in keep, by default all.

    Records are parsed once and written. The dictionary is written too, and its rows and bytes are measured:
    within the bounds it is sent to the executors and the records are not shuffled; beyond them it is joined
    by value and salt, so that a value that many records share, or null, does not meet in one task.
    """
    keep = columns if keep is None else keep
    parsed = out = materialize(parse_records(df, key, raw, columns).select(key, "structure", *dict.fromkeys([*keep, *(c for c, _ in checks)])))
    dictionary = materialize(invalid_values(parsed, checks))
    small, reason = _may_be_sent(dictionary), F.col("structure")
    if not small:
        dictionary = dictionary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    for column, _ in checks:
        bad = dictionary.where(F.col("column") == column).withColumn(f"bad_{column}", F.lit(True)).withColumnRenamed("value", column).drop("column")
        out = out.join(F.broadcast(bad), column, "left") if small else out.join(bad, [column, "_salt"], "left")
        reason = F.coalesce(reason, F.when(F.col(f"bad_{column}"), F.lit(column)))
    return out.select(key, *keep, reason.alias("reason"))


def rejected(df: DataFrame, key: str, raw: str) -> DataFrame:
    """Records that cannot be loaded, with the first reason that holds."""
    return with_reasons(df, key, raw, keep=()).where(F.col("reason").isNotNull()).select(key, "reason")


def loaded(df: DataFrame, key: str, raw: str) -> DataFrame:
    """The valid records, typed. Blank fields become null; priority and enabled that cannot be cast too."""
    ok = with_reasons(df, key, raw).where(F.col("reason").isNull())
    blank_to_null = {c: F.nullif(blank_trim(F.col(c)), F.lit("")) for c in SEED_COLUMNS}
    word = F.lower(blank_to_null["enabled"])
    typed = blank_to_null | {
        "text": F.when(blank_to_null["text"].isNotNull(), F.col("text")),
        "priority": blank_to_null["priority"].try_cast("int"),
        "enabled": F.when(word.isin("1", "true", "yes", "y", "on"), True).when(word.isin("0", "false", "no", "n", "off"), False),
    }
    return ok.select(key, *(typed[c].alias(c) for c in SEED_COLUMNS))
