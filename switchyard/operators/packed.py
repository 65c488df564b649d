"""Several values packed in one field: a quote-aware tokenizer and its explode operator.

Rules
- Separators: comma, semicolon, bar and ideographic comma in all their widths, the Arabic comma and
  semicolon, tab and line break. Any mixture of them may occur in one field.
- A quote opens a quoted stretch only as the first visible character of a value. Inside, separators
  belong to the value, a doubled closing quote stands for one, and a backslash keeps the quote or
  backslash that follows. Text between the closing quote and the next separator is appended.
- A quote that is never closed is an ordinary character.
- Brackets are removed if the first one closes with the last character of the field.
- Outer blanks are removed; blank pieces give no value and take no position. Repeats stay.

Defined cases: null, empty and blank fields give no rows; a row's other columns do not matter, so
clashing names cannot; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ",;|\t\n\r\x0b\x0c  、，；｜､،؛"
#: Opening quote and the quotes that close it.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "„": "“”", "＂": "＂"}
BRACKETS = {"[": "]", "(": ")", "{": "}", "【": "】", "（": "）", "［": "］", "｛": "｝", "〔": "〕"}
_SPLIT = re.compile(f"[{re.escape(SEPARATORS)}]")
_SPECIAL = re.compile("[" + re.escape("".join(QUOTES) + "".join(BRACKETS)) + "]")


def _without_brackets(field: str) -> str:
    """Removes pairs of brackets that enclose the whole field, by tracking quotes and depth."""
    while field and field[0] in BRACKETS:
        close, depth, quote, at, size = BRACKETS[field[0]], 0, "", 0, len(field)
        fresh = True  # at the start of a value, where a quote opens
        while at < size:
            ch = field[at]
            if quote:
                if ch == "\\" and at + 1 < size and field[at + 1] in quote + "\\":
                    at += 1
                elif ch in quote:
                    if at + 1 < size and field[at + 1] == ch:
                        at += 1
                    else:
                        quote = ""
            elif fresh and ch in QUOTES and _closing(field, at) >= 0:
                quote, fresh = QUOTES[ch], False
            elif ch == field[0]:
                depth, fresh = depth + 1, True
            elif ch == close:
                depth -= 1
                if depth == 0:
                    break
            elif ch in SEPARATORS:
                fresh = True
            elif not ch.isspace():
                fresh = False
            at += 1
        if depth or at != size - 1:
            return field
        field = field[1:-1].strip()
    return field


def _closing(field: str, start: int) -> int:
    """Position of the quote that closes the one at start, or -1."""
    ends, at, size = QUOTES[field[start]], start + 1, len(field)
    while at < size:
        ch = field[at]
        if ch == "\\" and at + 1 < size and field[at + 1] in ends + "\\":
            at += 2
        elif ch in ends:
            if at + 1 < size and field[at + 1] == ch:
                at += 2
            else:
                return at
        else:
            at += 1
    return -1


def _unescaped(quoted: str, ends: str) -> str:
    out, at = [], 0
    while at < len(quoted):
        ch, after = quoted[at], quoted[at + 1 : at + 2]
        if after and (ch == "\\" and after in ends + "\\" or ch in ends and after == ch):
            out.append(after)
            at += 2
        else:
            out.append(ch)
            at += 1
    return "".join(out)


def tokenize_packed(field: str | None) -> list[str]:
    """The values of one field, in order."""
    if field is None:
        return []
    field = field.strip()
    if not _SPECIAL.search(field):
        return [v for piece in _SPLIT.split(field) if (v := piece.strip())]
    field = _without_brackets(field)
    values: list[str] = []
    at, size = 0, len(field)
    while at <= size:
        while at < size and field[at].isspace() and field[at] not in SEPARATORS:
            at += 1
        value = ""
        if at < size and field[at] in QUOTES and (end := _closing(field, at)) >= 0:
            value = _unescaped(field[at + 1 : end], QUOTES[field[at]])
            at = end + 1
        cut = _SPLIT.search(field, at)
        stop = cut.start() if cut else size
        value = (value + field[at:stop].rstrip()).strip()
        if value:
            values.append(value)
        at = stop + 1
    return values


@F.pandas_udf(T.ArrayType(T.StringType()))
def packed_values(fields: pd.Series) -> pd.Series:
    """Values of each field; each distinct field of a batch is tokenized once."""
    codes, distinct = pd.factorize(fields)
    done = [tokenize_packed(x) for x in distinct]
    return pd.Series([done[c] if c >= 0 else [] for c in codes], dtype=object)


def explode_packed(df: DataFrame, column: str, key: str, value: str = "tag", position: str = "pos") -> DataFrame:
    """One row for each value of df[column]: key, position (from 1) and value. No shuffle."""
    fields = df.select(F.col(key).alias("k"), F.col(column).alias("f")).where(F.col("f").isNotNull())
    return fields.select("k", F.posexplode(packed_values("f")).alias("p", "v")).select(
        F.col("k").alias(key), (F.col("p") + 1).cast("int").alias(position), F.col("v").alias(value)
    )
