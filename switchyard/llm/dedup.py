"""Duplicates hidden by formatting (problem 5): dictionary-encoded records, grouped as integer tuples.

Each column is encoded: every distinct value (of a batch) is brought to canonical form once and gets an
integer identifier of that form. Identifiers are 128 bits of a hash of the canonical form, as two
integers, so that all machines give the same value the same identifier without exchanging a dictionary.
Texts: white space, letter case and punctuation (Unicode category P) are left out. JSON: an object
becomes the sorted tuple of its field-value identifiers; layout, order of fields and the spelling of
numbers and escapes do not matter, order in arrays does. JSON that cannot be parsed is a text of its
own, compared exactly.

Defined cases: null equals null in each column and nothing else; an empty text equals a blank one or
one of punctuation only; of repeated field names in one object the last counts; rows with a null id
are left out; no rows give no groups; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.session import materialize


def _ids(form: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(form, digest_size=16).digest()
    return tuple(int(x) for x in np.frombuffer(digest, dtype="<i8"))


_JSON_NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?")


class _Number(str):
    """A number in canonical form."""


class _Kept(dict):
    """For str.translate: drops white space and punctuation; each character is looked up once."""

    def __missing__(self, cp: int) -> int | None:
        c = chr(cp)
        self[cp] = value = None if c.isspace() or unicodedata.category(c)[0] == "P" else cp
        return value


_KEPT = _Kept()


def canonical_text(text: str) -> str:
    """Without white space, punctuation and letter case."""
    folded = unicodedata.normalize("NFC", text.upper().casefold())
    return folded.translate(_KEPT)


def _number(text: str) -> _Number:
    """A number by its value: 1, 1.0 and 10e-1 are one. Its own digits without outer zeros, and its exponent, however long."""
    sign, whole, part, exponent = _JSON_NUMBER.fullmatch(text).groups(default="")
    digits = (whole + part).lstrip("0")
    if not digits:
        return _Number(sign + "0")
    bare = digits.rstrip("0")
    shift = len(digits) - len(bare) - len(part)
    # Wide enough for every digit of the exponent; int() has a limit of digits.
    power = Context(prec=len(exponent) + 25, Emax=MAX_EMAX, Emin=MIN_EMIN).add(Decimal(exponent), shift) if len(exponent) > 15 else int(exponent or 0) + shift
    return _Number(f"{sign}{bare}e{power:f}" if isinstance(power, Decimal) else f"{sign}{bare}e{power}")


def _canonical(value: object) -> str:
    """JSON text with sorted fields, no layout and numbers by value."""
    if isinstance(value, dict):
        return "{" + ",".join(sorted(json.dumps(k) + ":" + _canonical(v) for k, v in value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    return value if isinstance(value, _Number) else json.dumps(value)


def field_values(text: str) -> list[str]:
    """The field-value pairs of a JSON object in canonical form; one element for any other JSON or text."""
    try:
        value = json.loads(text, parse_float=_number, parse_int=_number)
        if isinstance(value, dict):
            return [json.dumps(k) + ":" + _canonical(v) for k, v in value.items()] or ["{}"]
        return ["=" + _canonical(value)]
    except (ValueError, RecursionError):
        return ["!" + text]


def _encode_text(text: str) -> list[int]:
    return list(_ids(canonical_text(text).encode("utf-8", "surrogatepass")))


def _encode_json(text: str) -> list[int]:
    """The sorted tuple of field-value identifiers, itself encoded if it has more than one."""
    parts = sorted(_ids(p.encode("utf-8", "surrogatepass")) for p in field_values(text))
    return [x for p in parts for x in p]


def _dictionary_udf(encode: Callable[[str], list[int]]):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        done = [encode(x) for x in distinct]
        return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)

    return of


def encoded(df: DataFrame, row_id: str, texts: list[str], objects: list[str]) -> DataFrame:
    """row_id and `record`: the tuple of the columns' identifiers as 16 bytes, whatever the columns' size."""
    columns = [_dictionary_udf(_encode_text)(F.col(c)) for c in texts] + [_dictionary_udf(_encode_json)(F.col(c)) for c in objects]
    # An array of integers or null as text: unlike a concatenation of values it cannot run together.
    tuples = F.concat_ws("|", *(F.coalesce(F.array_join(c.cast("array<string>"), ","), F.lit("n")) for c in columns))
    return df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("row_id"), F.unhex(F.md5(tuples)).alias("record"))


def copies(df: DataFrame, row_id: str, texts: list[str], objects: list[str]) -> DataFrame:
    """row_id_lo, row_id_hi: every copy with the least row id of its group.

    The compact tuples are written once. Groups are found by an aggregation that combines before the
    shuffle, so a hot group costs one row per task; only groups with copies are joined back. They are
    written too, so that both sides of the join are plain exchanges and the adaptive plan can split a hot group.
    """
    tuples = materialize(encoded(df, row_id, texts, objects))
    groups = materialize(tuples.groupBy("record").agg(F.min("row_id").alias("row_id_lo"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = tuples.join(groups, "record").where(F.col("row_id") != F.col("row_id_lo"))
    return joined.select("row_id_lo", F.col("row_id").alias("row_id_hi"))


def collapsed(df: DataFrame, row_id: str, texts: list[str], objects: list[str]) -> DataFrame:
    """One record of each, that of the least row id, with `n_copies`: how many rows it stands for."""
    tuples = materialize(encoded(df, row_id, texts, objects))
    groups = tuples.groupBy("record").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n_copies"))
    kept = groups.select(F.col("row_id").alias(row_id), "n_copies")
    return df.drop("n_copies").join(kept, row_id)
