"""Column functions on text: normalising, tokens, ordered extraction, coercion. All built-in, but for JSON repairs (Arrow)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, written out so that other engines can use the same class.
SPACE = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space and the marks that part tokens.
TOKEN_SPLIT = SPACE[:-1] + r",，。？！!?:：;；、/\\|]+"
_FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def uni_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(c: Column) -> Column:
    """Trimmed, lower case, the four full-width marks as spaces, white space collapsed; not trimmed again."""
    return F.regexp_replace(F.translate(F.lower(uni_trim(c)), "，。？！", "    "), f"{SPACE}+", " ")


def tokenize(c: Column) -> Column:
    """Distinct lower-case tokens; an empty array for null or blank text."""
    return F.coalesce(F.array_distinct(F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda x: x != "")), F.array().cast("array<string>"))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword is a substring, as a disjunction of literals that the optimizer can fold."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k.lower()))
    return F.coalesce(out, F.lit(False))


def count_hits(text: Column, keywords: list[str]) -> Column:
    out = F.lit(0)
    for k in keywords:
        out = out + F.when(F.contains(text, F.lit(k)), 1).otherwise(0)
    return out


def first_match(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    """Value of the first rule of which a keyword is a substring; null if none. The order is the rule."""
    out = None
    for keywords, value in rules:
        hit = contains_any(text, keywords)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if out is not None else F.lit(None).cast("string")


def western_digits(c: Column) -> Column:
    return F.translate(c, _FULL_WIDTH_DIGITS, "0123456789")


def extract_number(text: Column, pattern: str, kind: str, low: float, high: float) -> Column:
    """First group of the first match as a number within [low, high]; else null."""
    value = F.nullif(F.regexp_extract(western_digits(text), pattern, 1), F.lit("")).try_cast(kind)
    return F.when((value >= low) & (value <= high), value)


#: What stands before a count and before a share, so that the same numbers are found.
COUNT_WORDS, SHARE_WORDS = (r"top\s*", "前"), (">", "大于", "超过")


def extract_topn(text: Column) -> Column:
    """The first count that follows one of COUNT_WORDS in any case, from 1 to 1000."""
    return extract_number(text, f"(?i)(?:{'|'.join(COUNT_WORDS)})([0-9]+)", "bigint", 1, 1000)


def extract_percent(text: Column) -> Column:
    """The first share in percent that follows one of SHARE_WORDS, from 0 to 100."""
    return extract_number(text, rf"(?:{'|'.join(SHARE_WORDS)})\s*([0-9]+(?:\.[0-9]+)?)\s*%", "double", 0, 100)


def extract_ip(text: Column) -> Column:
    """First four groups of one to three digits parted by points, with no digit on either side; their values are not checked."""
    group = "[0-9]{1,3}"
    return F.regexp_substr(text, F.lit(rf"(?<![0-9]){group}\.{group}\.{group}\.{group}(?![0-9])"))


def is_ipv4(c: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.coalesce(c.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z"), F.lit(False))


def json_path(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def _object_text(text: str) -> str | None:
    """The text, if it is one JSON object and nothing more."""
    try:
        return text if isinstance(json.loads(text, parse_int=str), dict) else None
    except (ValueError, RecursionError):
        return None


def _first_object(tries) -> str | None:
    return next((x for x in map(_object_text, tries) if x is not None), None)


def _repaired(text: str) -> str | None:
    text = text.strip()
    try:
        if not isinstance(json.loads(text, parse_int=str), dict):
            return None
        return text
    except (ValueError, RecursionError):
        return _first_object((text.replace('\\"', '"'), text.replace("“", '"').replace("”", '"'), text.strip("'").replace("'", '"')))


_FENCE = re.compile(r"\A\s*```(?:json)?|```\s*\Z")
_BRACES = re.compile(r"\{.*\}", re.DOTALL)


def _embedded(text: str) -> str | None:
    braces = _BRACES.search(text)
    return _first_object([_FENCE.sub("", text).strip(), *([braces.group()] if braces else [])])


def _per_distinct(function):
    """An Arrow UDF that applies function once to each distinct text of a batch. Built-in JSON parsers stop after the first value of a text."""

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts)
        done = [function(x) for x in distinct]
        return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)

    return of


def _valid(text: str) -> str | None:
    try:
        json.loads(text, parse_int=str)
        return ""
    except (ValueError, RecursionError):
        return None


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing more; false for null."""
    return _per_distinct(_valid)(c).isNotNull()


def embedded_json(c: Column) -> Column:
    """The JSON object in a model's answer: the text without code fences, else its outermost braces; null if neither is one."""
    return _per_distinct(_embedded)(c)


def repaired_json(c: Column) -> Column:
    """The JSON object a text holds, nothing after it: as it is, else with unescaped quotes, straight ones for curly ones, or
    double ones for single ones, whichever parses first. Null for anything else, also for arrays and scalars."""
    return _per_distinct(_repaired)(c)


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(uni_trim(c), F.lit("")) for c in columns))


def clean_list(c: Column) -> Column:
    """Trimmed elements without blanks; an empty array for null."""
    return F.coalesce(F.filter(F.transform(c, uni_trim), lambda x: x != ""), F.array().cast("array<string>"))


def bool_word(c: Column, blank: bool | None = False) -> Column:
    """true, 1, yes, y, on and their opposites; null for other words; blank as given."""
    word = F.lower(uni_trim(c))
    known = F.when(word.isin("1", "true", "yes", "y", "on"), True).when(word.isin("0", "false", "no", "n", "off"), False)
    return F.when(F.coalesce(word, F.lit("")) == "", F.lit(blank)).otherwise(known)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; NaN and null become the lower bound."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(c.cast("double"), F.lit(low)), F.lit(low))))


def round_count(c: Column, least: int, default: int) -> Column:
    """A counter held as text: an integer of at least `least`, else the default."""
    value = uni_trim(c.cast("string")).try_cast("int")
    return F.when(value.isNull(), default).otherwise(F.greatest(F.lit(least), value))


def split_tags(c: Column) -> Column:
    return clean_list(F.split(c, r"[,|]"))
