"""Visually identical text with different characters (problem 1): skeletons from look-alike data.

skeleton: decompose, drop what is invisible, fold width variants, replace every character by its
prototype from the look-alike table, decompose again. Two texts look the same if their skeletons are
equal. The table is read from the ICU library that Spark ships (Unicode's confusables, UTS #39), by
asking it for the prototype of every assigned character; it has a few thousand entries, bounded by
Unicode. Letter case, the number of spaces and punctuation are kept.

Defined cases: null texts have no skeleton and take no part; empty and blank texts are texts like any
other; texts that are the same characters are no pair; ids are compared as strings; whole texts are used.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.session import materialize

#: Ranges of characters that show nothing, beside category Cf: joiners, fillers, variation selectors, tags.
_INVISIBLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))


def _assigned() -> list[int]:
    return [c for c in range(0x21, 0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]


def _invisible(cp: int) -> bool:
    return any(a <= cp <= b for a, b in _INVISIBLE) or unicodedata.category(chr(cp)) == "Cf"


@lru_cache(maxsize=1)
def _width_table() -> dict[int, str]:
    """Wide, narrow and non-breaking variants by their compatibility decomposition, and invisible characters."""
    out: dict[int, str] = {}
    for cp in _assigned():
        kind = unicodedata.decomposition(chr(cp)).partition(" ")[0]
        if _invisible(cp):
            out[cp] = ""
        elif kind in ("<wide>", "<narrow>", "<noBreak>", "<small>") or 0x2F00 <= cp <= 0x2FDF and kind == "<compat>":
            out[cp] = unicodedata.normalize("NFKD", chr(cp))
        elif unicodedata.category(chr(cp)) == "Zs":
            out[cp] = " "
    return out | {cp: "" for a, b in _INVISIBLE for cp in range(a, b + 1)}


@lru_cache(maxsize=1)
def _prototypes() -> dict[str, str]:
    """Character to prototype, asked of the session's JVM in one call."""
    checker = SparkSession.getActiveSession()._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shown = [chr(c) for c in _assigned() if not 0xAC00 <= c <= 0xD7A3 and not _invisible(c)]
    plain = [unicodedata.normalize("NFD", c) for c in shown]
    got = checker.getSkeleton("\n".join(plain)).split("\n")
    if len(got) != len(shown):
        raise RuntimeError("the look-alike table cannot be read")
    return {c: p for c, d, p in zip(shown, plain, got) if p != d}


@lru_cache(maxsize=1)
def look_alikes() -> dict[int, str]:
    """The look-alike table for str.translate, after width folding."""
    width = _width_table()
    return {ord(c): p.translate(width) for c, p in _prototypes().items()}


@lru_cache(maxsize=1)
def case_keeping() -> dict[int, str]:
    """Look-alikes of ASCII letters and digits as the one of the same kind; ASCII itself is left alone.

    The skeleton merges I, l and 1; where case is to be ignored afterwards, that would part I from i.
    """
    table = _prototypes()
    of: dict[str, list[str]] = {}
    for c in map(chr, range(0x21, 0x7F)):
        if c.isalnum():
            of.setdefault(table.get(c, c), []).append(c)
    kind = lambda c: (c.isupper(), c.isdigit())
    out = {}
    for c, p in table.items():
        if ord(c) > 0x7F:
            same = of.get(p, [])
            out[ord(c)] = next((a for a in same if kind(a) == kind(c)), same[0] if same else p)
    return out


def skeleton(text: str, table: dict[int, str], width: dict[int, str]) -> str:
    shown = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(width))
    return unicodedata.normalize("NFD", shown.translate(table))


_WHOLE = "\uffff"
#: Vowels and finals of Hangul, which compose with what stands before them.
_JOINING = range(0x1160, 0x1200)


class _PerCharacter(dict):
    """For str.translate: function of each single character, found once; _WHOLE where neighbours have a say."""

    def __init__(self, function) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        parts = unicodedata.normalize("NFD", c)
        value = self.function(c)
        seen = parts[0] + unicodedata.normalize("NFD", value)[:1]
        alone = not any(unicodedata.combining(x) or unicodedata.category(x)[0] == "M" or ord(x) in _JOINING for x in seen) and not any(_invisible(ord(x)) for x in parts)
        self[cp] = value = value if alone and c != _WHOLE and _WHOLE not in value else _WHOLE
        return value


_BY_CHARACTER: dict[str, _PerCharacter] = {}


def _fast(name: str, function):
    """function(text), put together from its values on single characters where the text has no joining ones. One table of a name for each worker."""
    table = _BY_CHARACTER.setdefault(name, _PerCharacter(function))

    def run(text: str) -> str:
        out = text.translate(table)
        return function(text) if _WHOLE in out else out

    return run


def _per_distinct(function):
    """Applies function once to each distinct text of a batch; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts)
        done = [function(x) for x in distinct]
        return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)

    return run


def skeleton_column(text: Column) -> Column:
    table, width = look_alikes(), _width_table()

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return _per_distinct(_fast("skeleton", lambda x: skeleton(x, table, width)))(texts)

    return of(text)


class _Kept(dict):
    """For str.translate: drops every character but letters, marks and digits; each is looked up once."""

    def __missing__(self, cp: int) -> int | None:
        self[cp] = value = cp if unicodedata.category(chr(cp))[0] in "LNM" else None
        return value


_KEPT = _Kept()


def letters_and_digits(text: str, table: dict[int, str], width: dict[int, str]) -> str:
    """Letters (with their marks) and digits of a text, without case and look-alike differences, composed."""
    shown = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(width)).translate(table)
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", shown).casefold())
    return folded.translate(_KEPT)


def letters_and_digits_column(text: Column) -> Column:
    table, width = case_keeping(), _width_table()

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return _per_distinct(_fast("letters_and_digits", lambda x: letters_and_digits(x, table, width)))(texts)

    return of(text)


def consistent_texts(df: DataFrame, text: str) -> DataFrame:
    """df with `consistent`: the text's skeleton, composed; equal for all texts that look the same. No shuffle."""
    table, width = look_alikes(), _width_table()

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return _per_distinct(_fast("consistent", lambda x: unicodedata.normalize("NFC", skeleton(x, table, width))))(texts)

    return df.withColumn("consistent", of(F.col(text)))


def _hash128(c: Column) -> Column:
    return F.unhex(F.md5(c))


def look_alike_pairs(records: DataFrame, rec_id: str, text: str) -> DataFrame:
    """id_lo, id_hi of records whose texts look the same but are not the same characters.

    Records become compact tuples of id, 128-bit hash of the skeleton and 128-bit hash of the text. Forms
    (distinct texts) of one skeleton are paired first and only then expanded to their records, so copies
    of one form are never compared with each other and the work follows the size of the result.
    """
    compact = materialize(_compact(records, rec_id, text))
    forms = compact.select("skel", "form").distinct()
    # Written, so that the join is one of plain exchanges, in which the adaptive plan can split a hot skeleton.
    shared = materialize(forms.groupBy("skel").agg(F.count("*").alias("n")).where("n > 1").select("skel"))
    forms = forms.join(shared, "skel")
    a, b = forms.alias("a"), forms.alias("b")
    pairs = a.join(b, (F.col("a.skel") == F.col("b.skel")) & (F.col("a.form") < F.col("b.form"))).select(F.col("a.form").alias("fa"), F.col("b.form").alias("fb"))
    left = compact.select(F.col("form").alias("fa"), F.col("id").alias("ia"))
    right = compact.select(F.col("form").alias("fb"), F.col("id").alias("ib"))
    full = pairs.join(left, "fa").join(right, "fb").where(F.col("ia") != F.col("ib"))
    return full.select(F.least("ia", "ib").alias("id_lo"), F.greatest("ia", "ib").alias("id_hi"))


def _compact(records: DataFrame, rec_id: str, text: str) -> DataFrame:
    named = records.where(F.col(text).isNotNull() & F.col(rec_id).isNotNull()).select(F.col(rec_id).cast("string").alias("id"), F.col(text).alias("t"))
    return named.select("id", _hash128(skeleton_column(F.col("t"))).alias("skel"), _hash128(F.col("t")).alias("form"))


def _classes(compact: DataFrame) -> DataFrame:
    forms = compact.groupBy("skel", "form").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return forms.groupBy("skel").agg(F.min("id").alias("class_id"), F.count("*").alias("n_forms"), F.sum("n").alias("n_records")).where("n_forms > 1")


def look_alike_classes(records: DataFrame, rec_id: str, text: str) -> DataFrame:
    """One row per skeleton with several forms: class id (its least record id), number of forms and of records."""
    return _classes(_compact(records, rec_id, text)).drop("skel")


def look_alike_members(records: DataFrame, rec_id: str, text: str) -> DataFrame:
    """The pairs in compact form: id and class_id of every record whose text looks like another one, and
    `n_links`: how many records look the same and are not the same characters."""
    compact = materialize(_compact(records, rec_id, text))
    classes = materialize(_classes(compact))
    own = materialize(compact.groupBy("skel", "form").agg(F.count("*").alias("n_own")).join(classes.select("skel"), "skel", "left_semi"))
    linked = own.join(classes.select("skel", "class_id", "n_records"), "skel").select("skel", "form", "class_id", (F.col("n_records") - F.col("n_own")).alias("n_links"))
    return compact.join(materialize(linked), ["skel", "form"]).select("id", "class_id", "n_links")
