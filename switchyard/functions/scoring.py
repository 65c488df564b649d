"""Scores: keyword overlap, coverage, weighted sums, vectors, sequence similarity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.functions.text import clamp, count_hits


def keyword_overlap(text: Column, tokens: Column, keywords: Column) -> Column:
    """Share of keywords that are tokens (in lower case) or substrings (as they are); 0 for no tokens or keywords."""
    hit = F.filter(keywords, lambda k: F.array_contains(tokens, F.lower(k)) | F.contains(text, k))
    return F.when((F.size(keywords) > 0) & (F.size(tokens) > 0), F.least(F.lit(1.0), F.size(hit) / F.size(keywords))).otherwise(0.0)


def entry_phrase_score(text: Column, phrases: list[str]) -> Column:
    hits = count_hits(text, phrases)
    return F.when(hits == 0, 0.0).otherwise(F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.2) * hits))


def phrase_score(text: Column, phrases: Column) -> Column:
    """entry_phrase_score for an array column; 0 for none."""
    hits = F.size(F.filter(phrases, lambda p: F.contains(text, p)))
    return F.when(F.coalesce(hits, F.lit(0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.2) * hits))


def is_present(c: Column) -> Column:
    """A slot value is present unless it is null or empty text; 0 and false are present."""
    return ~F.coalesce(c, F.lit('""')).isin("null", '""', "")


def coverage(slots: Column, required: Column) -> Column:
    """Share of required slots that are present; 1 if none is required."""
    there = F.filter(required, lambda s: is_present(F.try_element_at(slots, s)))
    return F.when(F.size(required) == 0, 1.0).otherwise(F.size(there) / F.size(required))


def slot_fit(slots: Column, required: Column, optional: Column) -> Column:
    """0.8 of the required and 0.2 of the optional coverage; without optional slots that of the required."""
    both = F.lit(0.8) * coverage(slots, required) + F.lit(0.2) * coverage(slots, optional)
    return F.when(F.size(optional) > 0, both).otherwise(coverage(slots, required))


def weighted_score(parts: list[tuple[float, Column]]) -> Column:
    """Sum of weights times clamped parts, in the order given, clamped."""
    total = F.lit(0.0)
    for weight, part in parts:
        total = total + F.lit(weight) * clamp(part)
    return clamp(total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 if either vector is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_normalise(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(text: pd.Series, sample: pd.Series) -> pd.Series:
    """Longest-matching-block similarity 2M/T of text and lower-case sample, first argument first.

    There is no built-in for it. Use it on distinct pairs; each pair of a batch is computed once.
    """
    seen: dict[tuple, float] = {}
    out = []
    for a, b in zip(text, sample):
        key = (a, b)
        if key not in seen:
            seen[key] = 0.0 if a is None or b is None else SequenceMatcher(None, a, b.lower()).ratio()
        out.append(seen[key])
    return pd.Series(out)


def hashed_embedder(dimension: int = 64, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed hashes of character n-grams, of unit length. Not semantic."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            padded = f" {text.lower()} "
            for i in range(max(1, len(padded) - n + 1)):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + n].encode(), digest_size=8).digest(), "little")
                row[h % dimension] += 1.0 if h >> 63 else -1.0
            size = np.linalg.norm(row)
            row /= size if size else 1.0
        return out

    return encode


def http_embedder(make_transport: Callable[[], Callable[[dict], str]], model: str, dimension: int | None = None) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Makes encoders that ask a server for the vectors of a batch in one call (`data[].embedding`, by `index`)."""

    def make() -> Callable[[list[str]], np.ndarray]:
        transport = make_transport()

        def encode(texts: list[str]) -> np.ndarray:
            if not texts:
                return np.zeros((0, dimension or 0))
            rows = sorted(json.loads(transport({"model": model, "input": texts}))["data"], key=lambda r: r["index"])
            out = np.array([r["embedding"] for r in rows], dtype=float)
            if len(out) != len(texts) or dimension and out.shape[1] != dimension:
                raise ValueError(f"vectors of shape {out.shape} for {len(texts)} texts")
            return out

        return encode

    return make


def model_embedder(load: Callable[[], object]) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Makes encoders around a model with an encode method, loaded once per worker."""

    def make() -> Callable[[list[str]], np.ndarray]:
        model = load()
        return lambda texts: np.asarray(model.encode(texts), dtype=float)

    return make


def make_embedder(config: dict, load: Callable[[], object] | None = None, make_transport: Callable[[], Callable[[dict], str]] | None = None) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """The embedder a configuration names: `hash` (for tests), `local` (a model that load gives) or `http` (a server behind make_transport)."""
    provider, dimension = config.get("provider", "hash"), config.get("dimension")
    if provider == "hash":
        return lambda: hashed_embedder(dimension or 64)
    if provider == "local" and load is not None:
        return model_embedder(load)
    if provider == "http" and make_transport is not None:
        return http_embedder(make_transport, config["model"], dimension)
    raise ValueError(f"no embedder for {provider}")


def embed(text: Column, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "query: ") -> Column:
    """Vector of prefix + text. The encoder is made once per worker and is given Arrow batches."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for batch in batches:
            yield pd.Series(list(encode([prefix + (x or "") for x in batch])))

    return of(text)
