"""Calls to models behind interfaces: retry, request building and answer parsing. Transports are injected."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transport = Callable[[dict], str]


def with_retry(call: Callable[[], str], retries: int = 1, back_off: float = 0.2, sleep: Callable[[float], None] = time.sleep) -> str:
    """retries + 1 attempts with linearly growing pauses; the last error is raised."""
    for i in range(retries + 1):
        try:
            return call()
        except Exception:
            if i == retries:
                raise
            sleep(back_off * (i + 1))
    raise AssertionError


def walk_path(payload: object, path: str | list[str]) -> object | None:
    """Value at a dotted or listed path of keys and indices."""
    for key in path.split(".") if isinstance(path, str) else path:
        if isinstance(payload, list) and str(key).isdigit() and int(key) < len(payload):
            payload = payload[int(key)]
        elif isinstance(payload, dict) and key in payload:
            payload = payload[key]
        else:
            return None
    return payload


def needs_model(top1: Column, top2: Column, enabled: bool, least: float, gap: float, low_confidence: bool) -> Column:
    """Whether a rule's answer is unsure enough to ask a model: low confidence if so set, else a small gap."""
    return F.lit(enabled) & (top1 > 0) & F.when(top1 < least, F.lit(low_confidence)).otherwise(top1 - top2 < gap)


def ask_model(df: DataFrame, text: str, unsure: str, make_transport: Callable[[], Transport], answer_path: str = "choices.0.message.content", most_chars: int | None = 600, retries: int = 1) -> DataFrame:
    """df with `answer`, `answer_error` and `answer_cut`. Only unsure rows reach the transport, each at most once; errors stay in the row.

    A model may take no more than so many characters: longer texts are cut to most_chars (60 at least) and
    marked in answer_cut; with None they go whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport = make_transport()
        for batch in batches:
            answers, errors = [], []
            limit = None if most_chars is None else max(60, most_chars)
            for t in batch[text]:
                try:
                    said = json.loads(with_retry(lambda t=t: transport({"input": (t or "")[:limit]}), retries))
                    value = walk_path(said, answer_path)
                    answers.append(None if value is None else str(value))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(type(e).__name__)
            yield batch.assign(answer_cut=[limit is not None and len(t or "") > limit for t in batch[text]], answer=pd.Series(answers, dtype=object, index=batch.index), answer_error=pd.Series(errors, dtype=object, index=batch.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    asked = df.where(F.col(unsure)).mapInPandas(run, f"{fields}, answer string, answer_error string, answer_cut boolean")
    rest = df.where(~F.coalesce(F.col(unsure), F.lit(False)))
    return asked.unionByName(rest.withColumns({"answer": F.lit(None).cast("string"), "answer_error": F.lit(None).cast("string"), "answer_cut": F.lit(False)}))
