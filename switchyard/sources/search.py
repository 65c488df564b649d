"""Search clients: over index tables, and over HTTP behind an injected transport. Both answer whole tables of queries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.operators import retrieve
from switchyard.session import materialize
from switchyard.sources.readers import resolve_backend
from switchyard.sources.services import with_retry

#: Takes a path and a body, gives the answer's text.
Transport = Callable[[str, dict], str]


class TableSearch:
    """Indices as parquet tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, index: str) -> str:
        return f"{self.folder}/{index}"

    def ping(self) -> bool:
        return True

    def exists(self, index: str) -> bool:
        try:
            self.spark.read.parquet(self._path(index))
            return True
        except Exception:  # noqa: BLE001 - no such table
            return False

    def docs(self, index: str, scene: str | None = None) -> DataFrame:
        """Documents of an index; a scene is filtered before any search."""
        docs = self.spark.read.parquet(self._path(index))
        return docs if scene is None else docs.where(F.col("scene_id") == scene)

    def text(self, index: str, queries: DataFrame, query: str, text: str, fields: dict[str, float], k: int = 5, scene: str | None = None) -> DataFrame:
        return retrieve.bm25_fields(queries, self.docs(index, scene), query, text, "id", fields, k)

    def vector(self, index: str, queries: DataFrame, query: str, vector: str, k: int = 5, scene: str | None = None) -> DataFrame:
        """Nearest documents by cosine; ids of queries and documents are texts, for which numbers stand in."""
        docs = materialize(self.docs(index, scene).withColumn("_n", F.monotonically_increasing_id() + (1 << 40)))
        asked = materialize(queries.select(query, F.col(vector).alias("vector")).withColumn("_q", F.monotonically_increasing_id()))
        hits = retrieve.knn(asked, docs, k, "_q", "_n", "vector")
        named = hits.toDF("_q", "_n", "score", "rank").join(docs.select("_n", "id"), "_n").join(asked.select("_q", query), "_q")
        return named.select(query, F.col("id").alias("doc_id"), "score", "rank")


def search_body(text: str, fields: dict[str, float], k: int, scene: str | None = None) -> dict:
    """Body of a text search over boosted fields, with an optional filter on the scene."""
    match = {"multi_match": {"query": text, "fields": [f if b == 1 else f"{f}^{b:g}" for f, b in fields.items()]}}
    return {"size": k, "query": match if scene is None else {"bool": {"must": [match], "filter": [{"term": {"scene_id": scene}}]}}}


def found(answer: str) -> list[tuple[str, float]]:
    """Ids and scores in an answer."""
    return [(h["_id"], float(h["_score"] or 0.0)) for h in json.loads(answer).get("hits", {}).get("hits", [])]


class HttpSearch:
    """A search server behind a transport, made once per batch of queries; every call is tried again as with_retry does."""

    def __init__(self, make_transport: Callable[[], Transport], retries: int = 1, back_off: float = 0.2) -> None:
        self.make_transport, self.retries, self.back_off = make_transport, retries, back_off

    def _call(self, path: str, body: dict) -> str:
        return with_retry(lambda: self.make_transport()(path, body), self.retries, self.back_off)

    def ping(self) -> bool:
        try:
            self._call("/", {})
            return True
        except Exception:  # noqa: BLE001 - not there
            return False

    def exists(self, index: str) -> bool:
        try:
            return "error" not in json.loads(self._call(f"/{index}", {}))
        except Exception:  # noqa: BLE001 - not there
            return False

    def text(self, index: str, queries: DataFrame, query: str, text: str, fields: dict[str, float], k: int = 5, scene: str | None = None) -> DataFrame:
        """One call per query row, on the executors; a query that fails has one row with `error`."""
        make, retries, back_off = self.make_transport, self.retries, self.back_off

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            transport = make()
            for batch in batches:
                rows = []
                for key, t in zip(batch["q"], batch["t"]):
                    try:
                        answer = with_retry(lambda t=t: transport(f"/{index}/_search", search_body(t or "", fields, k, scene)), retries, back_off)
                        rows += [(key, d, s, i + 1, None) for i, (d, s) in enumerate(found(answer))]
                    except Exception as e:  # noqa: BLE001
                        rows.append((key, None, None, None, type(e).__name__))
                yield pd.DataFrame(rows, columns=["q", "doc_id", "score", "rank", "error"]).astype({"score": "float64", "rank": "Int32"})

        asked = queries.select(F.col(query).alias("q"), F.col(text).alias("t"))
        kind = dict(asked.dtypes)["q"]
        return asked.mapInPandas(run, f"q {kind}, doc_id string, score double, rank int, error string").withColumnRenamed("q", query)


def build_client(spark: SparkSession, backend: str | None = None, folder: str | None = None, make_transport: Callable[[], Transport] | None = None, env: str | None = None, config: str | None = None) -> TableSearch | HttpSearch:
    """The client of the backend that resolve_backend names."""
    name = resolve_backend(backend, env, config)
    if name == "table":
        return TableSearch(spark, folder or ".")
    if make_transport is None:
        raise ValueError(f"{name} needs a transport")
    return HttpSearch(make_transport)


def ready(client: TableSearch | HttpSearch, *indices: str) -> bool:
    """Whether the server answers and has all indices."""
    return client.ping() and all(client.exists(i) for i in indices)
