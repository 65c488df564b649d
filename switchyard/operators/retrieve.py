"""Retrieval over index tables: exact nearest neighbours by blocks, BM25 over an inverted index, lexical scores; resolvers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions.scoring import embed, keyword_overlap, sequence_ratio
from switchyard.functions.text import TOKEN_SPLIT as TOKENS
from switchyard.functions.text import extract_ip, tokenize
from switchyard.operators.ranking import top_k
from switchyard.session import is_small, materialize

#: Most queries of one pass over the index; they are sent to every executor.
MOST_QUERIES = 20_000
#: Most tokens of the queries of one pass over the documents.
MOST_TOKENS = 2_000_000
#: Most rows of the index, and cells of queries x rows, that are scored at a time.
BLOCK, CELLS = 4096, 4_000_000


def knn(queries: DataFrame, index: DataFrame, k: int, query_id: str, item_id: str, vector: str, same: str | None = None) -> DataFrame:
    """query_id, item_id, score (cosine), rank: the k nearest items of each query, exactly.

    queries x index in blocks: the queries, counted to be few, are sent along as a matrix, every block of
    index rows is one matrix product, and only k rows per query leave a partition. More queries than
    MOST_QUERIES are worked off in several passes. same: a column that must be equal on both sides, tested
    before the ranking. An item is no neighbour of itself; null vectors take no part; ties break on item_id.
    """
    keep = [same] if same else []
    queries = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"), *[F.col(c).alias("s") for c in keep])
    index = index.where(F.col(vector).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v"), *[F.col(c).cast("string").alias("s") for c in keep])
    passes = 1 if is_small(queries, MOST_QUERIES) else -(-queries.count() // MOST_QUERIES)
    part = F.pmod(F.xxhash64("q"), F.lit(passes))
    hits = [_knn_pass(queries.where(part == p), index, k, bool(same)) for p in range(passes)]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    out = top_k(out, ["q"], [F.col("score").desc(), F.col("i")], k)
    return out.select(F.col("q").alias(query_id), F.col("i").alias(item_id), "score", "rank")


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


#: Arrow types of ids.
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class _Best:
    """The k best items of each of n queries so far: by falling score, then item."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.items = k, np.full((n, 0), -np.inf), None

    def add(self, scores: np.ndarray, items: np.ndarray, key: Callable[[np.ndarray], np.ndarray] = lambda s: s) -> None:
        """scores: a row per query, a column per item; -inf for what is no hit."""
        some = np.broadcast_to(items, scores.shape)
        both = scores if self.items is None else np.hstack([self.scores, scores])
        named = some if self.items is None else np.hstack([self.items, some])
        order = np.lexsort((named, -key(both)), axis=1)[:, : self.k]
        self.scores, self.items = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)

    def rows(self, ids: np.ndarray, query_kind: str, item_kind: str) -> pa.RecordBatch:
        ok = self.scores.ravel() > -np.inf
        items = np.zeros((len(ids), 0)) if self.items is None else self.items
        q = np.repeat(ids, self.scores.shape[1])
        columns = [pa.array(v.ravel()[ok].tolist(), _ARROW.get(kind, pa.string())) for v, kind in ((q, query_kind), (items, item_kind))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(self.scores.ravel()[ok])], names=["q", "i", "score"])


def _block(n_queries: int) -> int:
    """Items that are scored at a time."""
    return max(1, min(BLOCK, CELLS // max(1, n_queries)))


def _plain(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _knn_pass(queries: DataFrame, index: DataFrame, k: int, same: bool) -> DataFrame:
    rows = queries.orderBy("q").collect()  # at most MOST_QUERIES, counted
    ids = np.array([r.q for r in rows], dtype=np.int64)
    matrix = _unit(np.array([r.v for r in rows], dtype=float)) if rows else np.zeros((0, 1))
    groups = np.array([str(r.s) for r in rows]) if same else None
    sent = queries.sparkSession.sparkContext.broadcast((ids, matrix, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, groups = sent.value
        best = _Best(len(ids), k)
        for batch in batches if len(ids) else ():
            for begin in range(0, batch.num_rows, _block(len(ids))):
                b = batch.slice(begin, _block(len(ids)))
                items = b.column(0).to_numpy(zero_copy_only=False)
                vectors = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(items), -1))
                scores = matrix @ vectors.T
                scores[ids[:, None] == items[None, :]] = -np.inf
                if groups is not None:
                    scores[groups[:, None] != np.array(b.column(2).to_pylist(), dtype=object)[None, :].astype(str)] = -np.inf
                best.add(scores, items)
        yield best.rows(ids, "bigint", "bigint")

    return index.mapInArrow(run, "q bigint, i bigint, score double")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKENS), lambda x: x != "")


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, text: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank by BM25 over distinct query tokens; statistics over all documents."""
    return bm25_fields(queries, docs, query_id, query_text, doc_id, {text: 1.0}, k, k1, b)


def bm25_fields(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, fields: dict[str, float], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank over several fields with boosts: the best field of a document counts.

    Each field is an index with its own statistics, its BM25 times its boost; fields of a struct are named
    with a dot, and the parts of an array are one text. A document without a field does not count in it.

    queries x documents in blocks, as for vectors: the queries' distinct tokens, counted, are sent along, the
    documents stay where they are, and only k rows per query leave a partition, so frequent words need no
    shuffle. More queries than MOST_QUERIES, or than have MOST_TOKENS tokens, are worked off in several passes.
    """
    kinds = [dict(docs.select(F.col(f).alias("f")).dtypes)["f"] for f in fields]
    texts = [F.nullif(F.concat_ws(" ", F.col(f)), F.lit("")) if kind.startswith("array") else F.col(f) for f, kind in zip(fields, kinds)]
    words = docs.select(F.col(doc_id).alias("i"), *(_words(t).alias(f"w{n}") for n, t in enumerate(texts)))
    asked = materialize(queries.select(F.col(query_id).alias("q"), tokenize(F.col(query_text)).alias("tokens")))
    n_queries, n_tokens = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    passes = max(1, -(-n_queries // MOST_QUERIES), -(-n_tokens // MOST_TOKENS))
    # A blank, which no token holds, stands for the document itself, so that one pass gives all statistics.
    terms = asked.select(F.explode("tokens").alias("token")).distinct().unionByName(asked.sparkSession.createDataFrame([(" ",)], "token string"))
    terms = F.broadcast(terms) if is_small(terms) else terms
    counts = []
    for n in range(len(fields)):
        each = words.where(F.col(f"w{n}").isNotNull()).select(F.size(f"w{n}").alias("dl"), F.explode(F.array_append(F.array_distinct(f"w{n}"), F.lit(" "))).alias("token"))
        frequency = materialize(each.join(terms, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")))
        total = frequency.where("token = ' '").first()
        counts.append((frequency.where("token <> ' '"), total.df if total else 0, total.dl / total.df if total and total.dl else 1.0))
    part = F.pmod(F.xxhash64("q"), F.lit(passes))
    hits = [_bm25_pass(asked.where(part == p), words, counts, list(fields.values()), k, k1, b) for p in range(passes)]
    best = top_k(reduce(DataFrame.unionByName, hits), ["q"], [F.round("score", 6).desc(), F.col("i")], k)
    return best.select(F.col("q").alias("query_id"), F.col("i").alias("doc_id"), "score", "rank")


def _bm25_pass(asked: DataFrame, words: DataFrame, counts: list[tuple[DataFrame, int, float]], boosts: list[float], k: int, k1: float, b: float) -> DataFrame:
    rows = asked.orderBy("q").collect()  # bounded by MOST_QUERIES and MOST_TOKENS, counted
    ids = np.array([r.q for r in rows])
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.tokens}))}
    pairs = np.array([(vocabulary[t], q) for q, r in enumerate(rows) for t in r.tokens], dtype=np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    starts = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))
    here = asked.select(F.explode("tokens").alias("token")).distinct()
    idf = np.zeros((len(boosts), len(vocabulary)))
    for n, (frequency, total, _) in enumerate(counts):
        for r in frequency.join(F.broadcast(here) if len(vocabulary) <= MOST_TOKENS else here, "token", "left_semi").toLocalIterator():
            idf[n, vocabulary[r.token]] = np.log(1 + (total - r.df + 0.5) / (r.df + 0.5))
    # Words of many queries are scored as a matrix product, the others posting by posting.
    asks = np.diff(starts)
    common = np.argsort(-asks, kind="stable")[: max(1, CELLS // max(1, len(ids)))]
    common = common[asks[common] * 50 >= len(ids)]
    sent = asked.sparkSession.sparkContext.broadcast((ids, vocabulary, pairs[:, 1].copy(), starts, idf, common, [c[2] for c in counts]))
    kind, item_kind = dict(asked.dtypes)["q"], dict(words.dtypes)["i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vocabulary, askers, starts, idf, common, averages = sent.value
        best, n, asks = _Best(len(ids), k), len(ids), np.diff(starts)
        place = np.full(len(asks), -1)
        place[common] = np.arange(len(common))
        dense = np.zeros((len(common), n))
        for row, t in enumerate(common):
            dense[row, askers[starts[t] : starts[t + 1]]] = 1.0
        for batch in batches if n and len(asks) else ():
            for begin in range(0, batch.num_rows, _block(n)):
                piece = batch.slice(begin, _block(n))
                size, scores = piece.num_rows, np.zeros((n, piece.num_rows))
                for f, boost in enumerate(boosts):
                    column = piece.column(1 + f)
                    length = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                    coded = column.flatten().dictionary_encode()
                    known = np.array([vocabulary.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
                    token = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, dtype=np.int64)
                    doc = np.repeat(np.arange(size), length)[token >= 0]
                    key, tf = np.unique(doc * len(asks) + token[token >= 0], return_counts=True)
                    doc, token = key // len(asks), key % len(asks)
                    weight = boost * idf[f, token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / averages[f]))
                    mine = np.zeros((n, size))
                    often = place[token] >= 0
                    if often.any():
                        matrix = np.zeros((size, len(common)))
                        matrix[doc[often], place[token[often]]] = weight[often]
                        mine += (matrix @ dense).T
                    doc, token, weight = doc[~often], token[~often], weight[~often]
                    if len(token):
                        times = asks[token]
                        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        who = askers[np.repeat(starts[token], times) + within]
                        mine += np.bincount(who * size + np.repeat(doc, times), weights=np.repeat(weight, times), minlength=n * size).reshape(n, size)
                    scores = np.maximum(scores, mine)
                best.add(np.where(scores > 0, scores, -np.inf), _plain(piece.column(0)), lambda s: np.round(s, 6))
        yield best.rows(ids, kind, item_kind)

    return words.mapInArrow(run, f"q {kind}, i {item_kind}, score double")


def lexical_scores(pairs: DataFrame, norm: str, keywords: str, examples: str) -> DataFrame:
    """pairs with `score`: the greater of the keyword overlap and the best similarity to an example. Each distinct text and example is compared once."""
    each = pairs.select(norm, F.explode(examples).alias("_example")).where(F.col(norm).isNotNull() & F.col("_example").isNotNull()).distinct()
    ratios = each.withColumn("_ratio", sequence_ratio(norm, "_example"))
    best = pairs.select(norm, examples).distinct().withColumn("_example", F.explode(examples)).join(ratios, [norm, "_example"]).groupBy(norm, examples).agg(F.max("_ratio").alias("_best"))
    words = F.coalesce(keyword_overlap(F.col(norm), tokenize(F.col(norm)), F.coalesce(F.col(keywords), F.array().cast("array<string>"))), F.lit(0.0))
    return pairs.join(best, [norm, examples], "left").withColumn("score", F.greatest(words, F.coalesce("_best", F.lit(0.0)))).drop("_best")


def lexical(queries: DataFrame, items: DataFrame, k: int, query_id: str, norm: str, item_id: str, keywords: str, examples: str, same: str | None = None) -> DataFrame:
    """query_id, item_id, score, rank: the k items of greatest lexical score, every pair being scored; ties break on item_id.

    For templates, same is their scene; for seed cases, keywords are the tags and examples the text and label.
    """
    keep = [same] if same else []
    asked = queries.select(F.col(query_id).alias("q"), F.col(norm).alias("_norm"), *keep)
    there = items.select(F.col(item_id).alias("i"), F.col(keywords).alias("_keywords"), F.col(examples).alias("_examples"), *keep)
    # Items of this retriever are scenes or templates; where they are few, as counted, they go to the queries.
    there = F.broadcast(there) if is_small(items) else there
    scored = lexical_scores(asked.join(there, same) if same else asked.crossJoin(there), "_norm", "_keywords", "_examples")
    best = top_k(scored, ["q"], [F.col("score").desc(), F.col("i")], k)
    return best.select(F.col("q").alias(query_id), F.col("i").alias(item_id), "score", "rank")


def with_query_vectors(queries: DataFrame, norm: str, make_encoder, prefix: str = "query: ") -> DataFrame:
    """queries with `query_vector`; each distinct text is encoded once, whatever the number of queries that have it."""
    vectors = queries.select(norm).distinct().withColumn("query_vector", embed(F.coalesce(F.col(norm), F.lit("")), make_encoder, prefix))
    known = materialize(vectors.withColumn("_key", F.coalesce(F.md5(norm), F.lit("")))).drop(norm)
    return queries.withColumn("_key", F.coalesce(F.md5(norm), F.lit(""))).join(known, "_key").drop("_key")


def no_hits(queries: DataFrame, query_id: str, item_id: str, item_type: str = "string") -> DataFrame:
    """The retriever where there is no index: no row, with the columns of the others."""
    return queries.select(F.col(query_id), F.lit(None).cast(item_type).alias(item_id), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)


def _candidate(entity_id: Column, name: Column, score: float) -> Column:
    return F.struct(entity_id.alias("entity_id"), name.alias("name"), F.lit(score).alias("score"))


def resolve_devices(text: Column, words: list[tuple[list[str], str, str, float]] = (), k: int = 5) -> Column:
    """Candidates (entity_id, name, score): the first address as dev_a_b_c_d at 0.9, then every entry (words, id, name, score) of which a word occurs."""
    ip, low = extract_ip(text), F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    found = [F.when(ip.isNotNull(), _candidate(F.concat(F.lit("dev_"), F.replace(ip, F.lit("."), F.lit("_"))), F.concat(F.lit("设备"), ip), 0.9))]
    for ws, entity, name, score in words:
        found.append(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w.lower())) for w in ws)), _candidate(F.lit(entity), F.lit(name), score)))
    return F.slice(F.array_compact(F.array(*found)), 1, k)


def resolve_regions(text: Column, regions: dict[str, tuple[str, str]], k: int = 5) -> Column:
    """Candidates at 0.88, one for each word of regions (to id and name) that occurs, in the order of regions."""
    found = [F.when(F.contains(text, F.lit(w)), _candidate(F.lit(e), F.lit(n), 0.88)) for w, (e, n) in regions.items()]
    return F.slice(F.array_compact(F.array(*found)), 1, k)
