"""Keyword, vector and fused retrieval over chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import documents, scalars
from ledgerloom.plans.cut import written

RRF = 60
OVERFETCH = 3


def scoped(chunks: DataFrame, cik: str | None = None, accession: str | None = None, slug: str | None = None) -> DataFrame:
    """Chunks of a company, filing or section name; filters come before any scoring. In a slug _ stands for any character."""
    if cik is not None:
        chunks = chunks.filter(F.col("cik") == cik)
    if accession is not None:
        chunks = chunks.filter(F.col("accession") == accession)
    if slug is not None:
        chunks = chunks.filter(F.col("section_id").like(f"%:{slug}"))
    return chunks


def keyword_search(chunks: DataFrame, query: str, k: int = 8) -> DataFrame:
    """(chunk_id, score, text_len): the k chunks that hold most of the query's weight, shorter ones first.

    A query without terms finds nothing. Repeated rows count once.
    """
    terms = scalars.query_terms(query)
    rows = chunks.select("chunk_id", F.length("text").alias("text_len"), scalars.round_half_away(scalars.keyword_score(F.col("text"), terms), 4).alias("score"))
    return rows.filter(F.col("score") > 0).distinct().orderBy(F.col("score").desc(), "text_len", "chunk_id").limit(k).select("chunk_id", "score", "text_len")


def vector_search(vectors: DataFrame, query: list[float], k: int = 8, key: str = "chunk_id", column: str = "vec") -> DataFrame:
    """(key, score): the k vectors most like the query, which goes into the plan as a literal. Null, zero and unlike-sized
    vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select(key, scalars.round_half_away(scalars.cosine(F.col(column), q), 6).alias("score"))
    return rows.filter(F.col("score").isNotNull()).orderBy(F.col("score").desc(), key).limit(k)


def _ranked(hits: DataFrame, key: str, order: list, source: str) -> DataFrame:
    """Hits of one list (k of them at most) with their rank from 1."""
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).select(F.col(key).alias("chunk_id"), "rank", F.lit(source).alias("source"))


def fused(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = 8, key: str = "chunk_id") -> DataFrame:
    """(chunk_id, score, sources): reciprocal rank fusion. Of equal sums vector hits come first, by rank."""
    both = _ranked(vector_hits, key, [F.col("score").desc(), key], "vector").unionByName(_ranked(keyword_hits, key, [F.col("score").desc(), "text_len", key], "keyword"))
    rows = both.groupBy("chunk_id").agg(
        F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.min(F.struct(F.when(F.col("source") == "vector", 0).otherwise(1).alias("list"), "rank")).alias("first"),
    )
    return rows.orderBy(F.col("rrf").desc(), "first").limit(k).select("chunk_id", scalars.round_half_away(F.col("rrf"), 6).alias("score"), "sources")


def search(chunks: DataFrame, embeddings: DataFrame, query: str, model: str, mode: str = "hybrid", k: int = 8, embed=documents.hash_vector, **scope) -> DataFrame:
    """Hybrid, vector or keyword search; hybrid takes OVERFETCH times k from either list."""
    own = scoped(chunks, **scope)
    if mode == "keyword":
        return keyword_search(own, query, k)
    vectors = own.select("chunk_id").join(embeddings.filter(F.col("model") == model), "chunk_id")
    if mode == "vector":
        return vector_search(vectors, embed(query), k)
    if mode != "hybrid":
        raise ValueError(f"unknown mode {mode!r}")
    return fused(vector_search(vectors, embed(query), OVERFETCH * k), keyword_search(own, query, OVERFETCH * k), k)


def pending(chunks: DataFrame, embeddings: DataFrame, model: str, accessions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Chunks without a vector of the model yet; with a limit the first so many by chunk_id, as a batch of an index build."""
    own = chunks if accessions is None else chunks.filter(F.col("accession").isin(accessions))
    rows = own.join(embeddings.filter(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")
    return rows if limit is None else rows.orderBy("chunk_id").limit(limit)


def embedded(chunks: DataFrame, model: str, size: int = 64, embed=None) -> DataFrame:
    """(chunk_id, model, dim, vec): vectors of chunks, in Arrow batches; embed: a Column function of the text, hash vectors
    without one. A vector of another size is an error."""
    vec = (embed or documents.columns()["hash_embed"])(F.col("text")).cast("array<float>")
    rows = chunks.select("chunk_id", F.lit(model).alias("model"), F.lit(size).alias("dim"), vec.alias("vec"))
    wrong = F.raise_error(F.format_string(f"{model}: a vector of %d values, not {size}", F.size("vec"))).cast("array<float>")
    return rows.withColumn("vec", F.when(F.col("vec").isNotNull() & (F.size("vec") != size), wrong).otherwise(F.col("vec")))


def index_stats(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(model, n_vectors, dim): vectors of each model; the row without a model counts the chunks."""
    per = embeddings.groupBy("model").agg(F.count(F.lit(1)).alias("n_vectors"), F.min("dim").cast("int").alias("dim"))
    return per.unionByName(chunks.agg(F.count(F.lit(1)).alias("n_vectors")).select(F.lit(None).cast("string").alias("model"), "n_vectors", F.lit(None).cast("int").alias("dim")))


BLOCK_ROWS = 4096


def _blocks(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(ids, matrix): the vectors scaled to length one, a block of rows at a time. Null and zero vectors are left out."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in range(0, batch.num_rows, BLOCK_ROWS):
                ids, rows = (c.to_pylist() for c in batch.slice(b, BLOCK_ROWS).columns)
                sizes = {len(r) for r in rows if r is not None}
                for size in sizes:
                    kept = [(i, r) for i, r in zip(ids, rows) if r is not None and len(r) == size]
                    m = np.array([r for _, r in kept], np.float64).reshape(len(kept), size)
                    norm = np.sqrt((m * m).sum(axis=1))
                    ok = norm > 0
                    m = m[ok] / norm[ok, None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([np.array([i for (i, _), o in zip(kept, ok) if o], np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([size], pa.int32())],
                        names=["ids", "matrix", "size"],
                    )

    return vectors.select(key, column).mapInArrow(pack, "ids binary, matrix binary, size int")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): for each query vector its k nearest others by cosine, exactly.

    Both sides are cut into blocks; every block of queries is held against every block of vectors by one matrix product,
    and only k rows per query leave it.
    """
    q, v = _blocks(queries, key, column), _blocks(vectors, key, column)

    def multiply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for qi, qm, size, vi, vm in zip(*(c.to_pylist() for c in batch.columns)):
                qi, vi = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                s = np.frombuffer(qm).reshape(-1, size) @ np.frombuffer(vm).reshape(-1, size).T
                s = np.floor(np.abs(s) * 1e6 + 0.5) / 1e6 * np.sign(s)
                s[qi[:, None] == vi[None, :]] = -np.inf
                n = min(k, len(vi))
                at = np.lexsort((np.broadcast_to(vi, s.shape), -s), axis=1)[:, :n]
                rows = np.repeat(np.arange(len(qi)), n)
                top = s[rows, at.ravel()]
                keep = np.isfinite(top)
                yield pa.RecordBatch.from_arrays([pa.array(qi[rows][keep]), pa.array(vi[at.ravel()][keep]), pa.array(top[keep])], names=["query_id", key, "score"])

    # blocks, not rows, are crossed: the query set's blocks against all blocks
    pairs = written(q, "query-blocks").toDF("qi", "qm", "size").crossJoin(written(v, "vector-blocks").toDF("vi", "vm", "vsize"))
    found = pairs.filter("size = vsize").select("qi", "qm", "size", "vi", "vm").mapInArrow(multiply, f"query_id long, {key} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
