"""Exact top-k search by inner product: vectors in buckets of alike length, pruned by local cosine thresholds, verified exactly.

Vectors are scaled to integers, sorted into buckets by length, and packed in chunks of bounded size. Queries are packed in blocks.
A first pass compares each block with the chunk of longest vectors and gives every query a lower bound of its k-th score. A block
meets a chunk only if some query's bound divided by both lengths, its local cosine threshold in that chunk, is at most 1. In the
chunk the threshold decides what prunes candidates: coordinates where it is high (a vector whose cosine with the query reaches it
must have its strongest coordinates in a narrow range), lengths where it is low. What is left is verified by integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from annolytics.llm.tables import written

#: Above this local cosine threshold coordinates prune better than lengths.
BY_COORDINATES = 0.6
FOCUS = 3



#: Vectors in a chunk, and queries in a block.
CHUNK, BLOCK = 8192, 1024
#: Lengths of a bucket differ by at most this factor.
BUCKET_RATIO = 1.1


def scaled(vectors: DataFrame, *, scale: int = 1024) -> DataFrame:
    """vec_id, dim, length, bucket, v (binary of doubles, each floor(scale * x)); rows that take no part are left out."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for vec_id, e in zip(f["vec_id"].tolist(), f["embedding"], strict=True):
                x = np.asarray(e, dtype=float)  # a null component becomes NaN
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * x)
                    v = np.where(np.isfinite(v), v, np.sign(v) * 2.0**62)
                    length = float(np.sqrt((v * v).sum()))
                bucket = int(np.floor(np.log(length) / np.log(BUCKET_RATIO))) if 0 < length < np.inf else (10**6 if length else -(10**6))
                rows.append((vec_id, len(v), length, bucket, v.tobytes()))
            yield pd.DataFrame(rows, columns=["vec_id", "dim", "length", "bucket", "v"])

    asked = vectors.where("vec_id is not null and embedding is not null")
    asked = asked.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return asked.mapInPandas(make, "vec_id long, dim int, length double, bucket int, v binary")


def chunks(rows: DataFrame, *, size: int, once: bool) -> DataFrame:
    """dim, chunk, longest, ids, lengths, vs: rows (dim, bucket, ...) packed in descending length; once: one row an id."""
    counts = rows.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("parts"))
    dealt = rows.join(F.broadcast(counts), ["dim", "bucket"])  # a row for each length class, of which doubles have 15,000 at most
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["length", "vec_id", "v"], ascending=[False, True, True], ignore_index=True)
        if once:
            f = f.drop_duplicates("vec_id", ignore_index=True)
        key = f"{f['bucket'].iloc[0]}:{f['part'].iloc[0]}"
        ids, lengths = f["vec_id"].to_numpy(dtype=np.int64), f["length"].to_numpy(dtype=float)
        return pd.DataFrame({"dim": [int(f["dim"].iloc[0])], "chunk": [key], "longest": [lengths[0]], "ids": [ids.tobytes()], "lengths": [lengths.tobytes()], "vs": [b"".join(f["v"])]})

    return dealt.groupBy("dim", "bucket", "part").applyInPandas(pack, "dim int, chunk string, longest double, ids binary, lengths binary, vs binary")


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows, exact: in doubles where no sum can reach 2**53, else in whole numbers held within a long."""
    if exact:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    out = whole(q) @ whole(x).T if q.size and x.size else np.zeros((len(q), len(x)), dtype=object)
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]  # unlike a minus, ~ has no overflow


def searched(qid: np.ndarray, q: np.ndarray, qlen: np.ndarray, bound: np.ndarray, ids: np.ndarray, x: np.ndarray, xlen: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score): for each query its best k of a chunk that reach its bound (nan: none known)."""
    out = []
    if not len(ids) or not len(qid):
        return out
    safe = float(qlen.max()) * float(xlen[0]) < 2.0**53
    known = np.where(np.isnan(bound), -np.inf, bound)
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(qlen > 0, known / qlen, -np.inf)  # least length of a vector that can reach the bound
        local = needed / xlen[0]  # the local cosine threshold
    slack = 1 + 1e-9
    prune = (local > BY_COORDINATES) & (local <= slack)
    unit = x / np.where(xlen > 0, xlen, 1)[:, None] if prune.any() else None
    for i in np.flatnonzero(prune).tolist():
        many = int(np.searchsorted(-xlen, -needed[i] / slack, side="right"))
        t, keep = min(1.0, local[i]) / slack, np.ones(many, dtype=bool)
        own = q[i] / qlen[i]
        for f in np.argsort(-np.abs(own))[:FOCUS].tolist():
            spread = np.sqrt(max(0.0, (1 - own[f] ** 2) * (1 - t**2))) + 1e-9
            keep &= (unit[:many, f] >= own[f] * t - spread) if own[f] >= 0 else (unit[:many, f] <= own[f] * t + spread)
        at = np.flatnonzero(keep & (ids[:many] != qid[i]))
        s = products(q[i : i + 1], x[at], safe)[0]
        out += [(int(qid[i]), int(ids[at[j]]), int(s[j])) for j in best(ids[at], s, k).tolist()]
    by_length = np.flatnonzero((local <= BY_COORDINATES) | np.isnan(local))
    if len(by_length):
        low = needed[by_length].min()
        many = int(np.searchsorted(-xlen, -low / slack, side="right")) if low > 0 else len(xlen)
        scores = products(q[by_length], x[:many], safe)
        for row, i in enumerate(by_length.tolist()):
            at = np.flatnonzero(ids[:many] != qid[i])
            s = scores[row][at]
            out += [(int(qid[i]), int(ids[at[j]]), int(s[j])) for j in best(ids[at], s, k).tolist()]
    return out


def search(joined: DataFrame, k: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                arrays = [np.frombuffer(b, dtype=t) for b, t in ((r.q_ids, np.int64), (r.q_lengths, float), (r.bounds, float), (r.ids, np.int64), (r.lengths, float))]
                qid, qlen, bound, ids, xlen = arrays
                q, x = np.frombuffer(r.q_vs, dtype=float).reshape(len(qid), r.dim), np.frombuffer(r.vs, dtype=float).reshape(len(ids), r.dim)
                yield pd.DataFrame(searched(qid, q, qlen, bound, ids, x, xlen, k), columns=["query_id", "vec_id", "score"]).astype("int64")

    columns = ("dim", "q_ids", "q_lengths", "q_vs", "bounds", "ids", "lengths", "vs")
    return joined.select(*columns).mapInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query, ties to smaller vec_id.

    Queries are rows whose vec_id is divisible by `every`; candidates all rows of another vec_id with as many components. Null
    vectors, null ids, and vectors with null or non-finite components take no part; empty vectors meet empty vectors, at score 0.
    Rows that repeat a vec_id are candidates each for itself; as a query, the longest of them counts. Scores beyond a long are held at
    its ends. Fewer than k candidates give fewer rows, an empty table none.
    """
    rows = written(scaled(vectors, scale=scale), "vectors")
    parts = written(chunks(rows, size=chunk, once=False), "chunks")
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("bucket", F.lit(0))
    blocks = chunks(asked, size=block, once=True).select("dim", F.col("chunk").alias("block"), F.col("ids").alias("q_ids"), F.col("lengths").alias("q_lengths"), F.col("vs").alias("q_vs"))
    blocks = written(blocks, "queries")
    # a first bound from the chunk of longest vectors
    head = parts.groupBy("dim").agg(F.max_by("chunk", F.struct("longest", "chunk")).alias("chunk"))
    none = blocks.withColumn("bounds", F.lit(None).cast("binary"))

    def unknown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["bounds"] = [np.full(len(b) // 8, np.nan).tobytes() for b in f["q_ids"]]
            yield f

    none = none.mapInPandas(unknown, none.schema)
    first = search(none.join(parts.join(head, ["dim", "chunk"]), "dim"), k)
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    bounds = bounds.where("bound is not null").join(asked.select(F.col("vec_id").alias("query_id"), "dim").distinct(), "query_id")
    counts = asked.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"))
    bounds = bounds.join(F.broadcast(counts), "dim").withColumn("block", F.concat(F.lit("0:"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("string")))
    bounds = bounds.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "bound")).alias("known"))  # at most a block's queries

    def filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made, least = [], []
            for r in f.itertuples(index=False):
                known = {b["query_id"]: b["bound"] for b in r.known} if r.known is not None else {}
                ids, lengths = np.frombuffer(r.q_ids, dtype=np.int64), np.frombuffer(r.q_lengths, dtype=float)
                bound = np.array([known.get(i, np.nan) for i in ids.tolist()], dtype=float)
                made.append(bound.tobytes())
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where((lengths > 0) & ~np.isnan(bound), bound / lengths, -np.inf)
                least.append(float(need.min()) if len(need) else np.inf)
            f = f.drop(columns=["known"])
            f["bounds"], f["least"] = made, least
            yield f

    schema = "dim int, block string, q_ids binary, q_lengths binary, q_vs binary, bounds binary, least double"
    blocks = written(blocks.join(bounds, ["dim", "block"], "left").select("dim", "block", "q_ids", "q_lengths", "q_vs", "known").mapInPandas(filled, schema), "bounded")
    # which blocks meet which chunks, from a few numbers of each
    near = blocks.select("dim", "block", "least").join(parts.select("dim", "chunk", "longest"), "dim").where(F.col("least") <= F.col("longest") * (1 + 1e-9))
    met = near.select("dim", "block", "chunk").repartition(F.col("block"), F.col("chunk")).join(parts, ["dim", "chunk"]).join(blocks, ["dim", "block"])
    found = search(met, k)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
