"""Packing tokenized documents into training sequences, balanced by attention cost.

A document's ids (with an end id) are cut into pieces: full sequences and one remainder. Tokenizing is the only pass over texts; it
returns a row a piece with the checksum of its ids, so ids are never shuffled. Pieces are then dealt evenly into groups of bounded
size, and in each group pieces in descending length go to the sequence of lowest cost so far (linear plus quadratic in the piece's
length, as attention within a document costs) that has room for them; a new sequence is opened where none has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from annolytics.llm import bpe, textnum
from annolytics.llm.tables import small_batches, written

END_ID = 1
#: Pieces packed together in one task.
GROUP_PIECES = 8192


def pieces(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, salt: the pieces of each document, a null text counting as empty."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = 0
        for frame in frames:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            for doc_id, ids in zip(frame["doc_id"].tolist(), bpe.encoder(tokenizer).encode(texts), strict=True):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, salt))
                    salt += 1
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    small_batches(docs.sparkSession)
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a lambda, as the encoders to keep are those of the worker
    return asked.mapInPandas(lambda frames: textnum.tidy(cut, bpe._ENCODERS)(frames), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def assign(lengths: np.ndarray, *, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sequence and offset of each piece, and the cost of each sequence. Pieces are taken in descending length, ties in order."""
    order = np.argsort(-lengths, kind="stable")
    small = lengths[lengths < capacity]
    n = int((lengths == capacity).sum()) + -(-int(small.sum()) // capacity)
    room = np.full(len(lengths) + n + 1, 0, dtype=np.int64)
    room[:n] = capacity
    cost = np.zeros(len(room))
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in order:
        size = lengths[i]
        costs = np.where(room[:n] >= size, cost[:n], np.inf)
        at = int(costs.argmin()) if n else 0
        if not n or costs[at] == np.inf:
            at, n = n, n + 1
            room[at] = capacity
        sequence[i], offset[i] = at, capacity - room[at]
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size
    return sequence, offset, cost[:n]


def packed(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, group_pieces: int = GROUP_PIECES, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost (of the piece).

    An empty or null text is its end id alone. Repeated rows are packed each for itself. Every sequence starts at offset 0 and has no
    gap; those not full are padded at their end. An empty table gives no piece. Other columns of docs are not carried.
    """
    cut = written(pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(groups)).cast("long"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32", "salt"], kind="stable", ignore_index=True)
        sequence, offset, _ = assign(frame["length"].to_numpy(), capacity=capacity, linear=linear, quadratic=quadratic)
        frame["sequence_id"], frame["offset"] = frame["group"] * (1 << 32) + sequence, offset
        frame["cost"] = linear * frame["length"] + quadratic * frame["length"] ** 2
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame.drop(columns=["group", "salt"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
    return dealt.groupBy("group").applyInPandas(pack, schema)
