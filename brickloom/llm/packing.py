"""Packing of documents into sequences of a fixed number of tokens, with as few sequences as bin completion finds.

The corpus is packed as one: a histogram of piece lengths (at most one row per length) is solved by bin completion, and every
piece finds its place by its rank among the pieces of its length. No text or id leaves its task, and no task holds more than
the pieces of one length and salt.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickloom.llm.common import batched, stored
from brickloom.llm.completion import complete
from brickloom.llm.tokens import token_ids

CAPACITY = 1024
SALTS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def cut(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """documents(doc_id, text) -> one row per piece of at most ``capacity`` tokens; only the first may be shorter than that."""

    def run(batches):
        n = 0
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch["doc_id"].to_pylist(), strict=True)
            for group in batched(rows, 2000):
                out = []
                for (_, doc), ids in zip(group, token_ids(vocabulary, [t for t, _ in group]), strict=True):
                    total = len(ids) // 4
                    first = total % capacity or capacity
                    at = 0
                    for piece in range(-(-total // capacity)):
                        end = at + (capacity if piece else min(first, total))
                        out.append((doc, piece, at, end - at, zlib.crc32(ids[4 * at : 4 * end]), n % SALTS))
                        at = end
                        n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def _runs(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Where the k-th piece of a length goes: runs of ranks per length, each with its first sequence and its offsets."""
    taken: dict[int, int] = {}
    rows, offsets, sequence = [], [], 0
    for fill, times in plan:
        places: dict[int, list[int]] = {}
        at = 0
        for s in fill:
            places.setdefault(s, []).append(at)
            at += s
        for s, where in places.items():
            rows.append((s, taken.get(s, 0), len(where), sequence, len(offsets)))
            offsets += where
            taken[s] = taken.get(s, 0) + times * len(where)
        sequence += times
    rows.sort()
    table = np.array(rows or [(0, 0, 1, 0, 0)], np.int64)
    return table, np.array(offsets or [0], np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32, salt) -> the same without salt, with sequence_id and offset."""
    sizes = {int(r.length): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table, offsets = _runs(complete(sizes, capacity))
    keys = table[:, 0] << 40 | table[:, 1]

    counts = pieces.groupBy("length", "salt").count()  # at most capacity * SALTS rows
    before = counts.select(
        "length", "salt",
        (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"),
    )
    ranked = pieces.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ).join(F.broadcast(before), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            run = table[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            nth = rank - run[:, 1]
            sequence = run[:, 3] + nth // run[:, 2]
            offset = offsets[run[:, 4] + nth % run[:, 2]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """documents(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed once each; pieces of equal
    length, doc_id and ids may change places, which gives the same rows. Further columns are not used. An empty table gives
    no row.
    """
    return pack(stored(cut(documents, vocabulary, capacity)), capacity)
