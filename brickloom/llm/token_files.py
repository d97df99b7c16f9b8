"""Token ids of a corpus as compressed files, and reading them back.

Documents are ranged over the cluster by doc_id; every task encodes its range into frames (rans.py) that Spark writes, in
ascending order, as rows of Parquet files in the shared folder, so a lost executor's range is simply written again. A frame
ends with the document that passes FRAME ids: a longer document makes a longer frame of more blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickloom.llm import rans
from brickloom.llm.common import batched, partitions, stored
from brickloom.llm.tokens import token_ids

FRAME = 1 << 21
FRAMES = (
    "part int, frame int, n_docs long, n_ids long, doc_ids array<long>, lengths array<long>, table binary, "
    "blocks array<struct<n: long, crc: long, words: binary, places: array<long>, states: binary>>"
)


def _frame(part: int, number: int, docs: list, ids: list[bytes]) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(ids), "<u4")
    table, blocks = rans.encode(flat.astype(np.int64))
    row = {
        "part": part, "frame": number, "n_docs": len(docs), "n_ids": len(flat), "doc_ids": docs, "lengths": [len(x) // 4 for x in ids],
        "table": table,
        "blocks": [{"n": b.n, "crc": b.crc, "words": b.words, "places": b.places, "states": b.states} for b in blocks],
    }
    block = pa.struct([("n", pa.int64()), ("crc", pa.int64()), ("words", pa.binary()), ("places", pa.list_(pa.int64())), ("states", pa.binary())])
    schema = pa.schema([
        ("part", pa.int32()), ("frame", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("table", pa.binary()), ("blocks", pa.list_(block)),
    ])
    return pa.RecordBatch.from_pylist([row], schema=schema)


def encoded(documents: DataFrame, vocabulary: str) -> DataFrame:
    """documents(doc_id, text) -> frames in ascending order of doc_id, and of the text's hash for equal ones; nulls first."""
    order = [F.col("doc_id").asc(), F.xxhash64("text").asc()]
    ranged = documents.select("doc_id", "text").repartitionByRange(partitions(documents.sparkSession), *order)
    ranged = ranged.sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        docs, ids, n, number, part = [], [], 0, 0, 0
        for batch in batches:
            part = batch["part"][0].as_py() if len(batch) else part
            rows = zip(batch["text"].to_pylist(), batch["doc_id"].to_pylist(), strict=True)
            for group in batched(rows, 500):
                for (_, doc), own in zip(group, token_ids(vocabulary, [t for t, _ in group]), strict=True):
                    docs.append(doc)
                    ids.append(own)
                    n += len(own) // 4
                    if n >= FRAME:
                        yield _frame(part, number, docs, ids)
                        docs, ids, n, number = [], [], 0, number + 1
        if docs:
            yield _frame(part, number, docs, ids)

    return ranged.mapInArrow(run, FRAMES)


def decoded(frames: DataFrame) -> DataFrame:
    """frames -> doc_id, start, n_tokens, ids_crc32: every document as the files have it."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch[c][i] for c in batch.schema.names}
                blocks = [
                    rans.Block(b["n"].as_py(), b["crc"].as_py(), b["words"].as_py(), b["places"].as_py(), b["states"].as_py())
                    for b in row["blocks"]
                ]
                data = memoryview(rans.decode(row["table"].as_py(), blocks).astype("<u4").tobytes())
                lengths = np.asarray(row["lengths"].values)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(ends - lengths + row["before"].as_py()), pa.array(lengths), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # one row per frame holds the sums: few rows, whatever the corpus; the frames themselves only meet their own row
    sums = frames.groupBy("part").agg(F.sum("n_ids").alias("own"))
    parts = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("earlier"))
    inside = frames.select("part", "frame", "n_ids").withColumn("upto", F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame")))
    before = inside.join(parts, "part").select("part", "frame", (F.col("earlier") + F.col("upto") - F.col("n_ids")).alias("before"))
    rows = frames.join(F.broadcast(before), ["part", "frame"]).select("doc_ids", "lengths", "table", "blocks", "before")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Encode a corpus into files in the shared folder and read every document back from them.

    A null or empty text is the end id alone. Null ids come first; rows of equal doc_id follow the hash of their text, and
    repeated rows stay as many as they are. Further columns are not used. An empty table gives no file row and no result.
    """
    return decoded(stored(encoded(documents, vocabulary)))
