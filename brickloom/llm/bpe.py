"""Byte-level BPE by the ranks of a vocabulary file, with recursive queries of an in-process DuckDB in every task.

A task cuts its texts into words by the pattern, and only the different words it has not met go to DuckDB: rows of token
positions join the merge table, every round contracts each word's pair of least rank, the leftmost of equals, and a word
leaves when no pair is left. Decoding is the ordered aggregation of the tokens' bytes. Texts are then put together from their
words' ids and decoded bytes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brickloom.llm.common import batched, pieces

LONG = 128  # bytes from which a word goes through the query that contracts many pairs in a round
_AT = 0xFFFFFFFF  # a key is word << 32 | place of a byte, which no text's length passes
_OPEN: dict[str, Memory] = {}

# k: key of the token's first byte, e: key of the byte after it; of a key the latest row counts, and id -1 has been absorbed.
# ``code`` of a merge is rank << 44 | bytes of the new token, so that with the place in between the least one is the leftmost
# pair of least rank. Only the rows of words that still change are handed to the next round.
_ENCODE = f"""
WITH RECURSIVE t(k, e, id) USING KEY (k) AS (
  SELECT k, k + 1, id FROM seed
  UNION ALL (
    WITH pick AS (
      SELECT w, (w << 32) | ((b >> 12) & {_AT}) AS k, (b >> 44)::INT AS rank, b & 4095 AS n FROM (
        SELECT min(m.code | ((a.k & {_AT}) << 12)) AS b, a.k >> 32 AS w
        FROM t AS a JOIN t AS b ON a.e = b.k JOIN merges AS m ON m.pair = (a.id::BIGINT * 1048576 + b.id) GROUP BY ALL))
    SELECT t.k, CASE WHEN t.k = p.k THEN p.k + p.n ELSE t.e END,
      CASE WHEN t.k = p.k THEN p.rank WHEN t.k > p.k AND t.k < p.k + p.n THEN -1 ELSE t.id END
    FROM t JOIN pick AS p ON (t.k >> 32) = p.w WHERE t.id >= 0))
SELECT f.k >> 32 AS w, list(f.id ORDER BY f.k) AS ids, string_agg(v.hex, '' ORDER BY f.k) AS bytes
FROM t AS f JOIN vocab AS v ON v.id = f.id GROUP BY ALL
"""


# The same for long words, many pairs a round. All pairs of the word's least rank go at once, the leftmost first where they
# overlap, if no merge of the new token has a lower rank than it (``calm``); then taking them one by one would find them in
# this order. If not, only the leftmost goes.
_ENCODE_LONG = """
WITH RECURSIVE t(k, e, id) USING KEY (k) AS (
  SELECT k, k + 1, id FROM seed
  UNION ALL (
    WITH live AS (SELECT k, e, id, k >> 32 AS w FROM t WHERE id >= 0),
    pairs AS (
      SELECT a.w AS w, a.k AS k, a.e AS mid, b.e AS e, m.rank AS rank
      FROM live AS a JOIN live AS b ON a.e = b.k AND a.w = b.w JOIN merges AS m ON m.pair = (a.id::BIGINT * 1048576 + b.id)),
    least AS (SELECT w, min(rank) AS rank FROM pairs GROUP BY w),
    ties AS (
      SELECT p.*, v.calm AS calm, row_number() OVER (PARTITION BY p.w ORDER BY p.k) AS nth,
        CASE WHEN lag(p.mid) OVER (PARTITION BY p.w ORDER BY p.k) = p.k THEN 0 ELSE 1 END AS opens
      FROM pairs AS p JOIN least AS l ON p.w = l.w AND p.rank = l.rank JOIN vocab AS v ON v.id = p.rank),
    chains AS (SELECT *, sum(opens) OVER (PARTITION BY w ORDER BY k) AS chain FROM ties),
    pick AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, chain ORDER BY k) AS turn FROM chains)
      WHERE CASE WHEN calm THEN turn % 2 = 1 ELSE nth = 1 END)
    SELECT l.k, CASE WHEN p.k IS NULL THEN l.e ELSE p.e END,
      CASE WHEN q.mid IS NOT NULL THEN -1 WHEN p.k IS NOT NULL THEN p.rank ELSE l.id END
    FROM live AS l JOIN (SELECT DISTINCT w FROM pick) AS a ON a.w = l.w
    LEFT JOIN pick AS p ON p.k = l.k LEFT JOIN pick AS q ON q.mid = l.k))
SELECT f.k >> 32 AS w, list(f.id ORDER BY f.k) AS ids, string_agg(v.hex, '' ORDER BY f.k) AS bytes
FROM t AS f JOIN vocab AS v ON v.id = f.id GROUP BY ALL
"""


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def merge_table(rank: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, rank) for every way in which two tokens make up a third."""
    rows = []
    for token, r in rank.items():
        for i in range(1, len(token)):
            a, b = rank.get(token[:i]), rank.get(token[i:])
            if a is not None and b is not None:
                rows.append((a, b, r))
    return rows


class Encoder:
    """Words to (ids, decoded bytes) by recursive queries over a database in this process's memory."""

    def __init__(self, path: str):
        import duckdb

        self.rank = ranks(path)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        merges = np.array(merge_table(self.rank), np.int64).reshape(-1, 3)
        tokens = sorted(self.rank.items(), key=lambda x: x[1])
        ids = np.array([r for _, r in tokens], np.int32)
        size = np.zeros(int(ids.max()) + 1, np.int64)
        size[ids] = [len(t) for t, _ in tokens]
        if size.max() > 4095 or len(size) > 1 << 19:
            raise ValueError("a vocabulary of at most 2 ** 19 ids and tokens of at most 4,095 bytes is needed")
        new = merges[:, 2]
        self._table("merges", pair=merges[:, 0] << 20 | merges[:, 1], rank=new.astype(np.int32), code=new << 44 | size[new])
        self._table("vocab", id=ids, hex=[t.hex() for t, _ in tokens], calm=self._calm(merges)[ids])

    def _calm(self, merges: np.ndarray) -> np.ndarray:
        """By id: whether no merge that the token takes part in has a lower rank than the token itself."""
        calm = np.ones(max(self.rank.values()) + 1, bool)
        for part in merges[:, 0], merges[:, 1]:
            calm[part[merges[:, 2] < part]] = False
        return calm

    def _table(self, name: str, **columns) -> None:
        rows = pa.table({k: pa.array(v) for k, v in columns.items()})
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded bytes) of every word."""
        out: list = [None] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        whole = np.array([self.rank.get(w, -1) for w in words], np.int32)
        for i in np.flatnonzero(whole >= 0).tolist():
            out[i] = (whole[i].astype("<u4").tobytes(), words[i])
        for query, todo in ((_ENCODE, (whole < 0) & (size < LONG)), (_ENCODE_LONG, (whole < 0) & (size >= LONG))):
            todo = np.flatnonzero(todo)
            if not len(todo):
                continue
            data = np.frombuffer(b"".join([words[i] for i in todo.tolist()]), np.uint8)
            n = size[todo]
            w = np.repeat(todo.astype(np.int64), n)
            at = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
            self.db.register("seed", pa.table({"k": pa.array(w << 32 | at), "id": pa.array(self.byte[data])}))
            for i, ids, hexed in self.db.execute(query).fetchall():
                out[i] = (np.array(ids, "<u4").tobytes(), bytes.fromhex(hexed))
            self.db.unregister("seed")
        return out


class Memory:
    """Encodings of pieces, and of the words they are made of, that this worker process has met."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.find, self.core, self.words = regex.compile(pattern).findall, Encoder(path), {}
        # ids and decoded bytes of the pieces that follow a blank, which goes with them
        self.ids: dict[str, bytes] = {}
        self.back: dict[str, bytes] = {}

    def encode(self, strings: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of every string; the new words of all of them go to the database together."""
        if len(self.words) > 300_000:
            self.words.clear()
        known, cut = self.words, list(map(self.find, strings))
        new = list({w for ws in cut for w in ws if w not in known})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            known.update(zip(part, self.core.words([w.encode() for w in part]), strict=True))
        out = []
        for ws in cut:
            if len(ws) == 1:
                out.append(known[ws[0]])
            else:
                found = [known[w] for w in ws]
                out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])))
        return out

    def texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of every text."""
        cut = [pieces(t) for t in texts]
        heads, rest = [c[0] if c else "" for c in cut], [c[1:] for c in cut]
        need = set().union(*rest)
        new = need - self.ids.keys()
        if len(self.ids) + len(new) > 300_000:
            self.ids.clear()
            self.back.clear()
            new = need
        order = list(new)
        found = self.encode(heads + [" " + p for p in order])
        for p, (ids, back) in zip(order, found[len(heads) :], strict=True):
            self.ids[p], self.back[p] = ids, back
        of, back_of = self.ids.__getitem__, self.back.__getitem__
        return [(i + b"".join(map(of, r)), b + b"".join(map(back_of, r))) for (i, b), r in zip(found, rest, strict=False)]


def round_trips(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256; encoded by word and decoded from the ids.

    A null or empty text has no ids and decodes to nothing. Repeated rows give repeated results, a null doc_id stays null,
    further columns are not used, and an empty table gives no row. Nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch["doc_id"].to_pylist(), strict=True)
            for group in batched(rows, 2000):
                if path not in _OPEN:
                    _OPEN[path] = Memory(path, pattern)
                found = _OPEN[path].texts([t or "" for t, _ in group])
                ids, back = ([hashlib.sha256(f[k]).hexdigest() for f in found] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for _, d in group], pa.int64()), pa.array([len(f[0]) // 4 for f in found], pa.int64()), pa.array(ids), pa.array(back)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
