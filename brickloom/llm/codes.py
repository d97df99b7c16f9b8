"""Vector codes: every part of a vector as the number of its nearest codebook entry, in whole numbers throughout.

Parts and entries are padded with zeros to a power of two and go through a Walsh-Hadamard transform, which multiplies squared
distances by that power. Coefficients are then added up in sequency order (few sign changes first, where most of the difference of
smooth vectors lies); an entry whose sum has passed the whole distance of a promising one is out before the rest is looked at.
Tasks send one sum per codebook component; the driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickloom.llm.common import stored

_LIMB = 40  # bits of the digits in which tasks send sums
_LONG = 1 << 63


@dataclass(frozen=True)
class CodeParams:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    rows: int = 4096  # vectors that a task compares at once


def sequency(width: int) -> np.ndarray:
    """Natural Hadamard index of every sequency: the Gray code with its bits reversed."""
    s = np.arange(width)
    gray, out = s ^ (s >> 1), np.zeros(width, np.int64)
    for bit in range(width.bit_length() - 1):
        out = out << 1 | (gray >> bit) & 1
    return out


def walsh(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, padded with zeros to a power of two, in sequency order."""
    width = 1 << max(0, x.shape[-1] - 1).bit_length()
    y = np.zeros((*x.shape[:-1], width), x.dtype)
    y[..., : x.shape[-1]] = x
    half = 1
    while half < width:
        z = y.reshape(*x.shape[:-1], width // (2 * half), 2, half)
        y = np.stack([z[..., 0, :] + z[..., 1, :], z[..., 0, :] - z[..., 1, :]], axis=-2).reshape(y.shape)
        half *= 2
    return y[..., sequency(width)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of transformed ``x`` the nearest of the transformed entries (ties to the lower) and the squared distance."""
    n, width = x.shape
    far = (x[:, :1] - entries[:, 0]) ** 2
    guess = far.argmin(axis=1)
    limit = ((x - entries[guess]) ** 2).sum(axis=1)
    row, col = np.nonzero(far <= limit[:, None])
    sums, done, step = far[row, col], 1, 1
    while done < width:
        sums = sums + ((x[row, done : done + step] - entries[col, done : done + step]) ** 2).sum(axis=1)
        stay = sums <= limit[row]
        row, col, sums = row[stay], col[stay], sums[stay]
        done, step = done + step, 2 * step
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(sums, starts)
    ties = np.flatnonzero(sums == least[row])
    chosen = ties[np.searchsorted(row[ties], np.arange(n))]
    return col[chosen], least // width


def whole_numbers(vectors: list, width: int, p: CodeParams) -> np.ndarray:
    """floor(scale * x), cut into parts; 64-bit where every distance fits, else Python's own integers."""
    x = np.zeros((len(vectors), p.parts * width))
    for row, v in zip(x, vectors, strict=True):
        row[: len(v)] = v
    x = x.reshape(len(vectors), p.parts, width)
    if abs(x).max(initial=0) < 1e300:
        x = np.floor(x * p.scale)
        if fits(int(abs(x).max(initial=0)), width):
            return x.astype(np.int64)
        return np.frompyfunc(int, 1, 1)(x)
    return np.frompyfunc(lambda v: int(v) * p.scale if abs(v) > 2**60 else int(np.floor(v * p.scale)), 1, 1)(x)


def fits(greatest: int, width: int) -> bool:
    """True if no sum of squared transformed differences passes 62 bits."""
    w = 1 << max(0, width - 1).bit_length()
    return 4 * w**3 * max(greatest, 1) ** 2 < 1 << 62


class Book:
    """Codebooks of all parts, and their transforms."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # parts x entries x width, whole numbers
        self.small = fits(int(abs(entries).max(initial=0)), entries.shape[-1])
        self.transformed = walsh(entries.astype(np.int64) if self.small else entries)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every part of every vector, and the vectors' summed squared distances."""
        book = self.transformed if self.small and x.dtype != object else self.transformed.astype(object)
        x = walsh(x if book.dtype != object else x.astype(object))
        found = [nearest(x[:, j], book[j]) for j in range(x.shape[1])]
        return np.stack([c for c, _ in found], axis=1), sum(d.astype(object) for _, d in found)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _blocks(batch, width: int, p: CodeParams):
    for at in range(0, batch.num_rows, p.rows):
        part = batch.slice(at, p.rows)
        yield part, whole_numbers(part["embedding"].to_pylist(), width, p)


def _sums(book: Book, width: int, p: CodeParams):
    """Per task the sums of every entry's parts: one row per component (-1: the number of parts) and digit."""

    def run(batches):
        total: dict = defaultdict(int)
        for batch in batches:
            for _, x in _blocks(batch, width, p):
                codes, _ = book.assign(x)
                for j in range(p.parts):
                    for e in np.unique(codes[:, j]).tolist():
                        own = x[codes[:, j] == e, j]
                        total[j, e, -1] += len(own)
                        for i, s in enumerate(own.sum(axis=0).tolist()):
                            total[j, e, i] += s
        rows = []
        for (j, e, i), s in total.items():
            digit, rest = 0, abs(s)
            while rest:
                rows.append((j, e, i, digit, (rest & (1 << _LIMB) - 1) * (1 if s > 0 else -1)))
                rest, digit = rest >> _LIMB, digit + 1
        names = ["part", "entry", "i", "digit", "value"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(c, pa.int64()) for c in names]))

    return run


def train(kept: DataFrame, width: int, p: CodeParams) -> Book:
    """Codebooks after all rounds, from the vectors of the smallest ids on."""
    seeds: dict = {}
    named, last = kept.filter("vec_id IS NOT NULL").select("vec_id", "embedding"), None
    while len(seeds) < p.entries:
        after = named if last is None else named.filter(F.col("vec_id") > last)
        rows = after.orderBy("vec_id", "embedding").limit(p.entries).collect()
        for r in rows:
            seeds.setdefault(r.vec_id, r.embedding)
        if len(rows) < p.entries:
            break
        last = rows[-1].vec_id
    first = [seeds[i] for i in sorted(seeds)[: p.entries]] or [[]]
    entries = whole_numbers(first, width, p).transpose(1, 0, 2)
    schema = "part long, entry long, i long, digit long, value long"
    for _ in range(p.rounds):
        rows = kept.select("embedding").mapInArrow(_sums(Book(entries), width, p), schema)
        total: dict = defaultdict(int)
        for r in rows.groupBy("part", "entry", "i", "digit").agg(F.sum("value").alias("value")).collect():
            total[r.part, r.entry, r.i] += r.value << (_LIMB * r.digit)
        entries = entries.astype(object)
        for (j, e, i), n in list(total.items()):
            if i == -1:
                entries[j, e] = [total.get((j, e, k), 0) // n for k in range(width)]
    return Book(entries)


def _encode(book: Book, width: int, p: CodeParams):
    def run(batches):
        for batch in batches:
            for part, x in _blocks(batch, width, p):
                codes, errors = book.assign(x)
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                errors = [e if e < _LONG else None for e in errors.tolist()]
                names = ["vec_id", "label", "code", "error"]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], pa.array(text, pa.string()), pa.array(errors, pa.int64())], names=names)

    return run


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """Add the error summed over rows of the same label. Labels with a thousandth of all rows, a thousand at most, are broadcast; the rest join."""
    totals = stored(
        coded.groupBy("label").agg(
            F.count(F.lit(1)).alias("rows"),
            F.when(F.bool_and(F.col("error").isNotNull()), F.expr("try_cast(sum(CAST(error AS DECIMAL(38, 0))) AS BIGINT)")).alias("label_error"),
        )
    )
    rows = totals.agg(F.sum("rows")).first()[0] or 0
    names = totals.select(F.col("label").alias("of"), "label_error", "rows")
    hot = F.col("rows") * 1000 >= rows
    frequent = names.filter(hot).select("of", "label_error", F.lit(True).alias("is_hot"))
    marked = coded.join(F.broadcast(frequent), F.col("label").eqNullSafe(F.col("of")), "left")
    rare = names.filter(~hot).select("of", "label_error")
    cold = marked.filter("is_hot IS NULL").drop("of", "label_error", "is_hot")
    cold = cold.join(rare.hint("merge"), F.col("label").eqNullSafe(F.col("of")))
    columns = ["vec_id", "code", "error", "label_error"]
    return marked.filter("is_hot").select(*columns).union(cold.select(*columns))


def compress(vectors: DataFrame, p: CodeParams = CodeParams()) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold a null or non-finite component are left out. Shorter vectors than the longest, and lengths that the
    parts do not divide, are filled up with zeros. Rows without vec_id are coded and counted but start no entry; of rows that repeat a
    vec_id the least vector starts its entry, and with fewer ids there are fewer entries. Null labels are one label. An error or
    a sum of errors beyond 64 bits is null. Texts play no part; further columns are not used; an empty table gives no row.
    """
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    kept = vectors.select("vec_id", "embedding", "label").filter(sound)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // p.parts))
    book = train(kept, width, p)
    label = vectors.schema["label"].dataType.simpleString()
    coded = stored(kept.mapInArrow(_encode(book, width, p), f"vec_id long, label {label}, code string, error long"))
    return _with_label_errors(coded).withColumn("codebooks_sha256", F.lit(book.digest()))
