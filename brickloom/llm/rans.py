"""Static range asymmetric numeral coding of token ids in numpy.

A frame holds one frequency table and blocks of BLOCK ids that share it. A block deals its ids to LANES interleaved coders;
all full blocks of a frame are coded side by side. Every CHECK steps the coder's states and place are kept, so that a decoder
can begin there: all stretches between checkpoints of all blocks decode side by side, each on its own. Every block carries
the CRC-32 of its ids.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE = 20  # a table's frequencies add up to 2 ** SCALE
LANES = 256
STEPS = 1024
CHECK = 256  # steps between checkpoints
BLOCK = LANES * STEPS
# States stay between 2 ** SCALE and 2 ** (SCALE + 32), so they are exact as float64, which numpy divides much faster.
LOW = float(1 << SCALE)
WORD = float(1 << 32)


@dataclass
class Block:
    n: int  # ids in the block
    crc: int
    words: bytes  # little-endian unsigned 32-bit words in the order a decoder reads them
    places: list[int]  # word at which each checkpoint's stretch begins
    states: bytes  # LANES unsigned 64-bit states for each checkpoint


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids and their scaled frequencies, each at least 1."""
    symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more different ids than a table has room for")
    scaled = np.maximum(1, counts * total // max(1, counts.sum()))
    over = int(scaled.sum()) - total
    while over:  # take from, or give to, the most frequent ids
        order = np.argsort(-scaled, kind="stable")
        if over < 0:
            scaled[order[0]] -= over
            break
        spare = np.minimum(scaled[order] - 1, np.maximum(1, scaled[order] // 8))
        cut = np.minimum(spare, np.maximum(0, over - np.concatenate([[0], np.cumsum(spare)[:-1]])))
        scaled[order] -= cut
        over -= int(cut.sum())
    return symbols, scaled


def pack_table(symbols: np.ndarray, scaled: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([np.diff(symbols, prepend=0), scaled]).astype("<u4").tobytes(), 6)


def unpack_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _encode_side_by_side(codes: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], list[list[int]], list[np.ndarray]]:
    """codes: (blocks, steps, LANES) positions in the table -> words, checkpoint places and states per block."""
    blocks, steps, _ = codes.shape
    x = np.full((blocks, LANES), LOW)
    out: list[list[np.ndarray]] = [[] for _ in range(blocks)]
    written = np.zeros(blocks, np.int64)
    marks, states = [], []
    for s in range(steps - 1, -1, -1):
        c = codes[:, s]
        f = freq[c]
        full = x >= f * WORD
        high = np.floor(x * (1 / WORD))
        low = x - high * WORD
        per = full.sum(1)
        for b in np.flatnonzero(per).tolist():
            out[b].append(low[b][full[b]])
        written += per
        np.copyto(x, high, where=full)
        x += np.floor(x / f) * (LOW - f) + start[c]
        if s % CHECK == 0:
            marks.append(written.copy())
            states.append(x.astype(np.uint64))
    words = [np.concatenate(w[::-1]).astype(np.uint32) if w else np.empty(0, np.uint32) for w in out]
    places = [[int(written[b] - m[b]) for m in marks[::-1]] for b in range(blocks)]
    return words, places, [np.stack([s[b] for s in states[::-1]]) for b in range(blocks)]


def encode(ids: np.ndarray) -> tuple[bytes, list[Block]]:
    """A frame: its table and blocks. No ids give no block."""
    if not len(ids):
        return pack_table(np.empty(0, np.int64), np.empty(0, np.int64)), []
    symbols, scaled = frequencies(ids)
    freq = scaled.astype(np.float64)
    start = np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.float64)
    position = np.zeros(int(symbols[-1]) + 1, np.int32)
    position[symbols] = np.arange(len(symbols))
    codes = position[ids]
    common = int(np.argmax(scaled))
    done = []
    whole = len(ids) // BLOCK
    for first, n in ((0, whole * BLOCK), (whole * BLOCK, len(ids) - whole * BLOCK)):
        if not n:
            continue
        size = BLOCK if first == 0 and whole else -(-n // LANES) * LANES
        part = codes[first : first + n]
        if len(part) % size:
            part = np.concatenate([part, np.full(size - len(part) % size, common, np.int32)])
        words, places, states = _encode_side_by_side(part.reshape(-1, size // LANES, LANES), freq, start)
        for b, (w, p, s) in enumerate(zip(words, places, states, strict=True)):
            own = ids[first + b * size : first + min((b + 1) * size, n)]
            done.append(Block(len(own), zlib.crc32(own.astype("<u4").tobytes()), w.astype("<u4").tobytes(), p, s.astype("<u8").tobytes()))
    return pack_table(symbols, scaled), done


def decode(table: bytes, blocks: list[Block]) -> np.ndarray:
    """All ids of a frame; every stretch between checkpoints is decoded on its own, side by side. Checks every block's sum."""
    if not blocks:
        return np.empty(0, np.int64)
    symbols, scaled = unpack_table(table)
    cum = np.concatenate([[0], np.cumsum(scaled)])
    slots = np.repeat(np.arange(len(symbols), dtype=np.int32), scaled)
    freq, start = scaled.astype(np.float64), cum[:-1].astype(np.float64)
    words = np.concatenate([np.frombuffer(b.words, "<u4") for b in blocks] + [np.zeros(LANES, "<u4")])
    base = np.concatenate([[0], np.cumsum([len(b.words) // 4 for b in blocks])])
    x = np.concatenate([np.frombuffer(b.states, "<u8").reshape(-1, LANES) for b in blocks]).astype(np.float64)
    at = np.concatenate([np.array(b.places) + base[i] for i, b in enumerate(blocks)])
    steps = np.concatenate([
        np.minimum(CHECK, -(-b.n // LANES) - CHECK * np.arange(len(b.places))) for b in blocks
    ])
    got = np.empty((len(at), CHECK, LANES), np.int32)
    order = np.argsort(-steps, kind="stable")  # the longer stretches first, so those still running are a prefix
    x, at, steps = x[order], at[order], steps[order]
    for s in range(int(steps[0])):
        k = int(np.searchsorted(-steps, -s, "left"))  # stretches that have a step s
        y = x[:k]
        high = np.floor(y * (1 / LOW))
        slot = y - high * LOW
        c = slots[slot.astype(np.int32)]
        y = freq[c] * high + slot - start[c]
        got[:k, s] = c
        need = y < LOW
        rank = np.cumsum(need, axis=1)
        read = words[np.where(need, at[:k, None] + rank - 1, 0)]
        x[:k] = np.where(need, y * WORD + read, y)
        at[:k] += rank[:, -1]
    result, row = [], np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))
    first = 0
    for b in blocks:
        ids = symbols[got[row[first : first + len(b.places)]].reshape(-1)[: b.n]]
        first += len(b.places)
        if zlib.crc32(ids.astype("<u4").tobytes()) != b.crc:
            raise ValueError("checksum of a block does not hold")
        result.append(ids)
    return np.concatenate(result)
