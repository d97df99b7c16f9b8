import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from brickloom.llm import bpe, completion, packing, queries, rans, token_files

SF = "/root/testdata/sf0.001"


def whole(name, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, 2], "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def small():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files_equal_whole_texts(spark):
    rows, at, want = by_id(small()), 0, []
    for (doc, _), ids in zip(rows, whole("word_bpe_49k.json", [t for _, t in rows]), strict=True):
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op2_token_files"](spark, SF).collect()) == want


def test_token_files_of_odd_rows(spark, odd_documents, no_documents):
    path = queries.vocabulary("word_bpe_49k.json")
    got = token_files.write_and_read(odd_documents, path).collect()
    rows = rows_of(odd_documents)
    want = Counter((d, len(i), zlib.crc32(i.tobytes())) for (d, _), i in zip(rows, whole("word_bpe_49k.json", [t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id for r in ordered] == [d for d, _ in by_id(rows)]
    assert token_files.write_and_read(no_documents, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 257, rans.BLOCK + 1, 2 * rans.BLOCK + 777])
def test_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n), 49_000).astype(np.int64)
    table, blocks = rans.encode(ids)
    assert np.array_equal(rans.decode(table, blocks), ids)
    if n > rans.BLOCK:  # blocks are independent, and a broken one is noticed
        assert np.array_equal(rans.decode(table, blocks[1:2]), ids[rans.BLOCK : rans.BLOCK + blocks[1].n])
        blocks[0].words = blocks[0].words[:-4] + bytes(4)
        with pytest.raises(ValueError):
            rans.decode(table, blocks)


def check_packing(got, ids, capacity=1024):
    """Every token of every row stands once, pieces are as the contract has them, and sequences have no gap."""
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= capacity
    want = Counter()
    for doc, x in ids:
        first = len(x) % capacity or capacity
        cuts = [0, *range(first, len(x) + 1, capacity)] if len(x) > capacity else [0, len(x)]
        want.update((doc, p, a, b - a, zlib.crc32(x[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(places)


def test_packing(spark, odd_documents, no_documents):
    rows = small()
    ids = list(zip([d for d, _ in rows], whole("byte_bpe_50k.json", [t for _, t in rows]), strict=True))
    used = check_packing(queries.QUERIES["op5_packed_sequences"](spark, SF).collect(), ids)
    assert used <= 1.02 * -(-sum(len(x) for _, x in ids) // 1024)
    path = queries.vocabulary("byte_bpe_50k.json")
    rows = rows_of(odd_documents)
    check_packing(packing.packed(odd_documents, path).collect(), list(zip([d for d, _ in rows], whole("byte_bpe_50k.json", [t for _, t in rows]), strict=True)))
    assert packing.packed(no_documents, path).count() == 0


def least_bins(items, capacity):
    best = [len(items)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(items):
            best[0] = len(room)
            return
        for k in {r: j for j, r in enumerate(room) if r >= items[i]}.values():
            room[k] -= items[i]
            go(i + 1, room)
            room[k] += items[i]
        room.append(capacity - items[i])
        go(i + 1, room)
        room.pop()

    go(0, [])
    return best[0]


def test_bin_completion_against_all_packings():
    r = random.Random(3)
    for _ in range(60):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        plan = completion.complete(Counter(items), 20)
        assert Counter(s for f, n in plan for s in f for _ in range(n)) == Counter(items) and all(sum(f) <= 20 for f, _ in plan)
        assert completion.bins(plan) == least_bins(items, 20)


def reference(texts):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(queries.vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    return [np.array(enc.encode_ordinary(t or ""), "<u4").tobytes() for t in texts]


def test_byte_bpe(spark, odd_documents, no_documents):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd_documents):
        rows = rows_of(df)
        got = bpe.round_trips(df, path, public_tokenizers.PATTERN).collect()
        want = Counter((d, len(i) // 4, sha(i), sha((t or "").encode())) for (d, t), i in zip(rows, reference([t for _, t in rows]), strict=True))
        assert Counter(map(tuple, got)) == want
    assert bpe.round_trips(no_documents, path, public_tokenizers.PATTERN).count() == 0


def test_long_words_go_through_the_other_query():
    r = random.Random(1)
    words = ["x" * 5000, "ab" * 300, "".join(r.choice("etaoinshr") for _ in range(400)), "é" * 200, "aaa" * 43]
    got = bpe.Encoder(queries.vocabulary("byte_bpe_multi_50k.tiktoken")).words([w.encode() for w in words])
    assert [g[0] for g in got] == reference(words) and [g[1].decode() for g in got] == words
