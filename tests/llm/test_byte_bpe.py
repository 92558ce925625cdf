import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import byte_bpe as B
from tests.llm.helpers import documents, edge_rows

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def slow(piece: bytes, rank: dict) -> list[int]:
    """BPE by its rule: the leftmost pair of least rank merges, again and again."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not found:
            return [rank[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_trees_against_the_rule():
    ranks, rnd = B.ranks_of(PATH), random.Random(1)
    pieces = [bytes(rnd.choice(b"aeinorst") for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 9, 16, 17, 40, 255, 256]))) for _ in range(400)]
    pieces += [b"aaaaaaaa", b"\xff\xfe\x00", "日本語".encode(), b"aaa" * 85, b"ab" * 300, bytes(rnd.choice(b"helo ") for _ in range(900))]
    for piece, ids in zip(pieces, B.merge(pieces, ranks)):
        want = slow(piece, ranks.rank)
        assert ids.tolist() == want
        if len(piece) > 1:
            assert B.merge_long(piece, ranks).tolist() == want


def test_texts_against_the_library(library):
    rnd = random.Random(2)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "1", "23", "é", "ß", "日本", "́", " ", " ", "\x1c", "\x1f", "\x85", "!", "...", "🙂", "՘", "\U00031350", "​", "_", "-", "word", "'", "﻿", "\x00"]
    texts = ["", " ", "\n", *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)), "x" * 5000, "the quick " * 3000]
    ids, ends = B.ByteEncoder(PATH, P.PATTERN).encode(pa.array(texts))
    for t, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(t), repr(t)
    decoded, at = B.ranks_of(PATH).decode(ids, ends)
    assert [decoded[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == texts


def test_characters_of_a_newer_unicode(library):
    odd = [chr(c) for c in (0x558, 0x58B, 0x88F, 0xC5C, 0x208F, 0x11DE0, 0x12475, 0x3FC3F, 0x16FF4, 0x105C0, 0x10D40)]
    texts = [a + c + b for c in odd for a in ("a", "1", "!", " ", "") for b in ("a", "1", "!", " ", "")]
    ids, ends = B.ByteEncoder(PATH, P.PATTERN).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode_ordinary(t) for t in texts]


def test_a_full_memo_changes_nothing(library):
    encoder = B.ByteEncoder(PATH, P.PATTERN, room=3)
    for k in range(5):
        t = [f"some zzqx{k} words wwk{j}x" for j in range(20)]
        ids, ends = encoder.encode(pa.array(t))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode_ordinary(x) for x in t]


def test_rows(spark, library):
    rows = [*edge_rows(), (11, "qzxv" * 20_000, "a")]
    got = sorted(map(tuple, B.encode_texts(documents(spark, rows), PATH, P.PATTERN).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), bytearray(ids.tobytes()), bytearray((t or "").encode())))
    assert got == sorted(want, key=repr)


def test_query(spark, library, tmp_path):
    rows = edge_rows()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = [np.array(library.encode_ordinary(t or ""), "<u4") for _, t, _ in rows]
    want = [(i, len(x), sha(x.tobytes()), sha((t or "").encode())) for (i, t, _), x in zip(rows, ids)]
    out = B.op12_byte_bpe(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert B.encode_texts(documents(spark, rows).limit(0), PATH, P.PATTERN).count() == 0
