import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tests.llm.helpers import documents, edge_rows
from tests.llm.test_token_files import ODD

from loomline.llm.bpe_tree import AMPLE, LEAF, LEAN, TreeEncoder, encode_texts
from loomline.llm.tokens import load

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


def unsplit(rnd, n, kind):
    return {
        "letters": lambda: "".join(rnd.choice("thenaisor") for _ in range(n)),
        "one": lambda: "a" * n,
        "two": lambda: "ab" * (n // 2),
        "marks": lambda: "".join(rnd.choice("!?.'s#=-") for _ in range(n)),
        "mixed": lambda: "".join(rnd.choice(["é", "é", "日本", "ing", "THE", "'ll", "7", "🙂", "ß"]) for _ in range(n)),
        "blank": lambda: "x" + " " * n + "y",
        "prose": lambda: " ".join("".join(rnd.choice("thenaisor") for _ in range(rnd.randrange(1, 12))) for _ in range(n // 6)),
    }[kind]()


@pytest.mark.parametrize("kind", ["letters", "one", "two", "marks", "mixed", "blank", "prose"])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_is_the_librarys_encoding(kind, path):
    rnd = random.Random(3)
    tree = TreeEncoder(path, leaf=40, window=16)
    rows = [unsplit(rnd, n, kind) for n in (30, 0, 41, 97, 500, 1500)]
    for text, (ids, starts) in zip(rows, tree.encode(pa.array(rows)), strict=True):
        want = load(path).encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids
        assert starts.tolist() == [len(text[:a].encode()) for a, _ in want.offsets]
    assert tree.joins > 50


def test_documents_come_through_the_tree():
    """Almost all of the documents that are longer than a leaf are joined from halves, in the given table."""
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    tree, joined, over = TreeEncoder(WORD), 0, 0
    for x in texts:
        before = tree.joins
        [(ids, _)] = tree.encode(pa.array([x]))
        assert ids.tolist() == load(WORD).encode(x, add_special_tokens=False).ids
        over += len(x.encode()) > LEAF
        joined += tree.joins > before
    assert over > 100 and joined == over
    assert tree.redone < tree.joins / 20


def test_rows(spark):
    rnd = random.Random(4)
    rows = edge_rows() + [(100 + k, x, "a") for k, x in enumerate(ODD)] + [(300 + k, unsplit(rnd, 5000, kind), "b") for k, kind in enumerate(["letters", "two", "mixed", "marks"])]
    rows += [rows[-1], rows[-1], (None, rows[-2][1], None)]
    got = encode_texts(documents(spark, rows), WORD, split=700).collect()
    tok = load(WORD)
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, tok.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert encode_texts(documents(spark, []), WORD).count() == 0


def test_sizes_of_batches_and_memo_change_nothing(spark):
    docs = documents(spark, edge_rows())
    rows = lambda size: sorted(map(repr, encode_texts(docs, WORD, digest=True, size=size).collect()))
    assert rows(AMPLE) == rows(LEAN) == rows((1000, 50, *LEAN[2:]))


def test_lean_memo_ends_with_its_task():
    lean, text = TreeEncoder(WORD, lasting=LEAN[2]), pa.array(["hello world " * 100, ""])
    assert [x[0].tolist() for x in lean.encode(text)] == [x[0].tolist() for x in TreeEncoder(WORD).encode(text)]
    assert lean.flat.memo and lean.flat.memo is not TreeEncoder(WORD).flat.memo
