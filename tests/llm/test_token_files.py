import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tests.llm.helpers import documents, edge_rows

from loomline.llm.token_files import read_token_files, write_token_files
from loomline.llm.tokens import PieceEncoder, load
from loomline.session import scratch

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = ["", " ", "  a", "a  b", "a   b \n c", "x\n y", "x \n y", "x\n  y\t z", "don't  stop", "a  b", "a  b", "\x1c x\x1c y", "q <|endoftext|> r<|endoftext|>", "é́ e ́", "A" * 700 + " b", "A" * 700 + ".", "x. y, z,, 5. ½. _. ). ...", "². ́.", "Straße ÀÉ ſt Ǆ ŉa ɏ ×a ÷b aªb Ångström İstanbul", "THE The the. don't I'LL x's", "Ünï  “q”\r\n日本語 x"]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("places", [False, True])
def test_pieces_give_the_librarys_ids(path, places):
    want = [load(path).encode(x, add_special_tokens=False) for x in ODD]
    for some in (pa.array(ODD), pa.array(["zz", *ODD]).slice(1)):
        ids, starts, ends = PieceEncoder(path, places=places).encode(some)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.ids for e in want]
        if places:
            at = [[len(x[:a].encode()) for a, _ in e.offsets] for x, e in zip(ODD, want)]
            assert [starts[a:b].tolist() for a, b in zip(ends, ends[1:])] == at
    assert PieceEncoder(path).encode(pa.array([], pa.string()))[2].tolist() == [0]


def test_round_trip(spark):
    rows = [*edge_rows(), (-(2**63), "the least id is an id", "a"), (8, "b", "a"), (8, "a", "a"), (8, None, "a")]
    folder = scratch(spark, "test")
    parts = write_token_files(documents(spark, rows), folder, BYTE, end_id=0, rows_per_part=2).collect()
    assert len(parts) > 1
    at = 0
    for p in sorted(parts, key=lambda p: p.part):
        assert p.base == at
        at += p.n_ids
    got = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.start)
    hashed = {r.t: r.h for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""]))
    start = 0
    for g, (i, t, _) in zip(got, want, strict=True):
        ids = [*load(BYTE).encode(t or "", add_special_tokens=False).ids, 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (i, start, len(ids), ids)
        start += len(ids)
    crc = {(r.start, r.ids_crc32) for r in read_token_files(spark, folder, "digest").collect()}
    assert crc == {(g.start, zlib.crc32(np.array(g.ids, "<u4").tobytes())) for g in got}


def test_empty_table(spark):
    folder = scratch(spark, "test")
    write_token_files(documents(spark, []), folder, BYTE, end_id=0)
    assert read_token_files(spark, folder).count() == 0
