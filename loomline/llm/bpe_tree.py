"""BPE encoding of whole texts by tree concatenation, and decoding.

Every text of over LEAF bytes is cut into halves, and the halves' halves, wherever that falls, down to leaves
that are encoded by themselves. To join two halves, a window around the cut is encoded again and compared with both:
where window and half have the same tokens at the same places through a zone on each side of the cut, the left half
is kept up to its zone, the window up to its right zone, and the right half from there on; else the window is
doubled, until it agrees or is the whole. A batch's texts go up their trees together, so that the leaves of all
of them, and the windows of a level, are encoded at once, each distinct piece once (see tokens.py).

Texts of over SPLIT characters are cut into leaves that are rows of their own, so that a very long text is
encoded by many tasks; one task then joins its ids.

Null texts are empty: no ids, and an empty decoded text. Repeated rows give a row each. Ids may be null or shared.
Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import merged, read_documents, row_key, texts
from loomline.llm.tokens import PieceEncoder, array_of, bytes_of, load

#: Characters of a text beyond which its leaves are rows; most bytes of a leaf inside a task; bytes of the first window on each side.
SPLIT, LEAF, WINDOW = 65_536, 512, 64
#: Bytes of texts that go up their trees together, and pieces that a memo holds, and whether it outlasts its task: lean beside other work, and where encoding is all the work.
LEAN, AMPLE = (1 << 20, 200_000, False), (1 << 22, 600_000, True)

Tokens = tuple[np.ndarray, np.ndarray]  # ids, and where each starts, in bytes


class TreeEncoder:
    """Encodes texts by their trees. joins and redone count the joins made, and the windows encoded beyond each join's first."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, room: int = LEAN[1], lasting: bool = True):
        self.flat, self.leaf, self.window = PieceEncoder(path, places=True, room=room, lasting=lasting), leaf, window
        self.joins = self.redone = 0

    def encode(self, text: pa.Array) -> list[Tokens]:
        data, ends = bytes_of(text)
        sizes = np.diff(ends)
        leaves = 1 << np.ceil(np.log2(np.maximum(sizes, 1) / self.leaf)).clip(0).astype(np.int64)
        first = np.cumsum(leaves) - leaves
        place = np.arange(leaves.sum()) - np.repeat(first, leaves)
        cuts = np.append(_whole(data, np.repeat(ends[:-1], leaves) + np.repeat(sizes, leaves) * place // np.repeat(leaves, leaves)), ends[-1])
        ids, starts, at = self.flat.encode(array_of(data, cuts))
        starts = starts + np.repeat(cuts[:-1], np.diff(at))
        nodes = [(ids[a:b], starts[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        roots = self.tree(data, nodes, cuts, first, leaves)
        return [(x, y - e) for (x, y), e in zip(roots, ends.tolist())]

    def tree(self, data: np.ndarray, nodes: list[Tokens], cuts: np.ndarray, first: np.ndarray, leaves: np.ndarray) -> list[Tokens]:
        """The tokens of each text from those of its leaves: leaf k holds data[cuts[k]:cuts[k + 1]], and text t the leaves from first[t] on."""
        nodes, wide = list(nodes), 1
        while wide < leaves.max(initial=0):
            left = np.concatenate([np.arange(f, f + n - wide, 2 * wide) for f, n in zip(first[leaves > wide].tolist(), leaves[leaves > wide].tolist())])
            last = np.repeat(first + leaves, [max(0, -(-(n - wide) // (2 * wide))) for n in leaves.tolist()])
            self.join(data, nodes, left, left + wide, cuts[left], cuts[left + wide], cuts[np.minimum(left + 2 * wide, last)])
            wide *= 2
        return [nodes[k] for k in first.tolist()]

    def join(self, data, nodes: list[Tokens], left, right, lo, cut, hi) -> None:
        """Puts the tokens of data[lo:hi] into nodes[left], from those of data[lo:cut] in nodes[left] and of data[cut:hi] in nodes[right]."""
        self.joins += len(left)
        todo, w = np.arange(len(left)), self.window
        while len(todo):
            a, b = _whole(data, np.maximum(lo[todo], cut[todo] - w)), _whole(data, np.minimum(hi[todo], cut[todo] + w))
            raw = data.tobytes()
            ids, starts, at = self.flat.encode(pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary()))
            starts, again = starts + np.repeat(a, np.diff(at)), []
            for k, x, y, s, e in zip(todo.tolist(), a.tolist(), b.tolist(), at[:-1].tolist(), at[1:].tolist()):
                win, one, two, c = (ids[s:e], starts[s:e]), nodes[left[k]], nodes[right[k]], int(cut[k])
                from_ = (0, 0) if x == lo[k] else _zone(one, win, c - 3 * w // 4, c - w // 4, first=True)
                to = (len(win[0]), len(two[0])) if y == hi[k] else _zone(two, win, c + w // 4, c + 3 * w // 4, first=False)
                if from_ is None or to is None:
                    again.append(k)
                    continue
                nodes[left[k]] = tuple(np.concatenate([p[: from_[1]], q[from_[0] : to[0]], r[to[1] :]]) for p, q, r in zip(one, win, two))
            self.redone += len(again)
            todo, w = np.array(again, np.int64), 2 * w


def _whole(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places moved back to the start of their characters."""
    at = at.copy()
    for _ in range(3):
        inside = at < len(data)
        at[inside] -= (data[at[inside]] & 0xC0) == 0x80
    return at


def _zone(half: Tokens, win: Tokens, lo: int, hi: int, first: bool) -> tuple[int, int] | None:
    """If half and window have the same tokens, one at least, within lo..hi: the places in window and half of the first of them, or of the last."""
    i, j = half[1].searchsorted((lo, hi)).tolist()
    k, n = win[1].searchsorted((lo, hi)).tolist()
    if j - i != n - k or i == j or (half[0][i:j] != win[0][k:n]).any() or (half[1][i:j] != win[1][k:n]).any():
        return None
    return (k, i) if first else (n - 1, j - 1)


class Reader:
    """Ids to text and to their digests, as the library's decode(ids, skip_special_tokens=False)."""

    def __init__(self, path: str, digest: bool):
        self.tok, self.digest = load(path), digest
        size = self.tok.get_vocab_size()
        self.decimal = [str(k) for k in range(size)].__getitem__
        # without a decoder, the library's text is the tokens with a space between
        self.token = [self.tok.id_to_token(k) for k in range(size)].__getitem__ if self.tok.decoder is None else None

    def read(self, runs: list[list[int]]) -> dict[str, list]:
        decoded = self.tok.decode_batch(runs, skip_special_tokens=False) if self.token is None else [" ".join(map(self.token, x)) for x in runs]
        if not self.digest:
            return {"n_tokens": [len(x) for x in runs], "ids": runs, "decoded": decoded}
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        return {"n_tokens": [len(x) for x in runs], "ids_sha256": [sha(" ".join(map(self.decimal, x))) for x in runs], "decoded_sha256": [sha(x) for x in decoded]}


_SCHEMAS = {True: "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", False: "doc_id long, n_tokens long, ids array<int>, decoded string"}
_TYPES = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, split: int = SPLIT, size: tuple[int, int, bool] = LEAN) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every row; with digest, the sha256 of the decimal ids and of the decoded text instead of both."""
    rows, (together, room, lasting) = texts(docs, id_col, text_col), size

    def short(batches):
        tree, reader = TreeEncoder(tokenizer, room=room, lasting=lasting), Reader(tokenizer, digest)
        for batch in merged(batches, "text", together):
            runs = [ids for ids, _ in tree.encode(batch["text"])]
            for k in range(0, len(runs), 256):
                out = reader.read([ids.tolist() for ids in runs[k : k + 256]])
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(k, 256)} | {c: pa.array(v, _TYPES[c]) for c, v in out.items()})

    def cut(batches):
        for batch in batches:
            for i, key, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "tkey", "text"))):
                n = 1 << max(0, (len(text) - 1) // split).bit_length()
                at = [len(text) * k // n for k in range(n + 1)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i] * n, pa.int64()), "tkey": pa.array([key] * n, pa.int64()), "part": pa.array(range(n), pa.int64()), "parts": pa.array([n] * n, pa.int64()), "text": pa.array([text[a:b] for a, b in zip(at, at[1:])], pa.string())})

    def leaf(batches):
        tree = TreeEncoder(tokenizer, room=room, lasting=lasting)
        for batch in merged(batches, "text", together):
            done = tree.encode(batch["text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[c] for x in done], pa.list_(pa.int32())) for c in (0, 1))], names=[*batch.schema.names, "ids", "starts"])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", kind="stable")
        copies = len(group) // int(group["parts"].iloc[0])
        group = group.iloc[::copies]
        data = np.frombuffer("".join(group["text"]).encode("utf-8", "surrogatepass"), np.uint8)
        cuts = np.concatenate([[0], np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in group["text"]])])
        leaves = [(np.asarray(x, np.uint32), np.asarray(y, np.int64) + c) for x, y, c in zip(group["ids"], group["starts"], cuts)]
        ids = TreeEncoder(tokenizer).tree(data, leaves, cuts, np.array([0]), np.array([len(leaves)]))[0][0].tolist()
        out = Reader(tokenizer, digest).read([ids])
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(group["doc_id"].iloc[0]) else int(group["doc_id"].iloc[0])] * copies, "Int64")} | {c: v * copies for c, v in out.items()})

    schema = _SCHEMAS[digest]
    plain = rows.where(F.length("text") <= split).mapInArrow(short, schema)
    parts = rows.where(F.length("text") > split).withColumn("tkey", row_key()).mapInArrow(cut, "doc_id long, tkey long, part long, parts long, text string")
    leaves = parts.repartition("doc_id", "tkey", "part").mapInArrow(leaf, "doc_id long, tkey long, part long, parts long, text string, ids array<int>, starts array<int>")
    return plain.unionByName(leaves.groupBy("doc_id", "tkey").applyInPandas(whole, schema))


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    import public_tokenizers

    return encode_texts(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digest=True, size=AMPLE)
