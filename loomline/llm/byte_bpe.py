"""Byte-level BPE encoding by segment trees over byte positions, and decoding.

A piece's tree has a leaf for each byte position: the rank of the pair of tokens that starts there, with the position
behind it, so that a node's least value is its leftmost least rank. A merge takes the root, drops the right token's
position, and sets the leaves of the merged token, of its live neighbour before it and of the position that is gone;
each is a walk from the leaf to the root. Pieces of up to WIDE bytes are merged in blocks of equal tree width, one
merge per piece at a time, in numpy; longer ones have a tree in lists each, so a piece of n bytes takes n log n steps.

Texts are cut at white space where the pattern always cuts, and each distinct cut is split by the pattern once, its pieces
merged once; a bounded memo keeps them over batches. A piece that is a token whole is that token, as the public
library has it. No row is shuffled: each document is encoded in the task that reads it.

Null and empty texts have no tokens. Repeated rows give a row each. Empty tables give no rows. Columns other than the
id and the text are not looked at, whatever their names. Characters that this Python's Unicode tables lack are classed
as the library's pattern classes them, one at a time.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import merged, read_documents, texts
from loomline.llm.tokens import array_of, cut_pieces, ranges

#: Pieces of up to so many bytes are merged in blocks.
WIDE = 256
#: Bytes of text handled at once, cuts that the memo keeps at most, and the longest of them.
TOGETHER, ROOM, LONG = 1 << 22, 200_000, 256
#: Pieces merged in one block.
BLOCK = 8192
_NONE = np.iinfo(np.int64).max


class Ranks:
    """A rank file: tokens by their bytes, the pairs that merge, and the bytes of every token end to end."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        made = [(self.rank[t[:k]] << 32 | self.rank[t[k:]], r) for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        self.pairs, self.made = np.array(sorted(made), np.int64).reshape(-1, 2).T
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        token = [b""] * (1 + max(self.rank.values()))
        for t, r in self.rank.items():
            token[r] = t
        self.sizes = np.fromiter(map(len, token), np.int64, len(token))
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(token), np.uint8)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, _NONE where they do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], _NONE)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts end to end and where each starts, and the end, from their ids and where those start, and the end."""
        sizes = self.sizes[ids]
        return self.data[ranges(self.starts[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])[ends]


@lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def merge_block(pieces: list[bytes], ranks: Ranks, width: int) -> list[np.ndarray]:
    """The tokens of pieces of 2 to `width` bytes, width a power of two: a row of trees, of which each takes one merge at a time."""
    n = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    alive = np.arange(width + 1) < sizes[:, None]
    token = np.full((n, width + 1), -1, np.int64)
    token[alive] = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, width + 2), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    tree = np.full((n, 2 * width), _NONE)
    pair = alive[:, 1:]
    rank = ranks.of_pairs(token[:, :-1][pair], token[:, 1:][pair])
    tree[:, width:][pair] = np.where(rank == _NONE, _NONE, rank << 16 | np.broadcast_to(np.arange(width), pair.shape)[pair])
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def put(rows, at, value):
        """Sets leaves and walks up; a row's tree has one leaf set at a time."""
        node = at + width
        tree[rows, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair_at(rows, at, right):
        rank = ranks.of_pairs(token[rows, at], token[rows, right])
        return np.where(rank == _NONE, _NONE, rank << 16 | at)

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        root = tree[rows, 1]
        at = root & 0xFFFF
        gone = after[rows, at]
        right = after[rows, gone]
        token[rows, at], alive[rows, gone], after[rows, at] = root >> 16, False, right
        inside = right < sizes[rows]
        before[rows[inside], right[inside]] = at[inside]
        put(rows, gone, _NONE)
        value = np.full(len(rows), _NONE)
        value[inside] = pair_at(rows[inside], at[inside], right[inside])
        put(rows, at, value)
        left = before[rows, at]
        some = left >= 0
        if some.any():
            put(rows[some], left[some], pair_at(rows[some], left[some], at[some]))
        rows = rows[tree[rows, 1] != _NONE]
    return np.split(token[alive], np.cumsum(alive.sum(1))[:-1])


def merge_long(piece: bytes, ranks: Ranks) -> np.ndarray:
    """The tokens of one piece, by a tree in a list; pairs are looked up by their bytes."""
    n, rank = len(piece), ranks.rank
    width = 1 << max(1, (n - 1).bit_length())
    tree = [_NONE] * (2 * width)
    for at in range(n - 1):
        if (r := rank.get(piece[at : at + 2])) is not None:
            tree[width + at] = r << 32 | at
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = [*range(1, n + 1), n], [*range(-1, n)]

    def put(at, value):
        node = at + width
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break  # nothing changes further up
            tree[node] = least

    while (root := tree[1]) != _NONE:
        at = root & 0xFFFFFFFF
        gone = after[at]
        right = after[gone]
        after[at], before[right] = right, at
        put(gone, _NONE)
        r = rank.get(piece[at : after[right]]) if right < n else None
        put(at, _NONE if r is None else r << 32 | at)
        if (left := before[at]) >= 0:
            r = rank.get(piece[left:right])
            put(left, _NONE if r is None else r << 32 | left)
    out, at = [], 0
    while at < n:
        out.append(rank[piece[at : after[at]]])
        at = after[at]
    return np.array(out, np.int64)


def merge(pieces: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """The tokens of each piece of a byte or more, all of them by segment trees."""
    out: list = [None] * len(pieces)
    by: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        if len(p) > WIDE:
            out[k] = merge_long(p, ranks)
        elif len(p) > 1:
            by.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        else:
            out[k] = ranks.byte[list(p)]
    for width, own in by.items():
        few = max(1, BLOCK * 16 // width)
        for a in range(0, len(own), few):
            some = own[a : a + few]
            for k, ids in zip(some, merge_block([pieces[k] for k in some], ranks, max(2, width))):
                out[k] = ids
    return out


@lru_cache(maxsize=None)
def _stand_in(c: str, pattern: str) -> str:
    """An old letter, digit or mark for a character of a newer Unicode, by the class in which the library's pattern has it."""
    import tiktoken

    for old in "a1":
        ranks = {bytes([b]): b for b in range(256)} | {(old + c).encode(): 256}
        if len(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(old + c)) == 1:
            return old
    return "!"


class ByteEncoder:
    """Texts to ids, with a memo of cuts that is halved when it holds `room` of them."""

    def __init__(self, path: str, pattern: str, room: int = ROOM):
        import regex

        self.ranks, self.pattern, self.find, self.room, self.memo = ranks_of(path), pattern, regex.compile(pattern), room, _memo(path, pattern)

    def split(self, text: str) -> list[str]:
        """The pattern's matches."""
        if text.isascii() or not (new := {c for c in text if not c.isascii() and unicodedata.category(c) == "Cn"}):
            return self.find.findall(text)
        old = text.translate({ord(c): _stand_in(c, self.pattern) for c in new})
        return [text[m.start() : m.end()] for m in self.find.finditer(old)]

    def learn(self, cuts: list[str]) -> dict[str, bytes]:
        """The ids, as bytes, of cuts that the memo lacks."""
        parts = [[p.encode() for p in self.split(c)] for c in cuts]
        rank = self.ranks.rank
        ids = {p: np.array([rank[p]]) for ps in parts for p in ps if p in rank}
        rest = list(dict.fromkeys(p for ps in parts for p in ps if p not in rank))
        ids.update(zip(rest, merge(rest, self.ranks)))
        packed = {p: x.astype("<u4").tobytes() for p, x in ids.items()}
        return {c: b"".join([packed[p] for p in ps]) for c, ps in zip(cuts, parts)}

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's start, and the end."""
        coded, starts, offsets = cut_pieces(text)
        kinds = coded.dictionary.to_pylist()
        if len(self.memo) > self.room:  # frequent cuts come first, so what came first is kept
            kept = list(islice(self.memo.items(), self.room // 2))
            self.memo.clear()
            self.memo.update(kept)
        packed = list(map(self.memo.get, kinds))
        new = [k for k, x in enumerate(packed) if x is None]
        learned = self.learn([kinds[k] for k in new])
        for k in new:
            packed[k] = learned[kinds[k]]
        self.memo.update((k, x) for k, x in learned.items() if len(k) <= LONG)
        flat = np.frombuffer(b"".join(packed), "<u4")
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        code = coded.indices.to_numpy()
        each = lengths[code]
        ends = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts[:-1], offsets)]
        return flat[ranges((np.cumsum(lengths) - lengths)[code], each)], ends


@lru_cache(maxsize=4)
def _memo(path: str, pattern: str) -> dict[str, bytes]:
    """A Python worker's memo, which outlasts its tasks."""
    return {}


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit, little-endian) and decoded (the bytes that the ids stand for) of every row."""

    def run(batches):
        encoder = ByteEncoder(ranks, pattern)
        for batch in merged(batches, "text", TOGETHER):
            ids, ends = encoder.encode(batch["text"])
            decoded, at = encoder.ranks.decode(ids, ends)
            cols = [batch["doc_id"], pa.array(np.diff(ends)), array_of(ids.astype("<u4"), 4 * ends), array_of(decoded, at)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the sha256 of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    out = encode_texts(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
