"""Encoding whole texts with the tokenizers library, one distinct piece at a time.

Both public vocabularies pre-tokenize so that a token boundary always falls before a white-space character that a
non-space follows, and behind it unless it is a space: a run of white space gives up its last space to the word behind
it, or white space is dropped. Texts are cut there, in Arrow's buffers, each distinct piece of a batch is looked up in a memo that
outlasts tasks or goes to the library, and the pieces' ids are strung together by their lengths; the result is
the library's for the whole text. White space is no cut where the byte behind it may begin a white space of more bytes.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa

_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
#: Letters whose lower case is one letter of as many bytes, which composing leaves as it is.
_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿŒœ]+").fullmatch
#: White space at which a text may be cut, and bytes that may follow it there: none that is white space, or starts one of two or three bytes.
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_CUTS = np.array([b not in {*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3} for b in range(256)])


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet, by its rule: bytes that print stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _shortcut(path: str):
    """(which pieces are one word, how the library's model reads them), for the two set-ups known to make a run of letters one token's span; else None.

    Such a word can go to the library's BPE model without its pre-tokenizer, at a part of the cost.
    """
    conf = json.loads(load(path).to_str())
    pre, norm, model = conf["pre_tokenizer"] or {}, conf["normalizer"], conf["model"]
    if model["type"] != "BPE" or model.get("dropout") or any(t["content"].isalpha() for t in conf["added_tokens"]):
        return None
    letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
    spell = lambda p: p.encode().decode("latin-1").translate(letters)
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return _WORD, lambda p: (letters[32] + p[1:] if p[0] == " " else p) if p.isascii() else spell(p)
    steps = [x["type"] for x in (norm or {}).get("normalizers", ())], [x["type"] for x in pre.get("pretokenizers", ())]
    if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
        return _PLAIN, lambda p: p.lstrip(" ").lower() if p.isascii() else spell(p.lstrip(" ").lower())
    return None


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and where each text starts, and the end."""
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def array_of(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:  # noqa: B008
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] numbers, and so on, end to end."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def cut_pieces(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The pieces of all texts end to end, the bytes where they start, and the end, and where each text starts, and the end."""
    data, offsets = bytes_of(text)
    sizes = np.diff(offsets)
    cut = np.zeros(len(data), bool)
    blank = np.flatnonzero(_BLANK[data[:-1]])
    blank = blank[_CUTS[data[blank + 1]]]
    cut[blank] = True
    cut[offsets[1:][sizes > 0] - 1] = False  # the byte behind is another text's
    cut[blank[data[blank] != 32] + 1] = True
    cut[offsets[:-1][sizes > 0]] = True
    starts = np.append(np.flatnonzero(cut), len(data))
    return array_of(data, starts, pa.string()).dictionary_encode(), starts, offsets


class PieceEncoder:
    """Texts to ids, with a memo of pieces that is halved when it holds `room` of them; with places, also where each token starts, in bytes (of the character that it starts in). The memo outlasts the task if lasting."""

    def __init__(self, path: str, places: bool = False, room: int = 600_000, long_piece: int = 256, lasting: bool = True):
        self.path, self.tok, self.places, self.room, self.long_piece = path, load(path), places, room, long_piece
        self.memo, self.marks = _memo(path, places) if lasting else {}, _marks(path)

    def _pack(self, ids: list[int], starts: list[int]) -> bytes:
        out = array("I", [x for pair in zip(ids, starts) for x in pair] if self.places else ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The packed ids of pieces that the memo lacks."""
        pack, marks, memo, places, long = self._pack, self.marks, self.memo, self.places, self.long_piece
        # a letter or digit and a mark behind it are never one token, so the mark can be taken off
        marked = {p: p[:-1] for p in new if p[-1:] in marks and p[-2:-1].isalnum()}
        out, rest = {p: memo[p] for p in marked.values() if p in memo}, []
        is_word, read = _shortcut(self.path) or (lambda p: None, None)
        one = self.tok.model.tokenize
        for p in {*new}.difference(marked) | {*marked.values()}.difference(out):
            if len(p) <= long and is_word(p):
                spelled = read(p)
                tokens, starts = one(spelled), []
                if places:  # a letter stands for a byte
                    raw = p.encode()
                    at = len(raw) - len(spelled)
                    for t in tokens:
                        starts.append(at - 1 if raw[at] & 0xC0 == 0x80 else at)
                        at += len(t.value)
                out[p] = pack([t.id for t in tokens], starts)
            else:
                rest.append(p)
        many = self.tok.encode_batch if places else self.tok.encode_batch_fast
        for p, e in zip(rest, many(rest, add_special_tokens=False)):
            starts = [a for a, _ in e.offsets] if places else []
            if places and not p.isascii():
                at = [0, *accumulate([len(c.encode("utf-8", "surrogatepass")) for c in p])]
                starts = [at[a] for a in starts]
            out[p] = pack(e.ids, starts)
        for p, stem in marked.items():
            out[p] = out[stem] + pack(marks[p[-1]], [len(stem.encode("utf-8", "surrogatepass"))] * len(marks[p[-1]]))
        return out

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Ids of all texts end to end, where each token starts in its text (with places), and where each text's ids start, and the end."""
        coded, starts, offsets = cut_pieces(text)
        kinds = coded.dictionary.to_pylist()
        if len(self.memo) > self.room:  # frequent pieces come first, so what came first is kept
            kept = list(islice(self.memo.items(), self.room // 2))
            self.memo.clear()
            self.memo.update(kept)
        packed = list(map(self.memo.get, kinds))
        new = [k for k, x in enumerate(packed) if x is None]
        learned = self._learn([kinds[k] for k in new])
        for k in new:
            packed[k] = learned[kinds[k]]
        self.memo.update((k, x) for k, x in learned.items() if len(k) <= self.long_piece)
        wide = 2 if self.places else 1
        flat = np.frombuffer(b"".join(packed), "<u4").reshape(-1, wide)
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // (4 * wide)
        code = coded.indices.to_numpy()
        each = lengths[code]
        spots = ranges((np.cumsum(lengths) - lengths)[code], each)
        ends = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts[:-1], offsets)]
        if not self.places:
            return flat[spots, 0], None, ends
        first = np.repeat(offsets[:-1], np.diff(ends))
        return flat[spots, 0], flat[spots, 1].astype(np.int64) + np.repeat(starts[:-1], each) - first, ends


@lru_cache(maxsize=8)
def _memo(path: str, places: bool) -> dict[str, bytes]:
    """A Python worker's memo, which outlasts its tasks."""
    return {}


@lru_cache(maxsize=4)
def _marks(path: str) -> dict[str, list[int]]:
    return {c: load(path).encode(c, add_special_tokens=False).ids for c in ".,;:!?"}
