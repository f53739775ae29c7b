"""Tokenizer access inside Arrow functions.

Byte-level BPE never joins characters across the start of a run of white space that follows a
non-space character, nor across the end of a run of letters or digits, so a text may be cut there:
the pieces' tokens are the text's. Cuts are found over the UTF-8 bytes of a whole batch at once, and
Arrow numbers the distinct pieces. Pieces repeat (words with the space before them), so each worker
keeps a bounded table from piece to tokens, over all its tasks: ids in one flat array, with the first
and the number of each piece's. The library encodes only what is new, in calls of about equal bytes.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import by_bytes

#: Bytes of pieces per library call, pieces kept per worker (some 100 MB), longest piece kept.
CALL_BYTES, KEPT_PIECES, KEPT_BYTES = 1 << 14, 700_000, 64
#: Bytes that are cut into pieces at a time; a longer text goes through in several such parts.
SLICE_BYTES = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True
#: Bytes after which white space begins no piece: white space, what some libraries count as such, and the ends of wide white space.
_AFTER_NONE = _SPACE.copy()
_AFTER_NONE[0x1C:0x20] = True
_WIDE_END = np.zeros(256, bool)
_WIDE_END[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True

#: Bytes that are no white space alone; the second of two bytes from 0xC3 on is none either.
_ENDS = bytes(range(33, 127))


def utf8_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _arrow(texts) -> pa.Array:
    """Texts as an array of strings without nulls; a null is empty."""
    array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return array.fill_null("") if array.null_count else array


class Encoder:
    """Encodes texts with a .json (tokenizers) or .model (sentencepiece) file.

    lengths(texts) gives token counts only; encode(texts) all ids side by side, and each text's count;
    ids(texts) each text's little-endian 32-bit ids as bytes. Texts are a list or an Arrow array of strings.
    No special tokens are added; special strings inside a text follow the library's default.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        self.path, self.kept, self.sliced = path, kept, False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
            self.vocabulary = model.get_piece_size()
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._ids = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            added = {i: t for i, t in model.get_added_tokens_decoder().items()}
            pre = json.loads(model.pre_tokenizer.__getstate__()) if model.pre_tokenizer else {}
            self.vocabulary = max(model.get_vocab(with_added_tokens=True).values(), default=0) + 1
            self.sliced = (
                model.normalizer is None
                and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True)
                and not pre.get("add_prefix_space")
                and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added.values())
            )
            # a byte-level token has a letter for each of its bytes
            self._bytes = np.zeros(self.vocabulary, np.int64)
            for token, i in model.get_vocab(with_added_tokens=True).items():
                self._bytes[i] = len(added[i].content.encode()) if i in added else len(token)
            #: punctuation that may begin a piece after a letter or digit; an apostrophe may belong to the letters after it
            self._mark = np.zeros(256, bool)
            self._mark[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'" + "".join(t.content for t in added.values())]] = True
        self.type = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self._slot: dict[bytes, int] = {}
        self._flat, self._first, self._size = np.zeros(0, self.type), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lengths(self, texts) -> list[int]:
        return self._encode(texts, False)[1].tolist()

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        return self._encode(texts, True)

    def ids(self, texts) -> list[bytes]:
        flat, counts = self._encode(texts, True)
        data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _encode(self, texts, wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        texts = _arrow(texts)
        if not self.sliced:
            out = [np.array(x, self.type) for group in by_bytes(texts.to_pylist(), utf8_size, 1 << 19) for x in self._ids(group)]
            return np.concatenate([np.zeros(0, self.type), *out]), np.array([len(x) for x in out], np.int64)
        counts, ids = np.zeros(len(texts), np.int64), []
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at, end = int(offsets[0]), int(offsets[-1])
        while at < end:
            starts, upto = self._cut(data, offsets, at, end)
            first, size, flat, which = self._pieces(data[at:upto], starts)
            text = np.searchsorted(offsets, starts + at, "right") - 1
            each = size[which]
            counts += np.bincount(text, each, len(texts)).astype(np.int64)
            if wanted:
                total = np.cumsum(each)
                ids.append(flat[np.repeat(first[which] - total + each, each) + np.arange(total[-1])])
            at = upto
        return np.concatenate([np.zeros(0, self.type), *ids]), counts

    def _cut(self, data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> tuple[np.ndarray, int]:
        """(where pieces start, counted from at; where they end): pieces of SLICE_BYTES or of one longer piece."""
        width = SLICE_BYTES
        while True:
            upto = min(end, at + width)
            b = data[at:upto]
            cut = np.zeros(len(b), bool)
            before = b[:-1]
            cut[1:] = (_SPACE[b[1:]] & ~_AFTER_NONE[before]) | (self._mark[b[1:]] & _WORD[before])
            odd = np.flatnonzero(cut[1:] & _WIDE_END[before])  # perhaps the end of white space of two or three bytes
            wide = (b[np.maximum(odd - 1, 0)] == 0xC2) | (b[np.maximum(odd - 2, 0)] >= 0xE1) & (b[np.maximum(odd - 2, 0)] <= 0xE3)
            cut[odd[wide] + 1] = False
            lo, hi = np.searchsorted(offsets, [at, upto], "left")
            cut[offsets[lo:hi] - at] = True
            cut[0] = True
            starts = np.flatnonzero(cut)
            if upto == end:
                return starts, end
            if len(starts) > 1:  # the last piece may go on
                return starts[:-1], at + int(starts[-1])
            width *= 2

    def _pieces(self, data: np.ndarray, starts: np.ndarray):
        """(first, size, flat, which): ids of each distinct piece in flat, and which of these each piece is."""
        ends = np.append(starts, len(data)).astype(np.int32)
        array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = _values(array.dictionary)
        known, old = self._slot.get, len(self._size)
        slots = np.array([known(p, -1) for p in distinct], np.int64)
        flat, first, size = self._flat, self._first, self._size
        new = np.flatnonzero(slots < 0).tolist()
        if new:
            pieces, ids, sizes = self._library([distinct[n] for n in new])
            flat = np.concatenate([flat, ids])
            first, size = np.concatenate([first, len(self._flat) + np.cumsum(sizes) - sizes]), np.concatenate([size, sizes])
            own = dict(zip(pieces, range(old, len(size))))
            slots[new] = [own[distinct[n]] for n in new]
            # what came early is what is frequent, so a full table takes no more
            if old < self.kept:
                self._flat, self._first, self._size = flat, first, size
                self._slot.update(x for x in own.items() if len(x[0]) <= KEPT_BYTES)
        return first[slots], size[slots], flat, array.indices.to_numpy()

    def _library(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The pieces in some order, their ids side by side, and each one's number. Pieces that begin with white space and
        don't end with it are joined for a call, as their ids stay apart; the ids' bytes tell where each one's end."""
        done, ids, sizes, alone = [], [], [], []
        alike = []
        for p in pieces:
            (alike if p[0] in b" \n" and (p[-1] in _ENDS or p[-2:-1] == b"\xc3") else alone).append(p)
        for group in _groups(alike):
            found = np.array(self._ids([b"".join(group).decode()])[0], np.int64)
            through = np.concatenate([[0], np.cumsum(self._bytes[found])])
            edge = np.cumsum([0, *map(len, group)])
            where = np.searchsorted(through, edge)
            if through[-1] != edge[-1] or (through[where] != edge).any():
                alone += group
                continue
            done += group
            ids.append(found.astype(self.type))
            sizes.append(np.diff(where))
        for group in _groups(alone):
            found = self._ids([p.decode() for p in group])
            done += group
            ids += [np.array(x, self.type) for x in found]
            sizes.append(np.array([len(x) for x in found], np.int64))
        return done, np.concatenate(ids), np.concatenate(sizes)


def _values(array: pa.Array) -> list[bytes]:
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    data = array.buffers()[2].to_pybytes() if ends[-1] else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _groups(pieces: list[bytes]):
    """Lists of consecutive pieces of about CALL_BYTES."""
    edges = np.flatnonzero(np.diff(np.cumsum([0, *map(len, pieces)]) // CALL_BYTES, prepend=-1)).tolist() if pieces else []
    for a, b in zip(edges, [*edges[1:], len(pieces)]):
        if a < b:
            yield pieces[a:b]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept: int = KEPT_PIECES) -> Encoder:
    """This worker's encoder. A worker that serves other stages too can be told to keep fewer pieces."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]
