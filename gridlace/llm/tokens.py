"""Byte-level BPE of whole texts, exactly as the tokenizers library does it, with a cache of pieces.

A byte-level pre-tokenizer with its usual pattern never lets a token cross from a non-space to white space, nor from a letter to a
mark, and looks ahead only within white space. So a cut before white space that follows a non-space, or before a mark that
follows a letter, is a cut of the encoding in every context. Texts are cut there in numpy; Arrow numbers the pieces of a batch, and
each new one is encoded once by the library. Marks that occur in added tokens are no cuts. Files of any other kind (normalizers,
other pre-tokenizers, added tokens with spaces) have no such cuts: their texts are encoded whole by the library.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from . import words

_ONE_SPACE = re.compile(r"[ \n]\S+")
#: Pieces held between batches, and the longest of them in bytes.
CACHE, LONGEST = 300_000, 200
#: Pieces that are encoded as one text, and bytes of text that are taken together.
JOINED, SLICE = 200, 4 << 20
_PRINT, _SPACE, _LETTER, _MARK, _HIGH = 1, 2, 4, 8, 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes(marks: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[0x21:0x7F] |= _PRINT
    out[[0x20, *range(0x09, 0x0E)]] |= _SPACE
    out[[*range(65, 91), *range(97, 123)]] |= _LETTER
    out[list(marks)] |= _MARK
    out[0x80:] |= _HIGH
    return out


def _dtype(vocab: dict[str, int]) -> np.dtype:
    return np.dtype("<u2" if max(vocab.values(), default=0) < 65536 else "<u4")


@functools.cache
def dtype(path: str) -> np.dtype:
    """Type of a tokenizer file's ids, for the driver: tasks that read ids alone need no tokenizer."""
    from tokenizers import Tokenizer

    return _dtype(Tokenizer.from_file(path).get_vocab(with_added_tokens=True))


class Encoder:
    """Ids of texts and texts of ids by a tokenizer file; ids are little-endian, two bytes where they fit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        added = self.tok.get_added_tokens_decoder()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f).get("pre_tokenizer") or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space", True)
        #: Whether the cuts described above hold.
        self.level = bool(plain) and self.tok.normalizer is None and not any(re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.dtype = _dtype(vocab)
        self._class = _classes(bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and not any(chr(b) in t.content for t in added.values())))
        self._added = {i: t.content.encode() for i, t in added.items()}
        self._vocab = vocab
        #: Whether a token starts with a space or break: those start the pieces of a text joined of pieces without further ones.
        self._starts = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self._starts[[i for t, i in vocab.items() if t.startswith(("\u0120", "\u010a")) and i not in self._added]] = True
        self._tables: dict[str, pa.Array] = {}
        self._lengths: np.ndarray | None = None
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self._slot: dict[bytes, int] = {}
        self._first, self._size, self._ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.dtype)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places in UTF-8 bytes at which every encoding is cut."""
        if not self.level or len(data) < 2:
            return np.zeros(0, dtype=np.int64)
        c = self._class[data]
        a, b = c[:-1], c[1:]
        at = np.flatnonzero((a & _PRINT) & (b >> 1) | (a >> 2) & (b >> 3) & 1 | (a & _HIGH) * (b & (_SPACE | _MARK)).astype(bool)) + 1
        odd = np.flatnonzero(data[at - 1] >= 0x80)
        if len(odd):
            i = at[odd]
            x, y, z = (data[np.maximum(i - k, 0)] for k in (3, 2, 1))
            space = (y == 0xC2) & np.isin(z, (0x85, 0xA0)) | (x == 0xE1) & np.isin(y, (0x9A, 0xA0)) | (x == 0xE2) & np.isin(y, (0x80, 0x81)) | (x == 0xE3) & (y == 0x80)
            letter = (y == 0xC3) & (z != 0x97) & (z != 0xB7)
            bad = np.where(c[i] & _SPACE, space, ~letter)
            at = np.delete(at, odd[bad])
        return at

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Encode new pieces; their slots, the last of which are those of pieces too long to hold. Those with one space or break, at their start, are encoded in joined texts."""
        texts = [x.decode() for x in new]
        plain = [i for i, x in enumerate(texts) if len(new[i]) <= LONGEST and _ONE_SPACE.fullmatch(x)]
        blocks = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        order, ids, sizes, left = [], [], [], []
        for own, got in zip(blocks, self._library(["".join(texts[i] for i in b) for b in blocks]), strict=True):
            at = np.flatnonzero(self._starts[got])
            if len(at) != len(own) or at[0]:
                left += own
                continue
            order += own
            ids.append(got)
            sizes.append(np.diff(np.append(at, len(got))))
        known = set(order)
        left = sorted((i for i in range(len(new)) if i not in known), key=lambda i: len(new[i]) > LONGEST)
        got = self._library([texts[i] for i in left])
        ids += got
        sizes.append(np.array([len(x) for x in got], dtype=np.int64))
        order += left
        size = np.concatenate(sizes)
        slots = np.empty(len(new), dtype=np.int64)
        slots[order] = np.arange(len(self._size), len(self._size) + len(new))
        self._first = np.concatenate([self._first, len(self._ids) + np.cumsum(size) - size])
        self._size = np.concatenate([self._size, size])
        self._ids = np.concatenate([self._ids, *ids])
        return slots

    def _trim(self, n: int) -> None:
        if n < len(self._size):
            self._ids = self._ids[: self._first[n]]
            self._first, self._size = self._first[:n], self._size[:n]

    def encode_bytes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges) of texts in UTF-8; bounds and edges have the places before each text, and the end."""
        if not self.level:
            own = self._library([data[a:b].tobytes().decode() for a, b in itertools.pairwise(bounds.tolist())])
            return np.concatenate([np.zeros(0, dtype=self.dtype), *own]), np.cumsum([0, *map(len, own)])
        if not len(data):
            return np.zeros(0, dtype=self.dtype), np.zeros(len(bounds), dtype=np.int64)
        if len(self._slot) > CACHE:  # frequent pieces came early
            keep = CACHE * 2 // 3
            self._slot = {k: v for k, v in self._slot.items() if v < keep}
            self._trim(keep)
        mask = np.zeros(len(data) + 1, dtype=bool)
        mask[self.cuts(data)] = mask[bounds] = True
        at = np.flatnonzero(mask)
        pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        each = pieces.dictionary.to_pylist()
        get = self._slot.get
        slots = np.array([get(x, -1) for x in each], dtype=np.int64)
        new, known = np.flatnonzero(slots < 0), len(self._size)
        if len(new):
            own = [each[i] for i in new.tolist()]
            slots[new] = self._learn(own)
            self._slot.update((x, s) for x, s in zip(own, slots[new].tolist(), strict=True) if len(x) <= LONGEST)
            known += sum(len(x) <= LONGEST for x in own)
        slots = slots[pieces.indices.to_numpy()]
        size = self._size[slots]
        ends = np.cumsum(size)
        place = np.repeat(self._first[slots] - ends + size, size)
        place += np.arange(len(place))
        ids = self._ids[place]
        edges = np.concatenate([[0], ends])[np.searchsorted(at, bounds)]
        self._trim(known)  # what is too long to hold stands last
        return ids, edges

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [x.encode() for x in texts]
        bounds = np.cumsum([0, *map(len, raw)])
        data, out = np.frombuffer(b"".join(raw), dtype=np.uint8), []
        for i, j in words.spans(bounds, SLICE):
            ids, edges = self.encode_bytes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            out += [ids[a:b].tobytes() for a, b in itertools.pairwise(edges.tolist())]
        return out

    def table(self) -> list[bytes]:
        """Bytes of each id."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        out = [b""] * len(self._starts)
        for token, i in self._vocab.items():
            out[i] = bytes(back[c] for c in token) if i not in self._added and all(c in back for c in token) else token.encode()
        return out

    def _spelled(self, ids: np.ndarray, edges: np.ndarray, kind: str) -> list[memoryview]:
        """Of each text the joined entries of a table for its ids."""
        if kind not in self._tables:
            own = self.table() if kind == "bytes" else [b"%d," % i for i in range(len(self._starts))]
            self._tables[kind] = pa.array(own, pa.large_binary())
        got = self._tables[kind].take(pa.array(ids))
        _, at, data = got.buffers()
        at = np.frombuffer(at, dtype=np.int64)[got.offset + edges].tolist() if len(ids) else [0] * len(edges)
        data = memoryview(b"" if data is None else data).cast("B")  # an Arrow buffer has signed bytes, unequal to any bytes from 128 on
        return [data[a:b] for a, b in itertools.pairwise(at)]

    def spelled(self, ids: np.ndarray, edges: np.ndarray) -> list[memoryview]:
        """Bytes that the ids of each text stand for."""
        return self._spelled(ids, edges, "bytes")

    def lengths(self) -> np.ndarray:
        """Number of bytes of each id."""
        if self._lengths is None:
            self._lengths = np.array([len(x) for x in self.table()], dtype=np.int64)
        return self._lengths

    def listed(self, ids: np.ndarray, edges: np.ndarray) -> list[memoryview]:
        """Decimal ids of each text, joined by commas, with one at the end."""
        return self._spelled(ids, edges, "decimal")

    def decoded(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """UTF-8 of each decoded text, special tokens included."""
        if self.tok.decoder is None or type(self.tok.decoder).__name__ != "ByteLevel":
            return [self.tok.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in itertools.pairwise(edges.tolist())]
        return [bytes(x).decode("utf-8", "replace").encode() for x in self._spelled(ids, edges, "bytes")]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decoded(ids.astype(self.dtype), np.array([0, len(ids)]))[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 65536, dtype=np.uint64)


def cut_points(values: np.ndarray, mean: int, least: int, most: int, window: int = 32) -> list[int]:
    """Ends of content-defined chunks of a stream of bytes or two-byte units: where a rolling hash
    of the last window values has zero low bits, not before least values, and after most at the latest."""
    n = len(values)
    if n == 0:
        return []
    h = _GEAR[values if values.dtype.itemsize <= 2 else values & 0xFFFF]
    width = 1
    while width < window:
        before = h[:-width] << np.uint64(1)
        before *= np.uint64(2 * width + 1)
        h[width:] += before
        width *= 2
    shift = np.uint64(64 - int(mean).bit_length() + 1)
    ends = np.flatnonzero((h >> shift) == 0) + 1
    out, at = [], 0
    for e in ends.tolist():
        if e - at < least:
            continue
        while e - at > most:
            at += most
            out.append(at)
        if e - at >= least or not out:
            out.append(e)
            at = e
    while n - at > most:
        at += most
        out.append(at)
    if at < n:
        out.append(n)
    return out


def cut_many(values: np.ndarray, bounds: np.ndarray, mean: int, least: int, most: int, window: int = 32) -> list[list[int]]:
    """cut_points of each stream in values, of which bounds has the edges, with one hash of them all.

    Cuts need least values before them, at least a window, so no hash that reaches into the stream before counts."""
    if least < window:
        raise ValueError("least must be a window at least")
    if not len(values):
        return [[] for _ in bounds[:-1]]
    h = _GEAR[values if values.dtype.itemsize <= 2 else values & 0xFFFF]
    width = 1
    while width < window:
        before = h[:-width] << np.uint64(1)
        before *= np.uint64(2 * width + 1)
        h[width:] += before
        width *= 2
    ends = np.flatnonzero((h >> np.uint64(64 - int(mean).bit_length() + 1)) == 0) + 1
    edges = np.searchsorted(ends, bounds, side="right")
    ends, out = ends.tolist(), []
    for i in range(len(bounds) - 1):
        begin, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
        own, at = [], 0
        for e in ends[edges[i] : edges[i + 1]]:
            e -= begin
            while e - at > most:
                at += most
                own.append(at)
            if e - at >= least:
                own.append(e)
                at = e
        while n - at > most:
            at += most
            own.append(at)
        if at < n:
            own.append(n)
        out.append(own)
    return out
