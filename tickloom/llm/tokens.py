"""Token ids of whole texts, by the tokenizers library.

A text is cut only where the pre-tokenizer always starts a new piece: before
ASCII white space that follows another character, after a lone line feed
between visible characters, and before a comma or full stop that follows a
letter. Distinct pieces go through the library once and are kept (a bounded
table in each Python worker); the ids of a document are the ids of its pieces
in order. The bytes of a piece are its key, so no hash decides equality. The
literal text of an added token is a piece of its own and gets that token's id,
as the library does with its own settings.
"""

from __future__ import annotations

import contextlib
import os
import re

import numpy as np

from tickloom.llm.common import trim

KEEP = 500_000  # pieces a worker keeps before it starts again, some 55 MB
_WIDE = 23  # longest piece, in bytes, that the vector path handles
_TABLE = 1 << 21

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: visible bytes stand for themselves, the others
    for code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Encodes byte buffers of many documents at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.names = _byte_names()
        added = [t for t in self.lib.get_added_tokens_decoder().values()]
        if any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens that take white space or need word ends are not supported")
        literal = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, literal))) if literal else None
        self.reset()

    def reset(self) -> None:
        """Forget the pieces met so far."""
        self.slot: dict[bytes, int] = {}
        self.table = np.zeros(_TABLE, np.int32)
        self.keys = np.zeros((1 << 16, 3), np.uint64)
        self.count = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint16 if self.lib.get_vocab_size() < 1 << 16 else np.uint32)
        self.used, self.filled = 1, 0  # slot 0 stays empty

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Slots of new pieces. A piece that is one word is one pre-token and goes
        to the library's model directly."""
        flat: list[int] = []
        counts = []
        tokenize, names, space = self.model.tokenize, self.names, self.names[0x20]
        for p in pieces:
            text = p.decode()
            if _WORD.fullmatch(text):
                named = text.replace(" ", space) if text.isascii() else p.decode("latin-1").translate(names)
                got = [t.id for t in tokenize(named)]
            else:
                got = self.lib.encode(text, add_special_tokens=False).ids
            flat += got
            counts.append(len(got))
        n, m = len(pieces), len(flat)
        while self.used + n > len(self.count):
            self.count, self.start = np.resize(self.count, 2 * len(self.count)), np.resize(self.start, 2 * len(self.start))
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        while self.filled + m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + m] = flat
        at = np.arange(self.used, self.used + n)
        self.count[at] = counts
        self.start[at] = self.filled + np.cumsum(counts) - counts
        self.used += n
        self.filled += m
        return at

    def _literals(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """Where the text of an added token stands within one document."""
        if self.added is None:
            return []
        found, at, data = [], 0, memoryview(np.ascontiguousarray(buf))
        while m := self.added.search(data, at):
            doc = int(np.searchsorted(off, m.start(), "right")) - 1
            inside = m.end() <= off[doc + 1]
            if inside:
                found.append(m.span())
            at = m.end() if inside else m.start() + 1
        return found

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and where each starts (documents + 1)."""
        n = len(buf)
        if not n:
            return np.zeros(0, self.pool.dtype), np.zeros(len(off), np.int64)
        if self.used > KEEP:
            self.reset()
        shown = _VISIBLE[buf] | (buf == 0xC3)  # C3 leads letters only
        cut = np.zeros(n + 1, bool)
        after = np.zeros(n, bool)  # the character before is visible
        after[1:] = _VISIBLE[buf[:-1]]
        after[2:] |= buf[:-2] == 0xC3
        cut[:n] = _SPACE[buf] & after
        cut[1:n] |= (buf[:-1] == 10) & after[:-1] & shown[1:]  # a lone line feed
        cut[1:n] |= ((buf[1:] == 0x2C) | (buf[1:] == 0x2E)) & _LETTER[buf[:-1]]
        cut[off] = True
        for a, b in self._literals(buf, off):
            cut[a:b] = False
            cut[[a, b]] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        size = ends - starts
        pad = np.zeros(n + 32, np.uint8)
        pad[:n] = buf
        view = np.ndarray((n + 24,), "<u8", pad.data, 0, (1,))
        k0 = view[starts] & _MASKS[np.minimum(size, 8)]
        k1 = view[starts + 8] & _MASKS[np.clip(size - 8, 0, 8)]
        k2 = (view[starts + 16] & _MASKS[np.clip(size - 16, 0, 8)]) if n > 16 else np.zeros(len(starts), np.uint64)
        k2 |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        with np.errstate(over="ignore"):
            h = k0 * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) + k1 * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) + k2 * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            cell = (h >> np.uint64(43)).astype(np.int64)
        of = self.table[cell].astype(np.int64)
        key = self.keys[of]
        hit = (key[:, 0] == k0) & (key[:, 1] == k1) & (key[:, 2] == k2) & (size <= _WIDE)
        miss = np.flatnonzero(~hit)
        if len(miss):
            data = buf.tobytes()
            met = [data[i:j] for i, j in zip(starts[miss].tolist(), ends[miss].tolist())]
            new = {p: k for k, p in enumerate(met) if p not in self.slot}  # piece: one of its places
            at = miss[np.fromiter(new.values(), np.int64, len(new))]
            got = self._learn(list(new)) if new else np.zeros(0, np.int64)
            here = dict(zip(new, got.tolist()))
            of[miss] = [here[p] if p in here else self.slot[p] for p in met]
            short = size[at] <= _WIDE
            self.keys[got[short]] = np.stack([k0[at[short]], k1[at[short]], k2[at[short]]], axis=1)
            # A cell keeps its first piece; other pieces, and wide ones, go by the dictionary.
            self.table[cell[at[short]]] = np.where(self.table[cell[at[short]]] == 0, got[short], self.table[cell[at[short]]])
            rest = ~short | (self.table[cell[at]] != got)
            self.slot.update((p, g) for p, g, on in zip(new, got.tolist(), rest.tolist()) if on)
        cnt = self.count[of].astype(np.int64)
        end = np.cumsum(cnt)
        total = int(end[-1]) if len(end) else 0
        ids = self.pool[np.repeat(self.start[of] - (end - cnt), cnt) + np.arange(total)]
        upto = np.append(0, end)[np.searchsorted(starts, off)]
        return ids, upto


_ENCODERS: dict[str, Encoder] = {}


@contextlib.contextmanager
def encoder(path: str):
    """The worker's encoder for a vocabulary file. Its pieces stay for the next
    task, KEEP at most."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    try:
        yield _ENCODERS[path]
    finally:
        trim()
