"""Token ids by the ``tokenizers`` library, once for each distinct piece of text.

Both kinds of vocabulary here cut a text before they merge bytes, and every cut
of ours is one of theirs: visible text never joins the white space after it, and
in texts of plain characters runs of letters, of digits and of signs stand
apart (words with an apostrophe stay whole, for contractions). So the ids of a
text are those of its pieces, one after the other. A text with white space other
than the space and the line feed, or with one of the vocabulary's special
strings, goes to the library whole. Pieces are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np

from quarrylight.llm.common import _BYTE_EXACT, _GAMMA, CHUNK, Hasher, groups_of_texts, mix64, word_ranges

#: White space other than the space and the line feed; U+180E was some once.
_ODD_SPACE = re.compile("[^\\S \n]|᠎")
#: Byte classes of plain text: 0 white space, 1 letter, 2 digit, 3 sign, 9 not plain.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[[10, 32]] = 0
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[0x80:0xC0] = _CLASS[0xC3] = 1  # letters of U+00C0 to U+00FF, two bytes each
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER[0x80:0x9F] += 32
_BYTE_LOWER = mix64((_LOWER.astype(np.uint64) + np.uint64(1)) * _GAMMA)


class PieceEncoder:
    """Encodes texts; keeps the ids of up to ``limit`` pieces that it has met.

    The store only saves work: when it is full it is emptied and filled anew.
    """

    SLOTS = 21

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = min(limit, 1 << (self.SLOTS - 1))
        self.lowers = self.tokenizer.normalizer is not None
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)), re.IGNORECASE) if specials else None
        # in joined pieces: a token that ends a piece, or one that begins it with its space
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.mark = np.array([n.endswith("</w>") if self.lowers else n.startswith("Ġ") for n in names])
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.SLOTS, np.uint64)
        self.values = np.zeros(1 << self.SLOTS, np.int32)
        self.start = np.zeros(self.limit, np.int32)
        self.length = np.zeros(self.limit, np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.known = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for those not known."""
        slot = (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == h, self.values[slot], -1).astype(np.int64)
        left = np.flatnonzero((found != h) & (found != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.SLOTS) - 1)
            found = self.keys[slot[left]]
            hit = found == h[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != 0)]
        return out

    def _insert(self, h: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are not there, each once."""
        slot = (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]] = h[put]
            self.values[slot[put]] = values[put]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.SLOTS) - 1)

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces. Runs of letters are joined to long texts, as
        a call has its price; marks in the vocabulary part them again."""
        easy = [p.isalpha() if self.lowers else (p[0] == " " and p[1:].isalpha()) for p in pieces]
        ids: list[np.ndarray] = [None] * len(pieces)
        rows = [i for i, e in enumerate(easy) if e]
        for k in range(0, len(rows), 1000):
            some = rows[k : k + 1000]
            joined = (" " if self.lowers else "").join([pieces[i] for i in some])
            got = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(self.mark[got]) + self.lowers
            parts = np.split(got, at[:-1] if self.lowers else at[1:])
            if len(parts) != len(some) or (not self.lowers and at[0] != 0):
                parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)]
            for i, part in zip(some, parts, strict=True):
                ids[i] = part
        rows = [i for i, e in enumerate(easy) if not e]
        for i, e in zip(rows, self.tokenizer.encode_batch_fast([pieces[i] for i in rows], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, np.uint32)
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        ids, lengths = self._encode_new(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        numbers = np.arange(self.known, self.known + len(pieces))
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self._insert(h, numbers)
        self.known += len(pieces)
        self.used += len(ids)

    def _ranges(self, part: np.ndarray, borders: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of texts that meet at ``borders``."""
        kind = _CLASS[part]
        if not plain:
            kind = (kind > 0).view(np.uint8)
        cut = np.ones(len(part) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        if self.lowers and plain:
            cut[:-1] |= kind == 2  # each digit by itself
        quotes = np.flatnonzero(part == 39) if plain else ()
        if len(quotes):
            s, e = word_ranges(part, borders)
            for w in np.unique(np.searchsorted(s, quotes, "right") - 1):
                cut[s[w] + 1 : e[w]] = False
        if not self.lowers:  # white space goes with what follows
            cut[1:-1] &= ~((kind[:-1] == 0) & (kind[1:] != 0))
        cut[borders] = True
        at = np.flatnonzero(cut)
        s, e = at[:-1], at[1:]
        if self.lowers:
            visible = kind[s] != 0
            s, e = s[visible], e[visible]
        return s, e

    def _encode(self, data: np.ndarray, borders: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(borders) - 1, np.int64)
        s, e = self._ranges(data, borders, plain)
        h = Hasher(data, _BYTE_LOWER if self.lowers and plain else _BYTE_EXACT).of(s, e)
        h |= np.uint64(1)  # 0 marks a free slot
        if not plain:
            h ^= np.uint64(0x5555555555555554)  # keys of another kind
        number = self._find(h)
        if (number < 0).any():
            new, first = np.unique(h[number < 0], return_index=True)
            if self.known + len(new) > self.limit:
                self._clear()
                new, first = np.unique(h, return_index=True)
                at = first
            else:
                at = np.flatnonzero(number < 0)[first]
            raw = data.tobytes()
            for k in range(0, len(new), self.limit):  # more than the store holds: only in a text of that many pieces
                if k:
                    return self._whole(raw, borders)
                some = slice(k, k + self.limit)
                pieces = [raw[a:b].decode() for a, b in zip(s[at[some]].tolist(), e[at[some]].tolist(), strict=True)]
                self._learn(new[some], [p.lower() for p in pieces] if self.lowers and plain else pieces)
            number = self._find(h)
            if (number < 0).any():
                return self._whole(raw, borders)
        lengths = self.length[number].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[number] - (ends - lengths), lengths) + np.arange(total)]
        piece_at = np.searchsorted(s, borders, "left")
        return ids, np.diff(np.concatenate([[0], ends])[piece_at])

    def _whole(self, raw: bytes, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(borders[:-1], borders[1:], strict=True)]
        return np.concatenate(got), np.array([len(x) for x in got])

    def _kind(self, text: np.ndarray) -> int:
        """0: plain, 1: cut at white space only, 2: encode whole."""
        kind = _CLASS[text]
        strange = (kind == 9).any()
        if not strange:
            high = np.flatnonzero(text == 0xC3)
            strange = len(high) and np.isin(text[high + 1], (0x97, 0xB7)).any() or (text >= 0x80).sum() != 2 * len(high)
        if not strange and not (self.special and (text == 60).any()):
            return 0
        said = text.tobytes().decode()
        if _ODD_SPACE.search(said) or (self.special and self.special.search(said)):
            return 2
        return int(bool(strange))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of UTF-8 texts, one text after the other, and how many each has."""
        ids, counts = [], []
        for i, j in groups_of_texts(offsets, 4 * CHUNK):
            lo, hi = int(offsets[i]), int(offsets[j])
            part, borders = data[lo:hi], offsets[i : j + 1] - lo
            kind = _CLASS[part]
            if (kind == 9).any() or (self.special and (part == 60).any()) or (part >= 0x80).any() and self._kind(part):
                for a, b in zip(borders[:-1], borders[1:], strict=True):
                    text = part[a:b]
                    k = self._kind(text) if len(text) else 0
                    x, n = self._whole(text.tobytes(), np.array([0, len(text)])) if k == 2 else self._encode(text, np.array([0, len(text)]), k == 0)
                    ids.append(x)
                    counts.append(n)
            else:
                x, n = self._encode(part, borders, True)
                ids.append(x)
                counts.append(n)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This process's encoder for a vocabulary file, kept from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
