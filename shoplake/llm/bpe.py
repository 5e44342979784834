"""Byte-level BPE ids of whole texts, with a bounded memory of units already met."""

from __future__ import annotations

import base64
import re
import struct

import numpy as np

#: The code points of the Unicode property White_Space.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WS = "".join(map(chr, _SPACES))
#: A unit is what the vocabulary's own pattern never looks across: an optional
#: space with a run of other characters, or white space as that pattern cuts it.
_UNIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class Encoder:
    """Texts to ids, equal to ``tokenizers`` on the JSON file of the same vocabulary.

    Units repeat a lot, so most are looked up; only new ones go through BPE.
    The memory holds the first ``max_units`` units of at most ``max_unit``
    characters, among which the frequent ones are.
    """

    def __init__(self, path: str, pattern: str, max_units: int = 400_000, max_unit: int = 40):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self._bpe = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        if max(ranks.values()) > 65535:
            raise ValueError("ids are kept in 16 bits")
        self._known: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}  # words, each standing for itself after a space
        self._feed = self._ids("\n")
        self._max_units, self._max_unit = max_units, max_unit
        #: Whether an id's bytes begin with a space.
        self.spaces = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.spaces[[i for b, i in ranks.items() if b.startswith(b" ")]] = True

    def _ids(self, unit: str) -> bytes:
        ids = self._bpe.encode_ordinary(unit)
        return struct.pack(f"<{len(ids)}H", *ids)

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text in which few units repeat, without looking them up."""
        return np.array(self._bpe.encode_ordinary(text), dtype=np.int64)

    def unit(self, unit: str) -> bytes:
        ids = self._ids(unit)
        if len(self._known) < self._max_units // 4 and len(unit) <= self._max_unit:
            self._known[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids."""
        if len(text.split()) != text.count(" ") + text.count("\n") + 1:
            known, unit = self._known.get, self.unit
            return b"".join([known(u) or unit(u) for u in _UNIT.findall(text)])
        # Single spaces and line feeds only: every word but the first of a line takes the space before it.
        spaced, found = self._spaced, []
        for k, line in enumerate(text.split("\n")):
            if k:
                found.append(self._feed)
            words = line.split(" ")
            if words[0]:
                found.append(self._known.get(words[0]) or self.unit(words[0]))
            del words[0]
            got = list(map(spaced.get, words))
            if None in got:
                got = [self.spaced(w) if g is None else g for w, g in zip(words, got)]
            found += got
        return b"".join(found)

    def spaced(self, word: str) -> bytes:
        ids = self._spaced[word] if word in self._spaced else self._ids(" " + word)
        if len(self._spaced) < self._max_units and len(word) <= self._max_unit:
            self._spaced[word] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    """One encoder per Python worker and vocabulary; ``name`` is a public vocabulary or a path to a rank file."""
    if name not in _encoders:
        import public_tokenizers as public

        path = name if "/" in name else public.path(f"{name}.tiktoken")
        _encoders[name] = Encoder(path, public.PATTERN)
    return _encoders[name]
