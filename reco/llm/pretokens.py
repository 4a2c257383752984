"""Texts cut into chunks that a byte-level BPE encodes independently.

With the split pattern of ``public_tokenizers.PATTERN`` a match never runs on
from a non-space into a following space, so a text cut before each run of white
space encodes to the encodings of its pieces, one after the other.  Pieces
repeat, so each worker keeps the ids of those it has met (a bounded table).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WHITE_RUN = re.compile(f"[{WHITE}][{WHITE}]")
MARK = "\x1f"        # cuts; a text that has it takes the slower way
PIECE = 1 << 20      # characters of a text handled at once
CACHE = 600_000      # chunks whose ids a worker keeps, about 0.12 GB
LONG = 64            # characters of the longest chunk worth keeping


def chunks(text: str) -> list[str]:
    """The chunks of a text, whose concatenation is the text."""
    if MARK in text or WHITE_RUN.search(text):
        return CHUNK.findall(text)
    return [c for c in text.replace("\n", f"{MARK}\n{MARK}").replace(" ", f"{MARK} ").split(MARK) if c]


def pieces(text: str) -> Iterator[list[str]]:
    """Chunks of a long text, about ``PIECE`` characters at a time."""
    if len(text) <= PIECE:
        yield chunks(text)
        return
    held: list[str] = []
    size = 0
    for m in CHUNK.finditer(text):
        held.append(m[0])
        size += len(m[0])
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


class ChunkTable:
    """Chunk -> packed ids, filled by ``encode`` (a list of chunks -> a list of bytes)."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE):
        self.encode, self.limit, self.known = encode, limit, {}

    def ids(self, lists: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of chunks; what is missing of all of them
        is encoded in one call."""
        used = set().union(*lists)
        new = [c for c in used if c not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known = {c: self.known[c] for c in used if c in self.known}
        self.known.update(zip(new, self.encode(new)))
        out = [b"".join(map(self.known.__getitem__, parts)) for parts in lists]
        for c in new:
            if len(c) > LONG:
                del self.known[c]
        return out

    def stream(self, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, packed ids) in order, at least once a text; a
        long text comes in several parts, short ones are encoded together."""
        at: list[int] = []
        lists: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in pieces(text or ""):
                at.append(i)
                lists.append(part)
                size += min(len(text or ""), PIECE)
                if size >= PIECE:
                    yield from zip(at, self.ids(lists))
                    at, lists, size = [], [], 0
        yield from zip(at, self.ids(lists))
