"""Ids of whole texts, chunk by chunk, on Arrow arrays.

A batch of texts is cut into the chunks of ``pretokens`` by Arrow's string
functions and dictionary-encoded, so that Python looks at each distinct chunk
of a batch once; the ids of all its texts are then one gather from the ids of
the distinct chunks.  Chunks met before are kept in two generations: what the
younger lacks is taken over from the older, and when the younger is full it
becomes the older.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reco.llm.pretokens import CHUNK, LONG, MARK, WHITE, pieces

BATCH = 1 << 23      # characters cut at once
HELD = 300_000       # chunks of a generation
#: Texts that need the chunk pattern: two white characters in a row, white
#: space other than space and line break, or the mark.
ODD = "[ \n][ \n]|[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE if c not in " \n") + f"\\x{{{ord(MARK):x}}}]"


class ChunkIds:
    """``encode`` gives the packed little-endian ``uint32`` ids of a list of
    chunks, and may look at ``known`` for those of parts of them."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], held: int = HELD):
        self.encode, self.held = encode, held
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def known(self, chunk: str) -> bytes | None:
        got = self.young.get(chunk)
        return self.old.get(chunk) if got is None else got

    def _packed(self, chunks: list[str]) -> list[bytes]:
        if len(self.young) > self.held:
            self.young, self.old = {"": b""}, self.young
        young = self.young
        missing = [c for c, p in zip(chunks, map(young.get, chunks)) if p is None]
        older = list(map(self.old.get, missing))
        young.update((c, p) for c, p in zip(missing, older) if p is not None)
        new = [c for c, p in zip(missing, older) if p is None]
        if new:
            young.update(zip(new, self.encode(new)))
        out = list(map(young.__getitem__, chunks))
        for c in new:
            if len(c) > LONG:
                del young[c]
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        lists = _cut(texts)
        words = lists.flatten().dictionary_encode()
        packed = self._packed(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        pool = np.frombuffer(b"".join(packed), "<u4")
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start, at = np.cumsum(size) - size, words.indices.to_numpy()
        sizes = size[at]
        ends = np.append(0, np.cumsum(sizes))
        out = pool[np.repeat(start[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def stream(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids) in order, at least once a text; a long
        text comes in several parts, short ones are cut together."""
        at: list[int] = []
        held: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            text = text or ""
            for part in [text] if len(text) <= BATCH else map("".join, pieces(text)):
                at.append(i)
                held.append(part)
                size += len(part)
                if size >= BATCH:
                    yield from zip(at, self.ids(held))
                    at, held, size = [], [], 0
        if held:
            yield from zip(at, self.ids(held))


def _cut(texts: list[str]) -> pa.ListArray:
    """The chunks of each text; some are empty."""
    a = pa.array(texts, pa.string())
    odd = pc.match_substring_regex(a, ODD).to_numpy(zero_copy_only=False)
    plain = a.filter(pa.array(~odd)) if odd.any() else a
    cut = pc.replace_substring(pc.replace_substring(plain, "\n", f"{MARK}\n{MARK}"), " ", f"{MARK} ")
    lists = pc.split_pattern(cut, MARK)
    if not odd.any():
        return lists
    rest = pa.array([CHUNK.findall(texts[i]) for i in np.flatnonzero(odd)], pa.list_(pa.string()))
    place = np.empty(len(texts), np.int64)
    place[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
    return pa.concat_arrays([lists, rest]).take(pa.array(place))
