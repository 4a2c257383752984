"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

The vocabulary goes into blocked Bloom filters, one for each word length, of
64-bit blocks that a word sets ``PROBES`` bits in.  Every word's edits are
generated as hashes, not as strings: a word's hash is a polynomial in its code
points, so that of an edit follows from it by a few operations on whole numpy
arrays.  Edits that the filters reject are gone at once; the few others are
spelled out, shuffled, and joined to the vocabulary itself, which removes the
filters' false positives.  A pair is generated once, from its longer word (by a
deletion) or, for words of one length, from the one with the smaller letter; an
insertion is the other word's deletion.

The filters' size follows the vocabulary; they are broadcast in parts of at
most ``PART_BLOCKS`` blocks (32 MB), one pass over the words for each part, so
that a vocabulary of any size is covered with the same few false positives.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reco.llm.common import on_executors, stored

LETTERS = "A-Za-zÀ-ÿ"
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint64)     # after A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, LEAD = 6, 5, 5
BITS = 24                # of a filter for each word
PROBES = 4
PART_BLOCKS = 1 << 22
SLICE = 4096             # blocks that one task's group packs
WORDS_A_TASK = 1 << 15
CELLS = 1 << 16          # edits handled at once
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``id, word``: the maximal runs of ``min_chars`` letters or more of whole
    texts, only A-Z lower-cased.  Null text: none."""
    runs = F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(f"([{LETTERS}]{{{min_chars},}})"), F.lit(1))
    return (docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("w"))
            .select("id", F.translate("w", UPPER, LOWER).alias("word")))


def with_slips(occurrences: DataFrame, every: int = 199) -> DataFrame:
    """``word`` with letters dropped: where ``every`` divides the CRC-32 of
    ``id:word`` (null id: empty), the code point at the CRC modulo the length
    is deleted."""
    crc = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    d = occurrences.select("word", crc.alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    return d.select(F.when(F.col("h") % every == 0, F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word"))))
                    .otherwise(F.col("word")).alias("word"))


def vocabulary(occurrences: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words long and frequent enough (a partial count in
    each map task)."""
    return (occurrences.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def _by_length(ws: list[str]):
    """(length, numbers of the words, code points as a matrix) for each length,
    a bounded number of code points at a time."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(ws):
        groups.setdefault(len(w), []).append(i)
    for length, all_ in groups.items():
        step = max(1, CELLS // max(length, len(ALPHABET)))
        for at in range(0, len(all_), step):
            some = all_[at:at + step]
            m = np.array([ws[i] for i in some], dtype=f"U{length}").view(np.uint32).reshape(len(some), length)
            yield length, some, m.astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    return np.array(list(accumulate(range(1, length), lambda p, _: p * BASE % (1 << 64), initial=1)), np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Layout:
    """Where the blocks of each length's filter lie in one row of blocks."""

    def __init__(self, counts: dict[int, int]):
        self.start, self.blocks, at = {}, {}, 0
        for length in sorted(counts):
            self.start[length] = at
            self.blocks[length] = min((1 << 32) - 1, -(-counts[length] * BITS // 64))
            at += self.blocks[length]
        self.total = at

    def places(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, bits to be set) of word hashes of one length."""
        h = _mixed(hashes)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks[length]) >> np.uint64(32)) + np.uint64(self.start[length])
        mask = np.zeros_like(h)
        for k in range(PROBES):
            mask |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
        return block, mask


def _filters(vocab: DataFrame, layout: Layout, first: int, n: int) -> np.ndarray:
    """Blocks ``first`` to ``first + n``, at most ``PART_BLOCKS``, packed in
    tasks by slices of neighbouring blocks."""
    def place(batches):
        for b in batches:
            ws = b.column("word").to_pylist()
            for length, _, m in _by_length(ws):
                block, mask = layout.places(length, (m * _powers(length)).sum(1, dtype=np.uint64))
                here = (block >= first) & (block < first + n)
                at = (block[here] - np.uint64(first)).astype(np.int64)
                yield pa.record_batch({"slice": pa.array((at // SLICE).astype(np.int32)), "at": pa.array((at % SLICE).astype(np.int32)),
                                       "mask": pa.array(mask[here].view(np.int64))})

    def pack(table: pa.Table) -> pa.Table:
        out = np.zeros(SLICE, np.uint64)
        np.bitwise_or.at(out, table.column("at").to_numpy(), table.column("mask").to_numpy().view(np.uint64))
        return pa.table({"slice": table.column("slice").slice(0, 1), "blocks": [out.tobytes()]})

    rows = (vocab.select("word").mapInArrow(place, "slice int, at int, mask long")
            .groupBy("slice").applyInArrow(pack, "slice int, blocks binary").collect())      # 8 bytes a block
    out = np.zeros(-(-n // SLICE) * SLICE, np.uint64)
    for r in rows:
        out[r.slice * SLICE:(r.slice + 1) * SLICE] = np.frombuffer(r.blocks, np.uint64)
    return out


def _found(layout: Layout, blocks: np.ndarray, first: int, n: int, length: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes of words of one length this part of the filters lets through."""
    if length not in layout.start or layout.start[length] >= first + n or layout.start[length] + layout.blocks[length] <= first:
        return np.zeros(hashes.shape, bool)
    block, mask = layout.places(length, hashes)
    at = block - np.uint64(first)           # wraps below `first`
    here = at < np.uint64(n)
    return here & ((blocks[np.where(here, at, np.uint64(0)).astype(np.int64)] & mask) == mask)


def edits(layout: Layout, blocks: np.ndarray, first: int, n: int, length: int, m: np.ndarray):
    """(row, edit position, letter or -1 for a deletion) arrays of the edits of
    words of one length that the filters let through.  A repeated letter is
    deleted once; a letter is replaced by larger ones only."""
    power = _powers(length)
    terms = m * power
    whole = terms.sum(1, dtype=np.uint64)
    before = np.zeros(len(m), np.uint64)
    for i in range(length):
        after = whole - before - terms[:, i]
        hit = _found(layout, blocks, first, n, length - 1, before + after * np.uint64(INVERSE))
        if i:
            hit &= m[:, i] != m[:, i - 1]
        if hit.any():
            rows = np.flatnonzero(hit)
            yield rows, i, np.full(len(rows), -1, np.int64)
        rest = whole - terms[:, i]
        hit = _found(layout, blocks, first, n, length, rest[:, None] + ALPHABET[None, :] * power[i])
        hit &= ALPHABET[None, :] > m[:, i, None]
        if hit.any():
            rows, letters = np.nonzero(hit)
            yield rows, i, ALPHABET[letters].astype(np.int64)
        before = before + terms[:, i]


def near_pairs(vocab: DataFrame, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """``word, n, other, other_n``: every pair of words of the vocabulary
    (stored, distinct, made of ``ALPHABET``) one edit apart, once."""
    spark = vocab.sparkSession
    counts = {r[0]: r[1] for r in vocab.groupBy(F.length("word")).count().collect()}     # a row a length
    layout, total = Layout(counts), sum(counts.values())
    on_executors(spark)
    dealt = vocab.repartition(max(1, -(-total // WORDS_A_TASK)))
    found = None
    for first in range(0, layout.total, part_blocks):
        size = min(part_blocks, layout.total - first)
        held = spark.sparkContext.broadcast(_filters(vocab, layout, first, size))

        def probe(batches, held=held, first=first, size=size):
            for b in batches:
                ws, ns = b.column("word").to_pylist(), b.column("n").to_numpy()
                for length, some, m in _by_length(ws):
                    word, n, other = [], [], []
                    for rows, i, letters in edits(layout, held.value, first, size, length, m):
                        for r, c in zip(rows.tolist(), letters.tolist()):
                            w = ws[some[r]]
                            word.append(w)
                            n.append(ns[some[r]])
                            other.append(w[:i] + (chr(c) if c >= 0 else "") + w[i + 1:])
                    yield pa.record_batch({"word": pa.array(word, pa.string()), "n": pa.array(n, pa.int64()), "other": pa.array(other, pa.string())})

        part = dealt.mapInArrow(probe, "word string, n long, other string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vocab.select("word", "n", F.lit("").alias("other")).limit(0)
    exact = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.join(exact, "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, form`` -> ``word, root``: the last word on the way of forms, by
    pointer doubling.  Counts rise at every step, so ways end, and their length
    grows with the logarithm of the largest count."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        a, b = at.alias("a"), at.alias("b")
        j = a.join(b, F.col("a.root") == F.col("b.word"), "left")
        new = stored(j.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return at


def variants(occurrences: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, lead: int = LEAD,
             part_blocks: int = PART_BLOCKS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``occurrences``
    (a column ``word`` of letters of ``ALPHABET``) that has ``min_chars`` code
    points and ``min_count`` occurrences.

    Two words are near if one inserted, deleted or replaced code point tells
    them apart.  A word's form is the near word with the largest count (ties:
    the smallest in code point order), if that is ``lead`` times its own; else
    null, as is ``form_n``.  The root follows forms to the last word.  Repeated
    rows are occurrences of their own; null words count for nothing; words of
    any length are compared whole; no words, no rows.
    """
    vocab = stored(vocabulary(occurrences, min_chars, min_count), "vocabulary")
    pairs = near_pairs(vocab, part_blocks)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("word"), F.col("n"), F.col("other"), F.col("other_n")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p")).select("p.*")
    near = stored(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"),
                                           F.min(F.struct((-F.col("other_n")).alias("k"), "other")).alias("top"))
                  .select("word", "n_near", F.when(-F.col("top.k") >= F.col("n") * lead, F.col("top.other")).alias("form"),
                          F.when(-F.col("top.k") >= F.col("n") * lead, -F.col("top.k")).alias("form_n")), "near-words")
    ends = roots(near.filter(F.col("form").isNotNull()))
    return (vocab.join(near, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
