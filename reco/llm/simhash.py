"""SimHash near-duplicates by exact tiled comparison.

Fingerprints: 64 bits, each 1 if set in over half the XXH64 hashes of a text's
word shingles.  All pairs of distinct fingerprints within ``radius`` bits are
found exactly.  If two fingerprints differ in at most ``radius`` bits and the 64
bits are cut into ``parts`` runs, at least ``parts - radius`` runs are equal,
so equality on some choice of that many runs assigns every linked pair to a
common block: nothing is lost.  The number of runs and key bits follows from
the number of fingerprints, so that a block stays near ``BLOCK`` of them
whatever the input.  In a block the fingerprints are sorted by population count
and compared tile by tile with numpy (exclusive-or, bit count); tile pairs whose
population counts differ by more than the radius are skipped.

A block with far more fingerprints than ``CHUNK`` (near copies of one text) is
cut into chunks and compared chunk pair by chunk pair, each pair a task's work
of bounded size.  A task returns a spanning forest of its links, never all
pairs, and the forests are joined into components by alternating star
contractions.
"""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reco.llm.common import free_name, on_executors, stored

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCK = 2048     # fingerprints aimed at in a block
CHUNK = 8192     # fingerprints at most in one side of a task's comparison
TILE = 512
PIECE = 1 << 16  # shingles hashed at once
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS = regex.compile(rb"[^\x20\x09-\x0D]+")


def _shingles(text: bytes, k: int):
    """Lists of at most ``PIECE`` shingles of ``text``, in order."""
    words = (m[0] for m in WORDS.finditer(text)) if len(text) > 8 * PIECE else iter(text.split())
    head = list(islice(words, PIECE + k - 1))
    if not head:
        return
    if len(head) < k:
        yield [b" ".join(head)]
        return
    while len(head) >= k:
        yield list(map(b" ".join, zip(*(head[i:] for i in range(k)))))
        head = head[-(k - 1):] if k > 1 else []
        head += islice(words, PIECE)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of a whole text; 0 for null and for a text without words."""
    n, ones = 0, np.zeros(64, np.int64)
    for piece in _shingles((text or "").encode().translate(LOWER), k):
        h = np.fromiter(map(xxhash.xxh64_intdigest, piece, repeat(SEED)), np.uint64, len(piece))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(piece)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", alias: str = "fingerprint", k: int = SHINGLE) -> DataFrame:
    """``docs`` without the text, with the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c not in (text_col, alias)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(alias, "long")

    def hashed(batches):
        for b in batches:
            t = b.column(text_col)
            fp = np.fromiter((fingerprint(x.as_py(), k) for x in t), np.uint64, len(t)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(fp)], names=keep + [alias])

    on_executors(docs.sparkSession)
    return docs.mapInArrow(hashed, schema)


def block_scheme(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(runs, key bits) for ``n`` fingerprints: the fewest runs whose equal part
    is long enough for blocks of about ``BLOCK``."""
    want = max(0, (max(n, 1) // BLOCK).bit_length())
    parts = radius + 1
    while parts < 16 and (parts - radius) * (64 // parts) < want:
        parts += 1
    return parts, min(want, (parts - radius) * (64 // parts))


def _block_keys(fp: Column, parts: int, bits: int, radius: int) -> Column:
    """``array<bigint>``: one block number per choice of equal runs."""
    width = 64 // parts
    keys = []
    for c, chosen in enumerate(combinations(range(parts), parts - radius)):
        key, used = F.lit(0).cast("long"), 0
        for run in chosen:
            w = min(width, bits - used)
            if w <= 0:
                break
            key = F.shiftleft(key, w).bitwiseOR(F.shiftrightunsigned(fp, run * width).bitwiseAND(F.lit((1 << w) - 1)))
            used += w
        keys.append(key * 4096 + c)
    return F.array(*keys)


def _tiles(x: np.ndarray, y: np.ndarray | None, radius: int):
    """Index pairs (into x, into y) within ``radius``, tile by tile; both
    sorted by population count.  ``y`` None: pairs within x."""
    px = np.bitwise_count(x).astype(np.int16)
    py, other = (px, x) if y is None else (np.bitwise_count(y).astype(np.int16), y)
    for a in range(0, len(x), TILE):
        xa, lo, hi = x[a:a + TILE], px[a] - radius, px[min(a + TILE, len(x)) - 1] + radius
        start = max(int(np.searchsorted(py, lo, "left")), a if y is None else 0)
        stop = int(np.searchsorted(py, hi, "right"))
        for b in range(start, stop, TILE):
            yb = other[b:min(b + TILE, stop)]
            i, j = np.nonzero(np.bitwise_count(xa[:, None] ^ yb[None, :]) <= radius)
            if y is None:
                i, j = i[b + j > a + i], j[b + j > a + i]
            if len(i):
                yield a + i, b + j


def forest(x: np.ndarray, y: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``x``, or between ``x`` and ``y``
    (distinct uint64 fingerprints), as pairs of fingerprints."""
    x = x[np.argsort(np.bitwise_count(x), kind="stable")]
    if y is None:
        values, off = x, 0
    else:
        y = y[np.argsort(np.bitwise_count(y), kind="stable")]
        values, off = np.concatenate([x, y]), len(x)
    label, out = np.arange(len(values)), []
    for p, q in _tiles(x, y, radius):
        q = q + off
        while True:     # one link for each tree that is still apart, then look again
            apart = label[p] != label[q]
            p, q = p[apart], q[apart]
            if not len(p):
                break
            for at in np.unique(label[p], return_index=True)[1]:
                la, lb = label[p[at]], label[q[at]]
                if la != lb:
                    out.append((values[p[at]], values[q[at]]))
                    label[label == lb] = la
    return out


def _compare(radius: int):
    def compare(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        alone = len(side) > 0 and side[0] == 2
        pairs = forest(fp, None, radius) if alone else forest(fp[side == 0], fp[side == 1], radius)
        e = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": e[:, 0].copy(), "b": e[:, 1].copy()})
    return compare


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """``fp`` (distinct) -> forest edges ``a, b`` whose components are those of
    all pairs within ``radius`` bits."""
    on_executors(fps.sparkSession)
    parts, bits = block_scheme(n, radius)
    keyed = fps.select("fp", F.explode(_block_keys(F.col("fp"), parts, bits, radius)).alias("block"))
    counts = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # blocks over CHUNK: at most (rows / CHUNK) of them
    large = counts.filter(F.col("n") > CHUNK).select("block", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    j = keyed.join(large, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    j = j.withColumn("c", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    alone = F.col("c") == F.col("o")
    j = j.select("fp", "block", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("k"),
                 F.when(alone, 2).otherwise((F.col("c") > F.col("o")).cast("int")).alias("side"))
    return j.groupBy("block", "i", "k").applyInArrow(_compare(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` -> ``node, root`` for every node of an edge; the root is the
    smallest node that it reaches.  Alternating large- and small-star rounds,
    as joins and minima, until the edges stay the same: a number of rounds that
    grows with the logarithm of the longest chain."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while e.limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        j = large.join(small, "a")
        e = stored(j.select("a", F.col("m").alias("b"))
                   .unionByName(j.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, row_key, fp, component_id, stays``.

    ``component_id`` is the smallest id in the component of the row's
    fingerprint.  ``row_key`` (a hash of id and text) tells rows with one id
    apart.  ``stays`` marks the row with the smallest id of each component (of
    several rows with that id the smallest row key; rows equal in both are one
    document and stay together).  Null text and texts without words have
    fingerprint 0 and are linked like any other.  Null ids come after all
    others.  An empty table gives an empty result.
    """
    id_ = F.col(f"`{id_col}`")
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(id_, F.col(f"`{text_col}`")).alias("row_key"),
                       F.col(f"`{text_col}`").alias("text"))
    fp = stored(with_fingerprint(rows, "text", "fp", k), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    nodes = stored(fp.groupBy("fp").agg(F.min(order).alias("first")), "nodes")
    comp = components(links(nodes.select("fp"), nodes.count(), radius)).withColumnRenamed("node", "fp")
    rooted = stored(nodes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    labels = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    j = fp.join(labels, "fp")
    return j.select("doc_id", "row_key", "fp", F.col("first.doc_id").alias("component_id"),
                    (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))).alias("stays"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``decisions``)."""
    key, gid = free_name(docs.columns, "_row_key"), free_name(docs.columns, "_gone_id")
    gone = stored(decisions(docs, id_col, text_col, k, radius).filter(~F.col("stays"))
                  .select(F.col("doc_id").alias(gid), F.col("row_key").alias(key)).distinct(), "gone")
    id_ = F.col(f"`{id_col}`")
    return docs.join(gone, id_.eqNullSafe(F.col(gid)) & (F.xxhash64(id_, F.col(f"`{text_col}`")) == F.col(key)), "left_anti")
