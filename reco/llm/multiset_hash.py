"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is a multiset of paragraphs (lines), a paragraph a multiset of runs: a
run ends with a sentence, a clause, or a word with one of the letters
``RUN_ENDS`` at its end, so runs are a few words long, also where a text is one
sentence, and an edit changes only the runs around it.  Every paragraph is
hashed to ``WIDE`` 64-bit numbers and every run to ``2 * WORDS`` one-bit lanes;
both are summed without regard to order, the wide numbers modulo 2^64 and the
lanes modulo 2^32 (two lanes share a 64-bit word).  So fingerprints add: ``add`` and ``remove`` insert or delete
paragraphs without the text, and equal multisets have equal fingerprints.

The wide numbers tell equal from unequal.  The lanes, read as signed sums
(twice the set bits less the number of runs), estimate the squared
distance of two multisets, and with the squared norms a likeness from 0 to 1:
``1 - |a - b|^2 / (|a|^2 + |b|^2)``.  With 128 lanes its standard error is
about 0.12 at the middle of the range and falls to 0 for equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reco.llm.common import free_name, stored

WIDE = 4
SHIFTS = 32              # a 64-bit hash gives 32 words of two lanes
HASHES = 2
WORDS = SHIFTS * HASHES
LANE_MASK = 0x0000000100000001
PARAGRAPH = r"\n"
RUN_ENDS = "esnrt"
RUN = rf"\n|(?<=[.!?,;:{RUN_ENDS}])\s+"
CHUNK = 127              # runs whose lanes are summed in fields of 8 bits
BYTE_MASK, BYTES_MASK = 0x0101010101010101, 0x000000FF000000FF
COARSE = 128             # quantiles of the id that bound the window's buckets
BUCKET_ROWS = 1024       # rows aimed at in one bucket
SUPER = 4096             # buckets whose order one task finds
TIES = 1 << 53


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda p: p != "")


def _hashes(pieces: Column, seed: int) -> Column:
    return F.transform(pieces, lambda p: F.xxhash64(F.lit(seed), p))


def _wrapping(values: Column) -> Column:
    """Sum modulo 2^64.  Halves are added apart, as ANSI mode forbids a long to overflow."""
    low = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v.bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + F.shiftrightunsigned(v, 32))
    return _join_halves(high, low)


def _join_halves(high: Column, low: Column) -> Column:
    carry = F.shiftrightunsigned(low, 32)
    return F.shiftleft(high + carry, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def with_fingerprint(docs: DataFrame, text_col: str, alias: str) -> DataFrame:
    """``docs`` with ``alias array<bigint>``: number of runs, ``WIDE``
    paragraph sums, ``WORDS`` lane sums.  Null or empty text: all zero.  Every
    paragraph and run of the whole text counts, repeats included.  Pieces,
    hashes and partial sums are columns of their own, so each is made once a
    text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    par, run = free_name(docs.columns, "_paragraphs"), free_name(docs.columns, "_runs")
    wide = [free_name(docs.columns, f"_wide{i}") for i in range(WIDE)]
    lane = [free_name(docs.columns, f"_lane{i}") for i in range(HASHES)]
    part = [[free_name(docs.columns, f"_part{i}_{j}") for j in range(8)] for i in range(HASHES)]
    d = docs.withColumns({par: _pieces(text, PARAGRAPH), run: _pieces(text, RUN)})
    d = d.withColumns({w: _hashes(F.col(par), i) for i, w in enumerate(wide)}
                      | {w: _hashes(F.col(run), WIDE + i) for i, w in enumerate(lane)})
    d = d.withColumns({part[i][j]: _byte_sums(F.col(w), j) for i, w in enumerate(lane) for j in range(8)})
    words = F.array(F.size(run).cast("long"), *[_wrapping(F.col(w)) for w in wide],
                    *[_lane_sum(F.col(part[i][j % 8]), j // 8) for i in range(HASHES) for j in range(SHIFTS)])
    return d.withColumn(alias, words).drop(par, run, *wide, *lane, *[c for p in part for c in p])


def _byte_sums(hashes: Column, j: int) -> Column:
    """For each ``CHUNK`` hashes the sums of bits ``j, j + 8, ...`` in eight
    fields of a byte, which can't overflow: an array of one word a chunk."""
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.size(hashes), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.aggregate(
        F.slice(hashes, at, F.lit(CHUNK)), F.lit(0).cast("long"),
        lambda s, h: s + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(BYTE_MASK))))


def _lane_sum(parts: Column, field: int) -> Column:
    """Two lanes of 32 bits from byte ``field`` and the fourth after it."""
    return F.aggregate(parts, F.lit(0).cast("long"),
                       lambda s, a: s + F.shiftrightunsigned(a, 8 * field).bitwiseAND(F.lit(BYTES_MASK)))


def _added(x: Column, y: Column) -> Column:
    low = x.bitwiseAND(F.lit(0xFFFFFFFF)) + y.bitwiseAND(F.lit(0xFFFFFFFF))
    return _join_halves(F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32), low)


def _negated(x: Column) -> Column:
    return _added(F.bitwise_not(x), F.lit(1).cast("long"))


def add(a: Column, b: Column) -> Column:
    """Fingerprint words of the union of two multisets."""
    return F.zip_with(a, b, _added)


def remove(a: Column, b: Column) -> Column:
    """Fingerprint words of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: _added(x, _negated(y)))


def to_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def _squares(words: Column, other: Column | None = None) -> Column:
    """Estimated squared norm of a multiset, or of the difference of two."""
    lanes = F.slice(words, WIDE + 2, WORDS)

    def signed(w: Column, n: Column, half) -> Column:
        return (half(w) * 2 - n).cast("double")

    def low(w: Column) -> Column:
        return w.bitwiseAND(F.lit(0xFFFFFFFF))

    def high(w: Column) -> Column:
        return F.shiftrightunsigned(w, 32)

    if other is None:
        n = F.element_at(words, 1)
        each = F.transform(lanes, lambda w: F.pow(signed(w, n, low), F.lit(2.0)) + F.pow(signed(w, n, high), F.lit(2.0)))
    else:
        n = F.element_at(words, 1) - F.element_at(other, 1)
        each = F.zip_with(lanes, F.slice(other, WIDE + 2, WORDS), lambda x, y: (
            F.pow(((low(x) - low(y)) * 2 - n).cast("double"), F.lit(2.0))
            + F.pow(((high(x) - high(y)) * 2 - n).cast("double"), F.lit(2.0))))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.lit(2.0 * WORDS)


def likeness(a: Column, b: Column) -> Column:
    """Estimated likeness of two multisets from their fingerprint words: 1 for
    equal fingerprints (two empty texts too), 0 for nothing shared."""
    norm = _squares(a) + _squares(b)
    return (F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _squares(a, b) / norm))))


def _bucket(id_: Column, tie: Column, marks: list, n: int, nulls: int) -> Column:
    """Number that does not fall as the id rises or, for one id, as the tie
    falls; about ``BUCKET_ROWS`` rows have the same.  ``marks`` are quantiles of
    the id: the range between two is cut evenly, an id that is several of them
    by its ties.  Null ids have the negative numbers, by their ties."""
    per = max(1, -(-n // (BUCKET_ROWS * COARSE)))       # buckets of a range between neighbouring quantiles
    ids = sorted(set(marks))
    own = [(marks.count(v) - 1) * per for v in ids]     # buckets of an id by itself
    low = F.lit(-1) - F.floor(tie / TIES * max(1, -(-nulls // BUCKET_ROWS)))
    if not ids:
        return low.cast("long")
    base = [sum(own[:k]) + k * per for k in range(len(ids))]
    edges, owns, bases = (F.array(*[F.lit(x) for x in xs]) for xs in (ids, own, base))
    k = F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e <= id_)))
    a, b = F.element_at(edges, k).cast("double"), F.element_at(edges, F.least(k + 1, F.lit(len(ids)))).cast("double")
    mine = F.element_at(owns, k)
    by_tie = F.floor((1 - (tie + 1) / TIES) * mine)
    by_id = F.when(b > a, F.least(F.lit(per - 1), F.floor((id_.cast("double") - a) / (b - a) * per))).otherwise(F.lit(0))
    inner = F.when((id_ == F.element_at(edges, k)) & (mine > 0), by_tie).otherwise(mine + F.greatest(F.lit(0), by_id))
    return F.when(id_.isNull(), low).otherwise(F.element_at(bases, k) + inner).cast("long")


def with_next(docs: DataFrame, id_col: str, fields: list[str], alias: str = "next", tie_by: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct ``alias`` of ``fields`` of the next row by
    descending numeric id (after the last: the first); null ids come last.
    Rows that share an id, or have none, are ordered by a hash of ``tie_by``
    (else ``fields``) and spread over buckets by it.

    One shuffle of the rows: they fall into ordered buckets, a window runs in
    each bucket, and each bucket also gets a copy of the first row of the
    bucket after it, so that no order spans more than a bucket.
    """
    id_ = F.col(f"`{id_col}`")
    b, g, tie, at, own, top, to, above, group = (free_name(docs.columns + [alias], n) for n in
                                                 ("_bucket", "_guest", "_tie", "_at", "_own", "_top", "_to", "_above", "_group"))
    n, nulls, marks = docs.agg(F.count(F.lit(1)), F.count_if(id_.isNull()),
                               F.percentile_approx(id_, [i / COARSE for i in range(COARSE + 1)], 10000)).first()
    d = docs.withColumn(tie, F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{f}`") for f in tie_by or fields]), 11))
    d = d.withColumn(b, _bucket(id_, F.col(tie), list(marks or []), n, nulls))
    # the first row of each bucket is a guest in the bucket before it: the
    # order of the buckets is found by groups of SUPER, then over the groups
    order = F.struct(id_.isNotNull(), F.coalesce(id_.cast("decimal(38,9)"), F.lit(0)), -F.col(tie))
    heads = stored(d.select(b, order.alias(top)).groupBy(b).agg(F.max(top).alias(top)).withColumn(group, F.floor(F.col(b) / SUPER)), "bucket-heads")
    within = Window.partitionBy(group).orderBy(b)
    whole = Window.orderBy(group)
    groups = (heads.groupBy(group).agg(F.min(b).alias(own)).withColumn(above, F.coalesce(
        F.lead(own).over(whole), F.first(own).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select(group, above))
    heads = stored(heads.join(groups, group).withColumn(to, F.coalesce(F.lead(b).over(within), F.col(above)))
                   .select(F.col(b).alias(own), top, to), "bucket-heads")
    m = d.join(heads, F.col(b) == F.col(own), "left")

    def place(k: str, guest: int) -> Column:
        return F.struct(F.col(k).alias("k"), F.lit(guest).alias("g"))

    m = (m.withColumn(at, F.explode(F.when(F.col(top) == order, F.array(place(b, 0), place(to, 1)))
                                    .otherwise(F.array(place(b, 0)))))
         .withColumn(b, F.col(f"{at}.k")).withColumn(g, F.col(f"{at}.g")))
    w = Window.partitionBy(b).orderBy(F.asc(g), F.desc_nulls_last(id_), F.asc(tie))
    following = F.lead(F.struct(*[F.col(f"`{f}`") for f in fields])).over(w)
    return (m.withColumn(alias, following).filter(F.col(g) == 0)
            .select(*[F.col(f"`{c}`") for c in docs.columns if c != alias], alias))


def edited(text: Column, following: Column) -> Column:
    """The last ``floor(n / 3)`` code points replaced by the first as many of ``following``."""
    n = F.length(text)
    m = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - m), F.substring(following, F.lit(1), m))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` per row.  Null text counts as empty; an empty
    table gives an empty result; repeated rows each have a result and follow
    each other; rows without an id come after all others; the next document of
    a single row is the row itself."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    d = with_fingerprint(d, "text", "words")
    e = with_next(d, "doc_id", ["text", "words"], tie_by=["text"]).withColumn("edited", edited(F.col("text"), F.col("next.text")))
    e = with_fingerprint(e, "edited", "edited_words")
    return e.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                    F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    to_hex(F.col("words")).alias("fingerprint"), to_hex(F.col("edited_words")).alias("edited_fingerprint"),
                    likeness(F.col("words"), F.col("edited_words")).alias("near_edited"),
                    likeness(F.col("words"), F.col("next.words")).alias("near_next"))
