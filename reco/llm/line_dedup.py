"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without the white space at its ends, A-Z lower-cased,
kept as two 64-bit hashes.  Documents arrive in batches.  The distinct keys of
a batch, with the number of documents that hold them and the largest of these,
are one sorted, bucketed table; it is merge-anti-joined with every run, what is
left (keys never seen) becomes a run of its own, and the rest is logged as seen
again.  So the runs hold every key once, with the document that had it first.
When a level has ``FANOUT`` runs they are compacted to one run of the next
level: a batch meets a number of runs that grows with the logarithm of the
batches.  Runs share one bucketing, so neither side of such a join shuffles.

Batches go from the largest ids down, hence the first holder of a key is the
largest id that holds it.  Keys are combined in the map tasks before they are
dealt by (key, id), then by key, so a line that a third of all documents hold
is a few rows in each task.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reco.llm.common import free_name, on_executors, shared_path, stored

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 8, 3
BUCKET_ROWS, MAX_BUCKETS = 1 << 19, 1 << 16
SECOND = 7              # leading column of the second hash
KEY = ["h1", "h2"]


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(SECOND), key).alias("h2")]


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, t, h1, h2``: a row per line whose key has ``min_chars`` code
    points or more; ``t`` is a hash of the text, which tells rows that share an
    id apart."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), _text_hash(text).alias("t"), F.explode(F.split(text, "\n")).alias("line"))
    return (lines.select("id", "t", key_of(F.col("line")).alias("k")).filter(F.length("k") >= min_chars)
            .select("id", "t", *_hashes(F.col("k"))))


class LineRuns:
    """The runs: tables of ``h1, h2, n, owner`` bucketed and sorted by the key,
    no key in two of them, and the log ``again`` of ``h1, h2, n`` for keys that
    a later batch held too.  ``n`` counts documents, ``owner`` is the largest
    id of the batch that brought the key."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[DataFrame]] = []
        self.again: DataFrame | None = None
        self.tables: dict[int, str] = {}

    def _table(self, df: DataFrame, partitioned: bool = False) -> DataFrame:
        """``df`` as a bucketed, sorted table in the shared folder."""
        name = f"line_run_{uuid.uuid4().hex}"
        part = df if partitioned else df.repartition(self.buckets, *KEY)
        (part.write.format("parquet").option("path", shared_path(self.spark, "line-run"))
         .bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name))
        out = self.spark.table(name)
        self.tables[id(out)] = name
        return out

    def _drop(self, table: DataFrame) -> None:
        """Forget the table; its files stay in this application's folder."""
        name = self.tables.pop(id(table), None)
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Take a batch of ``h1, h2, n, owner`` (distinct keys); returns the
        keys that were new and those that some run had."""
        batch = self._table(keys)
        fresh = batch
        for run in self.runs():
            fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        if self.runs():
            fresh = self._table(fresh, partitioned=True)
            seen = stored(batch.join(fresh.select(*KEY).hint("merge"), KEY, "left_anti").select(*KEY, "n"), "seen-again")
            self.again = seen if self.again is None else self.again.unionByName(seen)
            self._drop(batch)
        else:
            seen = batch.select(*KEY, "n").limit(0)
        self._push(fresh, 0)
        return fresh, seen

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            small, self.levels[level] = self.levels[level], []
            merged = small[0]
            for r in small[1:]:
                merged = merged.unionByName(r)
            big = self._table(merged)
            for r in small:
                self._drop(r)
            self._push(big, level + 1)

    def held(self, min_docs: int) -> DataFrame:
        """``h1, h2, owner`` of the keys that ``min_docs`` documents or more hold."""
        everything = None
        for r in self.runs():
            everything = r if everything is None else everything.unionByName(r)
        if self.again is None:
            return everything.filter(F.col("n") >= min_docs).select(*KEY, "owner")
        more = self.again.groupBy(*KEY).agg(F.sum("n").alias("more"))
        j = everything.join(more, KEY, "left")
        return j.filter(F.col("n") + F.coalesce("more", F.lit(0)) >= min_docs).select(*KEY, "owner")

    def close(self) -> None:
        for r in self.runs():
            self._drop(r)
        self.levels = []


def distinct_keys(lines: DataFrame) -> DataFrame:
    """``h1, h2, n, owner`` of ``line_keys`` rows; rows that share an id are
    one document, a null id is a document of its own, smaller than all others."""
    return (lines.groupBy(*KEY, "id").agg(F.lit(1).alias("one")).groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("owner")))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                   min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``id, t, gone``: for each text that loses lines, the (h1, h2) of their
    keys, packed as 16 bytes each.  The largest id that holds a key keeps it."""
    spark = docs.sparkSession
    edges = sorted({e for e in docs.agg(F.percentile_approx(F.col(f"`{id_col}`"), [i / batches for i in range(1, batches)], 10000))
                    .first()[0] or []}, reverse=True)
    # batch 0 has the largest ids; null ids come last
    number = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e > F.col("id"))) if edges else F.lit(0)
    lines = stored(line_keys(docs, id_col, text_col, min_chars).withColumn("batch", F.coalesce(
        F.when(F.col("id").isNotNull(), number), F.lit(len(edges) + 1)).cast("int")), "line-keys", ["batch"])
    n = lines.count()
    runs = LineRuns(spark, max(8, min(MAX_BUCKETS, n // BUCKET_ROWS)), fanout)
    for b in sorted(r[0] for r in lines.select("batch").distinct().collect()):    # at most batches + 1 numbers
        runs.add(distinct_keys(lines.filter(F.col("batch") == b)))
    if not runs.runs():
        return docs.sparkSession.createDataFrame([], lines.select("id", "t").schema.add("gone", "binary"))
    held = stored(runs.held(min_docs), "held-lines")
    runs.close()
    lost = (lines.select("id", "t", *KEY).distinct().join(held, KEY).filter(~F.col("id").eqNullSafe(F.col("owner"))))
    packed = F.unhex(F.array_join(F.collect_list(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))), ""))
    return lost.groupBy("id", "t").agg(packed.alias("gone"))


def _seed(spark: SparkSession) -> int:
    """Seed that makes XXH64 of a key equal to ``xxhash64(SECOND, key)``."""
    return spark.range(1).select(F.xxhash64(F.lit(SECOND))).first()[0] & 0xFFFFFFFFFFFFFFFF


def keep_lines(text: str, gone: bytes, seed: int, min_chars: int) -> tuple[str, int]:
    """(text without the lines whose key is in ``gone``, lines dropped)."""
    keys = {gone[i:i + 16] for i in range(0, len(gone), 16)}
    out, dropped = [], 0
    for line in text.split("\n"):
        k = line.strip(SPACE).translate(TO_LOWER)
        if len(k) >= min_chars:
            b = k.encode()
            if xxhash.xxh64_digest(b, 42) + xxhash.xxh64_digest(b, seed) in keys:
                dropped += 1
                continue
        out.append(line)
    return "\n".join(out), dropped


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the lines that stay as text, and ``n_lines, n_dropped`` in
    place of same-named columns; every row has its result.

    Lines are cut at ``\\n``; a null or empty text is one empty line, its result
    the empty text.  A line goes if its key has ``min_chars`` code points or
    more, ``min_docs`` documents or more hold it and this is not the largest id
    that does; all its repeats in that document stay.  Rows that share an id
    are one document to the counts; so are rows without an id, which come
    before all others.  Texts of any length are cut in one pass.  An empty
    table gives an empty result; other columns, of any name, stay as they are.
    """
    spark = docs.sparkSession
    names = ("n_lines", "n_dropped")
    keep = [c for c in docs.columns if c.lower() not in names]
    gone = stored(repeated_lines(docs, id_col, text_col, min_chars, min_docs, batches, fanout), "gone-lines")
    gid, gt, g, t = (free_name([*keep, *names], n) for n in ("_gone_id", "_gone_text", "_gone", "_text_hash"))
    d = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(t, _text_hash(F.col(f"`{text_col}`")))
    right = gone.select(F.col("id").alias(gid), F.col("t").alias(gt), F.col("gone").alias(g))
    j = (d.join(right, F.col(f"`{id_col}`").eqNullSafe(F.col(gid)) & (F.col(t) == F.col(gt)), "left")
         .select(*[F.col(f"`{c}`") for c in keep], g))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("n_lines", "long").add("n_dropped", "long")
    seed = _seed(spark)

    def cut(batches_):
        for b in batches_:
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(b.column(text_col), b.column(g)):
                text = text.as_py() or ""
                n_lines.append(text.count("\n") + 1)
                text, n = keep_lines(text, lost.as_py(), seed, min_chars) if lost.is_valid else (text, 0)
                texts.append(text)
                n_dropped.append(n)
            cols = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*keep, *names])

    on_executors(spark)
    return j.mapInArrow(cut, schema)
