"""Language identification by error-correcting output codes.

Every language has a codeword of bits with a large distance to all others.  A
binary classifier on byte n-grams (logistic regression on relative frequencies
of 1- to 3-byte n-grams, hashed to a fixed number of buckets) predicts each bit.
Decoding sums over the bits the loss of the classifier's margin against a
codeword's bit, weighted by how reliable the classifier is, and takes the
nearest codeword.  The score is the share of that codeword among all by
``exp(-distance)``; if the runner-up is close the prediction is ambiguous.

The classifiers are fitted on the driver to a bounded sample of labelled
documents (``SAMPLE_DOCS`` in all, even by language); features are computed in
the tasks from whole texts.  Prediction is a scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from reco.llm.common import free_name, on_executors

SAMPLE_DOCS = 2048          # documents the classifiers are fitted to, at least one a language
SPARE = 2                   # times the ids wanted that the first hash threshold lets through
HASH_RANGE = 1 << 62
BUCKETS = (256, 1024, 2048)  # for 1-, 2- and 3-byte n-grams
DIM = sum(BUCKETS)
PIECE = 1 << 20             # bytes handled at once
STEPS, RIDGE = 150, 1e-5
AMBIGUOUS = 0.2             # smallest lead in score over the runner-up
UNKNOWN = "und"
NAMES = ["lang_pred", "score", "ambiguous"]
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters become spaces.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
HASH = 2654435761


def features(text: str) -> np.ndarray:
    """Square roots of the relative frequencies of the n-grams of a whole text."""
    b = b" " + b" ".join(text.lower().encode().translate(PLAIN).split()) + b" "
    counts = [np.zeros(n, np.int64) for n in BUCKETS]
    for at in range(0, len(b), PIECE):
        a = np.frombuffer(b, np.uint8, min(PIECE + 2, len(b) - at), at).astype(np.uint32)
        last = min(PIECE, len(a))
        counts[0] += np.bincount(a[:last], minlength=256)
        two = (a[:-1] << 8 | a[1:])[:last]
        counts[1] += np.bincount(two * np.uint32(HASH) >> np.uint32(22), minlength=BUCKETS[1])
        three = (a[:-2] << 16 | a[1:-1] << 8 | a[2:])[:last]
        counts[2] += np.bincount(three * np.uint32(HASH) >> np.uint32(21), minlength=BUCKETS[2])
    return np.concatenate([np.sqrt(c / max(1, c.sum())) for c in counts]).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of +1 and -1.  Up to six languages: every split of them into
    two parts.  More: random splits, the best of several draws by the smallest
    distance between two rows."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        columns = []
        for k in range(1, n):
            for chosen in combinations(range(1, n), k):
                columns.append([-1 if i in chosen else 1 for i in range(n)])
        return np.array(columns, np.int8).T
    rng, bits, best, best_d = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(50):
        c = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        c = c[:, np.abs(c.sum(0)) < n]
        d = min(int((c[i] != c[i + 1:]).sum(1).min()) for i in range(n - 1))
        if d > best_d:
            best, best_d = c, d
    return best


@dataclass(frozen=True)
class Model:
    """Languages, their codewords, one linear classifier a bit, and each
    classifier's reliability."""
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Rows of features -> loss-weighted distance to each codeword."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.codes[None, :, :])
        return (loss * self.trust).sum(2)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and whether each is ambiguous."""
        if len(self.langs) < 2:
            one = bool(self.langs)
            return [self.langs[0] if one else UNKNOWN] * len(x), np.full(len(x), float(one)), np.zeros(len(x), bool)
        d = self.distances(x)
        p = np.exp(d.min(1, keepdims=True) - d)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, axis=1)
        return [self.langs[i] for i in d.argmin(1)], p.max(1), top[:, -1] - top[:, -2] < AMBIGUOUS


def fit_model(langs: list[str], x: np.ndarray) -> Model:
    """Fit one classifier a bit by accelerated gradient steps on the logistic
    loss, every language with the same weight in all."""
    names = sorted(set(langs))
    codes = codewords(len(names))
    row = np.array([names.index(v) for v in langs], dtype=np.int64)
    bits = codes.shape[1]
    w, bias, trust = np.zeros((DIM, bits)), np.zeros(bits), np.ones(bits)
    if bits:
        y = codes[row].astype(np.float32)
        share = (1.0 / (np.bincount(row)[row] * len(names))).astype(np.float32)[:, None]
        x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
        step = np.float32(1.0)                # a row's squared norm is 4 at most: the loss is 1-smooth
        v = look = np.zeros((DIM + 1, bits), np.float32)
        for t in range(STEPS):
            pull = -y / (1 + np.exp(np.clip(y * (x1 @ look), -30, 30))) * share
            new = look - step * (x1.T @ pull + np.float32(RIDGE) * look)
            look = new + np.float32(t / (t + 3)) * (new - v)
            v = new
        wrong = ((np.sign(x1 @ v) != y) * share).sum(0)
        # margins of short training paths are small: one common scale
        scale = 1.0 / max(1e-6, float(np.median(np.abs(x1 @ v)))) * 3
        w, bias, trust = v[:-1].astype(float) * scale, v[-1].astype(float) * scale, np.maximum(0.05, 1 - 2 * wrong)
    return Model(names, codes, w, bias, trust)


def bucket5(id_col: str) -> Column:
    """CRC-32 of the id as text, modulo 5 (null as empty text)."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit to at most ``sample_docs`` labelled documents (one a language at
    least), the first of each language by a hash of the id.  Rows with a null
    or letterless text or a null language, and held-out rows
    (``bucket5`` = 0), are never used."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    d = d.filter((bucket5("id") != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # ids under a threshold of their hash that follows from the counts: about
    # SPARE times those wanted, so no task gathers a language
    ids = d.select("id", "lang").withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "id"), 2)).distinct()
    n_of = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}    # a row a language
    each, share = max(1, sample_docs // max(1, len(n_of))), SPARE
    while True:
        top = {v: min(HASH_RANGE, int(HASH_RANGE * (each * share / n))) for v, n in n_of.items()}
        limit = F.lit(0).cast("long")
        for v, t in top.items():
            limit = F.when(F.col("lang") == v, F.lit(t)).otherwise(limit)
        near = ids.filter(F.col("h") < limit)
        got = {r["lang"]: r["n"] for r in near.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(got.get(v, 0) >= min(each, n) for v, n in n_of.items()):
            break
        share *= 4
    chosen = (near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")))
              .filter(F.col("r") <= each).select("id", "lang"))

    def vectors(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("id").cast(pa.string()), b.column("lang"),
                 pa.array([features(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["id", "lang", "x"])

    on_executors(docs.sparkSession)
    # `chosen` has at most max(sample_docs, languages) rows of an id and a language
    rows = (d.join(F.broadcast(chosen), ["id", "lang"]).select("id", "lang", "text")
            .mapInArrow(vectors, "id string, lang string, x binary")
            .groupBy("id", "lang").agg(F.min("x").alias("x")).orderBy("lang", "id").collect())
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, DIM)
    return fit_model([r.lang for r in rows], x)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, ambiguous`` in place of same-named
    columns and without the text.  Null text or text without a letter:
    ``und``, score 0, not ambiguous; so is every text if nothing was learned.
    Only the text is looked at, the whole of it whatever its length; equal
    texts have equal predictions.  Of equally near codewords the language that
    sorts first is predicted, and marked ambiguous.  An empty table gives an
    empty result."""
    keep = [c for c in docs.columns if c != text_col and c.lower() not in NAMES]
    return _identified(docs, model, text_col, keep, NAMES)


def _identified(docs: DataFrame, model: Model, text_col: str, keep: list[str], names: list[str]) -> DataFrame:
    schema = (docs.select(*[F.col(f"`{c}`") for c in keep]).schema
              .add(names[0], "string").add(names[1], "double").add(names[2], "boolean"))

    def predict(batches):
        for b in batches:
            texts = b.column(text_col)
            langs, scores, flags = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            some = [i for i in range(len(texts)) if texts[i].is_valid and LETTER.search(texts[i].as_py())]
            for at in range(0, len(some), 256):
                part = some[at:at + 256]
                ls, sc, am = model.predict(np.stack([features(texts[i].as_py()) for i in part]))
                for i, v in zip(part, ls):
                    langs[i] = v
                scores[part], flags[part] = sc, am
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores), pa.array(flags)],
                                             names=[*keep, *names])

    on_executors(docs.sparkSession)
    return docs.mapInArrow(predict, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in some learned language, with all their columns:
    only ``und`` is rejected; an ambiguous prediction is still one of the
    learned languages, so its document stays."""
    names = [free_name(docs.columns, f"_{n}") for n in NAMES]
    j = _identified(docs, model, text_col, docs.columns, names)
    return j.filter(F.col(names[0]) != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])
