"""Spelling variants against plain Python, and the filters by themselves."""

import re
import zlib
from collections import Counter

import numpy as np

from reco.llm import spelling as sp
from tests.llm.tables import DOCS, clashing, docs, empty, sf_documents

LOWER = str.maketrans(sp.UPPER, sp.LOWER)


def slipped(rows):
    """Words of (id, text) rows, letters dropped."""
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            yield w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(found, min_chars=6, min_count=5, lead=5):
    n = {w: c for w, c in Counter(found).items() if len(w) >= min_chars and c >= min_count}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        top = min(vs, key=lambda v: (-n[v], v), default=None)
        if top is not None and n[top] >= lead * n[w]:
            form[w] = top

    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w), root(w), c, len(close[w]), n.get(form.get(w))) for w, c in n.items())


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def words_table(spark, counts):
    return spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)] + [(None,)], "word string")


COUNTS = {"abcdefg": 700, "abcdefh": 30, "abcdeh": 5, "abbcdefg": 6, "abcdef": 140, "bcdefg": 28, "zzzzzz": 5, "zzzzzzz": 25, "zzzzzzzz": 125,
          "ététét": 5, "étètét": 25, "gfedcba": 4, "abcde": 900, "ÿf×÷xyz": 9, "ÿf×÷xy": 60,
          "abcxefg": 140, "aacdefg": 140}


def test_small_vocabulary(spark):
    want = by_hand([w for w, n in COUNTS.items() for _ in range(n)])
    assert any(r[1] and r[2] != r[1] for r in want)
    assert got(sp.variants(words_table(spark, COUNTS))) == want


def test_parts_of_the_filters_agree(spark):
    table = words_table(spark, COUNTS)
    assert got(sp.variants(table, part_blocks=1)) == got(sp.variants(table))


def test_documents(spark):
    d = sf_documents(spark)
    want = by_hand(list(slipped((r.doc_id, r.text) for r in d.collect())))
    assert len(want) > 100
    assert got(sp.variants(sp.with_slips(sp.words(d, min_chars=6)))) == want
    assert got(sp.variants(sp.with_slips(sp.words(d)))) == want


def test_awkward_rows(spark):
    d = clashing(docs(spark), "id", "word", "w", "h", "n")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert sorted(r.word for r in sp.with_slips(sp.words(d)).collect()) == sorted(slipped(rows))
    assert got(sp.variants(sp.with_slips(sp.words(d)), min_chars=3, min_count=1)) == by_hand(list(slipped(rows)), 3, 1)
    assert got(sp.variants(sp.words(empty(spark, DOCS)))) == []


def test_long_words(spark):
    long = "abc" * 5000
    counts = {long: 5, long + "d": 30, long[:700] + long[701:]: 5}
    assert got(sp.variants(words_table(spark, counts))) == by_hand([w for w, n in counts.items() for _ in range(n)])


def test_edit_hashes_are_those_of_the_edited_words():
    vocab = ["banana", "bananb", "banna", "abnana", "anana", "bbnana", "bazana"]
    counts = Counter(map(len, vocab))
    layout = sp.Layout(counts)
    blocks = np.zeros(layout.total, np.uint64)
    for length, _, m in sp._by_length(vocab):
        b, mask = layout.places(length, (m * sp._powers(length)).sum(1, dtype=np.uint64))
        np.bitwise_or.at(blocks, b.astype(np.int64), mask)
    hits = set()
    for length, some, m in sp._by_length(["banana"]):
        for rows, i, letters in sp.edits(layout, blocks, 0, layout.total, length, m):
            hits |= {"banana"[:i] + (chr(c) if c >= 0 else "") + "banana"[i + 1:] for c in letters.tolist()}
    assert {"bananb", "banna", "anana", "bazana"} <= hits
    assert len(hits) < 60
