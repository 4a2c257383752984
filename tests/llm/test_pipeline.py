import hashlib
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from reco.llm import bpe, simhash
from reco.llm.queries import RANKS
from tests.llm.tables import DOCS, SF, docs, empty, sf_documents


def through(spark, d, n):
    for _, stage in cp.STAGES[:n]:
        d = stage(spark, d, SF)
    return d


def test_stages_keep_the_columns(spark):
    d = sf_documents(spark)
    for name, stage in cp.STAGES[:-1]:
        before, d = d, stage(spark, d, SF)
        assert d.columns == before.columns and d.schema.simpleString() == before.schema.simpleString(), name


def test_whole_table(spark):
    rows = {r.doc_id: r.text for r in sf_documents(spark).collect()}
    best = {}
    for i, t in rows.items():
        best[t] = max(best.get(t, i), i)
    exact = {i: t for i, t in rows.items() if best[t] == i}
    fps = {i: simhash.fingerprint(t) for i, t in exact.items()}
    root = {i: i for i in fps}
    for a in sorted(fps):
        for b in sorted(fps):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    near = {i for i in fps if root[i] == i}
    assert {r.doc_id for r in through(spark, sf_documents(spark), 3).collect()} == near
    out = cp.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= near
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(RANKS)), special_tokens={})
    for r in out:
        ids = enc.encode_ordinary(rows[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i])) for i in near}
    taken = sum(size[r.doc_id] for r in out)
    assert abs(taken - sum(size.values())) <= 0.02 * sum(size.values())


def test_awkward_and_empty_tables(spark):
    out = through(spark, docs(spark), len(cp.STAGES)).collect()
    assert out
    assert through(spark, empty(spark, DOCS), len(cp.STAGES)).count() == 0
