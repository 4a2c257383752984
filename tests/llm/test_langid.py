import zlib

import numpy as np

from reco.llm import langid
from tests.llm.tables import DOCS, EN, LONG, clashing, docs, empty, sf_documents


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 9, 40):
        c = langid.codewords(n)
        assert c.shape[0] == n and set(np.unique(c)) == {-1, 1}
        d = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        assert d >= (1 if n == 2 else 2 if n == 3 else 4)


def test_one_wrong_bit_is_corrected():
    m = langid.Model(list("abcd"), langid.codewords(4), np.zeros((langid.DIM, 7)), np.zeros(7), np.ones(7))
    for i, code in enumerate(m.codes):
        for bit in range(7):
            f = code.astype(float) * 3
            f[bit] *= -1
            m2 = langid.Model(m.langs, m.codes, m.weights, f, m.trust)
            lang, score, _ = m2.predict(np.zeros((1, langid.DIM), np.float32))
            assert lang == [m.langs[i]] and 0 < score[0] <= 1


def test_undecided_is_flagged():
    m = langid.Model(list("abcd"), langid.codewords(4), np.zeros((langid.DIM, 7)), np.zeros(7), np.ones(7))
    assert m.predict(np.zeros((1, langid.DIM), np.float32))[2][0]


def test_features_do_not_depend_on_pieces(monkeypatch):
    whole = langid.features(LONG[:5000])
    monkeypatch.setattr(langid, "PIECE", 97)
    assert np.allclose(whole, langid.features(LONG[:5000]))


def test_held_out_accuracy(spark):
    d = sf_documents(spark)
    model = langid.train(d)
    truth = {r.doc_id: r.lang for r in d.collect()}
    held = d.withColumn("held_out", langid.bucket5("doc_id") == 0)
    rows = langid.identify(held.select("doc_id", "text", "held_out"), model).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    out = [r for r in rows if r.held_out]
    assert len(out) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in out]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_do_not_matter(spark):
    d = sf_documents(spark)
    changed = d.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    a, b = langid.train(d), langid.train(changed)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights)


def test_awkward_rows(spark):
    d = clashing(docs(spark), "score", "Lang_Pred")
    model = langid.train(d)
    rows = langid.identify(d, model).collect()
    assert len(rows) == d.count()
    texts = d.select("doc_id", "text").collect()
    no_letters = sum(not t.text or not any(map(str.isalpha, t.text)) for t in texts)
    assert sum(r.lang_pred == "und" and r.score == 0 for r in rows) == no_letters
    kept = langid.accepted(d, model)
    assert kept.columns == d.columns and kept.count() == d.count() - no_letters
    assert {r.score for r in kept.collect()} == {"x"}       # the corpus's own column of that name


def test_nothing_to_learn_or_to_predict(spark):
    none = langid.train(empty(spark, DOCS))
    assert none.langs == []
    assert {r.lang_pred for r in langid.identify(docs(spark), none).collect()} == {"und"}
    assert langid.identify(empty(spark, DOCS), none).count() == 0
    single = langid.train(docs(spark, [(1, EN, "en", None, None), (2, EN, "en", None, None), (3, EN, "en", None, None)]))
    assert {r.lang_pred for r in langid.identify(docs(spark, [(9, EN, None, None, None)]), single).collect()} == {"en"}


def grams_by_hand(text):
    """Square roots of n-gram frequencies by counting one n-gram at a time."""
    plain = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    b = b" " + b" ".join(plain.encode().split()) + b" "
    out = []
    for n, size, shift in ((1, 256, None), (2, 1024, 22), (3, 2048, 21)):
        v = np.zeros(size)
        for i in range(len(b) - n + 1):
            g = int.from_bytes(b[i:i + n], "big")
            v[g if shift is None else (g * langid.HASH % (1 << 32)) >> shift] += 1
        out.append(np.sqrt(v / max(1, v.sum())))
    return np.concatenate(out)


def decoded_by_hand(model, text):
    """Nearest codeword of one text, bit by bit over all codewords."""
    x = grams_by_hand(text)
    distance = []
    for code in model.codes:
        d = 0.0
        for bit, (w, b, trust) in enumerate(zip(model.weights.T, model.bias, model.trust)):
            margin = sum(xi * wi for xi, wi in zip(x, w) if xi) + b
            d += trust * np.log1p(np.exp(-margin * code[bit])) if margin * code[bit] > -30 else -trust * margin * code[bit]
        distance.append(d)
    p = np.exp(min(distance) - np.array(distance))
    return model.langs[int(np.argmin(distance))], p.max() / p.sum()


def test_predictions_by_hand(spark):
    d = sf_documents(spark).limit(60)
    model = langid.train(sf_documents(spark))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d.select("doc_id", "text"), model).collect()}
    for r in d.collect():
        text = r.text or ""
        if any(map(str.isalpha, text)):
            lang, score = decoded_by_hand(model, text)
            assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-3
        else:
            assert got[r.doc_id] == ("und", 0.0)


def test_sample_is_the_first_by_hash(spark):
    """The sample doesn't depend on the threshold's first guess, nor on repeats."""
    rows = [(i % 700, EN + str(i % 7), "en" if i % 3 else "fr", None, None) for i in range(2000)]
    a = langid.train(docs(spark, rows), sample_docs=40)
    b = langid.train(docs(spark, rows * 2).repartition(7), sample_docs=40)
    assert np.array_equal(a.weights, b.weights)
