"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import zlib
from collections import defaultdict
from itertools import product

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reco.llm import role_repair as rr
from tests.llm.tables import SF, clashing, empty

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}     # the role order as an automaton; ends 0, 3


def damage(rows):
    """(conversation, turn, role, text) rows after damage, repeats written out."""
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            x = "" if k == 1 else "".join(ch for ch in x if ch not in ".!?") if k == 2 else x
            r = "user" if k == 4 else r
            yield from [(c, t, r, x)] * (2 if k == 3 else 1)


def by_hand(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one
    conversation's (turn, role, text): cheapest edits by a uniform-cost search."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode()))
    seen, fault = set(), []
    for _, r, x in rows:
        bare = x.strip(rr.SPACE)
        fault.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, s, out = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in (0, 3):
            break
        both = [(x, n) for x, n in (("u", "user"), ("a", "assistant")) if (s, x) in STEP]
        for x, n in both:
            heapq.heappush(heap, (cost + 5, audit + "I", i, STEP[s, x], (*out, f"{n}:")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, out))
            if fault[i] in ("", "truncated"):
                _, r, t = rows[i]
                more = 5 if fault[i] else 0
                if (s, r[:1]) in STEP:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEP[s, r[:1]], (*out, f"{r}:{t}")))
                for x, n in both:
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, STEP[s, x], (*out, f"{n}:{t}")))
    first = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows):
    groups = {r[0]: [] for r in rows}
    for c, *r in damage(rows):
        groups[c].append(tuple(r))
    return sorted(((c, *by_hand(r)) for c, r in groups.items()), key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in rr.repair(rr.damaged(df), copies=F.col("copies"), **options).collect()), key=repr)


def test_all_short_role_sequences():
    """Every sequence of up to five rows of four kinds, straight through the parser."""
    kinds = {"s": ("system", "Be good."), "u": ("user", "Hello?"), "a": ("assistant", "so far"), "x": ("tool", "ok.")}
    for n in range(6):
        for letters in product(kinds, repeat=n):
            rows = [(i, kinds[x][0], f"{i} {kinds[x][1]}") for i, x in enumerate(letters)]
            flags = [(t, r, x, 1, False, x[-1] not in ".!?") for t, r, x in rows]
            assert tuple(rr.whole(flags)) == by_hand(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", " "]), st.sampled_from(["", " ", "a.", "b", "c!"])), max_size=9),
       st.integers(0, 9))
def test_segments_chain_to_the_whole(rows, cut):
    """Parsing two segments from every node and chaining them gives the whole's result."""
    rows = [(i, r, x) for i, (r, x) in enumerate(rows)]
    flags = [(t, r, x, 1, not x.strip(), bool(x.strip()) and x[-1] not in ".!?") for t, r, x in rows]
    seen, marked = set(), []
    for f in flags:
        marked.append((*f, (f[1], f[2]) in seen))
        seen.add((f[1], f[2]))
    number = {n: i for i, n in enumerate(rr.LR.nodes)}
    chain, parts = rr.Chain(), [marked[:cut], marked[cut:]]
    for k, part in enumerate(parts):
        paths = [{"a": number[a], "b": number[z], "cost": c, "audit": s} for a in rr.LR.nodes for z, (c, s) in rr.parse(part, {a: (0, "")}).items()]
        chain.add((k,), paths, dict(zip(rr.Tally.FIELDS, rr.tally(part).values())))
    picks = list(chain.close())[::-1]
    audits, texts = [], []
    for part, (_, a, b, before, *values) in zip(parts, picks):
        slice_ = rr.parse(part, {rr.LR.nodes[a]: (0, "")})[rr.LR.nodes[b]][1]
        audits.append(before + slice_)
        texts += rr.repaired(part, rr.LR.bottom if before else rr.LR.nodes[a], before + slice_)
    assert (*picks[-1][4:], "".join(audits), hashlib.sha256("\n".join(texts).encode()).hexdigest()) == by_hand(rows)


def test_grammar():
    assert len(rr.LR.nodes) == 8 and rr.LR.bottom in rr.LR.ends


AWKWARD = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "system", "S."), (1, None, "system", None),
           (2, 5, None, None), (2, 9, "user", "q?"), (2, 2**62, "", "x"), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None),
           (3, 3, "user", "long " * 300_000 + "."), (3, 4, "assistant", "ok!\n\t "), (4, 1, "system", "only."), (5, 1, "User", "no."), (6, -4, "user", " "),
           (6, 0, "assistant", "éè?"), (7, 1, "user", "x."), (7, 1, "user", "y."), (7, 1, "assistant", "x.")]


@pytest.mark.parametrize("options", [{}, {"partitions": 7}, {"segment_rows": 1, "partitions": 2}])
def test_awkward_rows(spark, options):
    d = clashing(spark.createDataFrame(AWKWARD, SCHEMA), "conv", "copies", "h", "rows", "seg")
    assert got(d, **options) == expected(AWKWARD)


def test_conversations(spark):
    d = spark.read.parquet(f"{SF}/conversations.parquet")
    want = expected([tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()])
    assert any("I" in r[7] or "R" in r[7] for r in want)
    assert got(d) == want
    assert got(d, partitions=30, segment_rows=2) == want


def test_one_conversation_over_many_segments(spark):
    """A conversation with most rows, cut into segments; its repeats far apart."""
    rows = [(1, t, ["user", "assistant", "user", "system"][t % 4] if t % 7 else "assistant", f"Turn {t % 50}." if t % 11 else "cut off")
            for t in range(600)] + [(c, t, r, "Hi.") for c in range(2, 40) for t, r in enumerate(["user", "assistant"])]
    d = spark.createDataFrame(rows, SCHEMA)
    assert got(d, partitions=5, segment_rows=16) == expected(rows)


def test_all_rows_dropped_and_empty_table(spark):
    c, t = next((c, t) for c in range(1000) for t in range(30) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    d = spark.createDataFrame([(c, t, "user", "Gone.")], SCHEMA)
    assert got(d) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(empty(spark, SCHEMA)) == []
