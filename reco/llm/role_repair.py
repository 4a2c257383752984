"""Repair of conversation structure by generalised LR parsing with edits.

The roles of a conversation, by their first letters, must be a sentence of the
grammar ``RULES``: nothing, or an optional system turn and then pairs of user
and assistant.  The LR(0) automaton of the grammar is built from its rules and
run as a GLR parser: all stacks that a prefix allows are kept in one
graph-structured stack (linked nodes that share their tails).  A row can be
kept, given the role user or assistant, or deleted, and a turn can be inserted
anywhere; stacks whose nodes are equal merge, the smallest (cost, audit) stays.
The grammar is left-recursive, so stacks stay short and few.

Rows are dealt by ranges of (conversation, turn, ...), not by conversation, and
cut into segments of bounded length.  A conversation inside a segment is
repaired at once.  Of one that crosses segments (a conversation may hold a
third of all rows) every segment is parsed by itself from every node that a
stack can end in; the segments' costs and audits from node to node are then
chained in order, and each segment is repaired from the node it turned out to
begin with.  Only segment summaries meet in one task, and the text that is
hashed passes through one task piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reco.llm.common import on_executors, stored

#: Start symbol first; terminals are the initials of the roles.
RULES = [("C", ("T",)), ("T", ()), ("T", ("P",)), ("T", ("s", "P")), ("P", ("u", "a")), ("P", ("P", "u", "a"))]
INSERTED = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
LEGAL = frozenset(["su", "ua", "au"])
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1 << 22

Node = tuple          # (state, node below or None)
Best = tuple          # (cost, audit)


class Automaton:
    """LR(0) states of the rules, and the parser's moves between stacks."""

    def __init__(self, rules: list[tuple[str, tuple[str, ...]]]):
        self.rules = rules
        names = {left for left, _ in rules}
        start = self._closed({(0, 0)}, names)
        self.states, self.step, todo = [start], {}, [0]
        while todo:
            s = todo.pop()
            for symbol in sorted({rules[r][1][at] for r, at in self.states[s] if at < len(rules[r][1])}):
                to = self._closed({(r, at + 1) for r, at in self.states[s] if rules[r][1][at:at + 1] == (symbol,)}, names)
                if to not in self.states:
                    self.states.append(to)
                    todo.append(len(self.states) - 1)
                self.step[s, symbol] = self.states.index(to)
        self.bottom: Node = (0, None)
        self.terminals = sorted({x for _, right in rules for x in right} - names)
        self._find_moves()

    def _closed(self, items: set[tuple[int, int]], names: set[str]) -> frozenset[tuple[int, int]]:
        items, todo = set(items), list(items)
        while todo:
            r, at = todo.pop()
            for symbol in self.rules[r][1][at:at + 1]:
                for new in ((i, 0) for i, (left, _) in enumerate(self.rules) if left == symbol and symbol in names):
                    if new not in items:
                        items.add(new)
                        todo.append(new)
        return frozenset(items)

    def _reduced(self, node: Node) -> list[Node]:
        """The node and all that reductions make of it."""
        found, todo = [node], [node]
        while todo:
            top = todo.pop()
            for r, at in self.states[top[0]]:
                left, right = self.rules[r]
                if at == len(right) and r:
                    base = top
                    for _ in right:
                        base = base[1]
                    new = (self.step[base[0], left], base)
                    if new not in found:
                        found.append(new)
                        todo.append(new)
        return found

    def _live(self, node: Node) -> bool:
        return any((node[0], x) in self.step for x in self.terminals)

    def _find_moves(self) -> None:
        """``moves[node][letter]``: stacks after the letter; ``ends``: nodes at
        which the letters so far are a sentence.  Left recursion keeps the
        number of nodes finite and small."""
        self.nodes, self.moves, self.ends = [], {}, set()
        todo = [n for n in self._reduced(self.bottom) if self._live(n)]
        if any((0, 1) in self.states[n[0]] for n in self._reduced(self.bottom)):
            self.ends.add(self.bottom)
        while todo:
            node = todo.pop()
            if node in self.moves:
                continue
            self.nodes.append(node)
            self.moves[node] = {}
            for x in self.terminals:
                if (node[0], x) in self.step:
                    after = self._reduced((self.step[node[0], x], node))
                    live = [n for n in after if self._live(n)]
                    self.moves[node][x] = live
                    if any((0, 1) in self.states[n[0]] for n in after):
                        self.ends.update(live)
                    todo.extend(live)
        self.nodes.sort(key=repr)


LR = Automaton(RULES)


def _offer(tops: dict[Node, Best], node: Node, cost: int, audit: str) -> bool:
    held = tops.get(node)
    if held is None or (cost, audit) < held:
        tops[node] = (cost, audit)
        return True
    return False


def with_inserts(tops: dict[Node, Best]) -> dict[Node, Best]:
    """Stacks after any number of inserted turns; equal ones merged."""
    todo = list(tops)
    while todo:
        node = todo.pop()
        cost, audit = tops[node]
        for letter in INSERTED:
            for to in LR.moves[node].get(letter, ()):
                if _offer(tops, to, cost + INSERT_COST, audit + INSERT):
                    todo.append(to)
    return tops


def advance(tops: dict[Node, Best], initial: str, must_go: bool, truncated: bool) -> dict[Node, Best]:
    """Stacks after one row: deleted, kept, or with another role."""
    out: dict[Node, Best] = {}
    extra = TRUNCATED_COST if truncated else 0
    for node, (cost, audit) in tops.items():
        _offer(out, node, cost + DELETE_COST, audit + DELETE)
        if must_go:
            continue
        moves = LR.moves[node]
        for to in moves.get(initial, ()):
            _offer(out, to, cost + extra, audit + KEEP)
        for letter in INSERTED:
            for to in moves.get(letter, ()):
                _offer(out, to, cost + extra + REROLE_COST, audit + REROLE)
    return with_inserts(out)


def deleted(tops: dict[Node, Best], n: int) -> dict[Node, Best]:
    """Stacks after ``n`` rows that must go (inserts come after them: the
    audit is smaller so)."""
    return {node: (c + n * DELETE_COST, a + DELETE * n) for node, (c, a) in tops.items()}


Row = tuple           # (turn, role, text, copies, blank, truncated, seen)


def parse(rows: list[Row], tops: dict[Node, Best]) -> dict[Node, Best]:
    """Stacks after a list of rows in order; each stands ``copies`` times."""
    for _, role, _, copies, blank, truncated, seen in rows:
        if copies:
            tops = advance(tops, role[:1], blank or seen, truncated)
            if copies > 1:
                tops = with_inserts(deleted(tops, copies - 1))
    return tops


def repaired(rows: list[Row], start: Node, audit: str) -> Iterator[str]:
    """``role:text`` of the turns that an audit leaves or makes, from the stack
    it starts with."""
    todo = ((r[1], r[2]) if i == 0 else None for r in rows for i in range(r[3]))
    node = start
    for edit in audit:
        role, text = (None, "") if edit == INSERT else next(todo) or (None, None)
        if edit == DELETE:
            continue
        if edit != KEEP:     # of user and assistant at most one can follow
            role = INSERTED[next(x for x in INSERTED if LR.moves[node].get(x))]
        node = LR.moves[node][role[:1]][0]
        yield f"{role}:{text}"


class Tally:
    """Counts of a run of rows, that add up over neighbouring runs."""
    FIELDS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn", "last_turn", "first_role", "last_role"]

    def __init__(self, values: Iterable = (0, 0, 0, 0, 0, 0, None, None, None, None, None, None)):
        (self.rows, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high,
         self.first_turn, self.last_turn, self.first_role, self.last_role) = values

    def values(self) -> list:
        return [getattr(self, f) for f in self.FIELDS]

    @classmethod
    def of(cls, row: Row) -> "Tally":
        turn, role, _, n, blank, truncated, seen = row
        if not n:
            return cls()
        x = role[:1]
        fault = [n, 0, 0] if blank else [0, n - (not seen), int(truncated and not seen)]
        return cls([n, *fault, 0 if x + x in LEGAL else n - 1, int(turn is not None), turn, turn, turn, turn, x, x])

    def join(self, o: "Tally") -> "Tally":
        """This run followed by ``o``; turns rise, so an equal one at the seam counts once."""
        if not self.rows or not o.rows:
            return self if self.rows else o
        low = self.low if self.low is not None else o.low
        high = o.high if o.high is not None else self.high
        same = self.last_turn is not None and self.last_turn == o.first_turn
        return Tally([self.rows + o.rows, self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated,
                      self.illegal + o.illegal + (self.last_role + o.first_role not in LEGAL), self.turns + o.turns - same,
                      low, high, self.first_turn, o.last_turn, self.first_role, o.last_role])

    def result(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def tally(rows: list[Row]) -> Tally:
    t = Tally()
    for r in rows:
        t = t.join(Tally.of(r))
    return t


def best_end(tops: dict[Node, Best]) -> Node:
    return min((n for n in tops if n in LR.ends), key=tops.get)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def whole(rows: list[Row]) -> list:
    """Result values of a conversation all of whose rows are here."""
    seen, marked = set(), []
    for r in rows:
        if r[3]:
            marked.append((*r, (r[1], r[2]) in seen))
            seen.add((r[1], r[2]))
    tops = parse(marked, with_inserts({LR.bottom: (0, "")}))
    cost, audit = tops[best_end(tops)]
    text = "\n".join(repaired(marked, LR.bottom, audit))
    return [*tally(marked).result(), cost, audit, hashlib.sha256(text.encode()).hexdigest()]


INTS = ", ".join(f"{c} long" for c in RESULT)
ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32()),
                 ("blank", pa.bool_()), ("truncated", pa.bool_())])
ROWS_DDL = "array<struct<turn: bigint, role: string, text: string, copies: int, blank: boolean, truncated: boolean>>"


def faults(text: Column) -> tuple[Column, Column]:
    """(blank, truncated) of a text: nothing but white space; last other
    character not one of ``.!?``."""
    bare = F.btrim(text, F.lit(SPACE))
    return bare == "", ~F.substring(bare, -1, 1).isin(".", "!", "?")


def _conv_type(df: DataFrame) -> tuple[pa.DataType, str]:
    """Arrow type and DDL of the conversation column."""
    kind = df.schema["conv"].dataType
    return to_arrow_type(kind), f"conv {kind.simpleString()}"


def _segments(rows: DataFrame, parts: int | None, segment_rows: int) -> DataFrame:
    """``conv, turn, role, text, copies`` -> ``conv, part, seg, open, rows,``
    results.  A row per conversation that lies within a partition, with its
    results; one per segment of the others, with its rows."""
    blank, truncated = faults(F.col("text"))
    d = rows.withColumns({"blank": blank, "truncated": truncated, "head": F.substring("text", 1, 64), "h": F.xxhash64("text"),
                          "salt": F.monotonically_increasing_id()})
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "head", "h", "salt"]
    dealt = d.repartitionByRange(parts, *order) if parts else d.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).select("conv", "turn", "role", "text", "copies", "blank", "truncated")
    conv_type, name = _conv_type(rows)
    ddl = f"{name}, part int, seg long, open boolean, rows {ROWS_DDL}, {INTS}, audit string, sha string"

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out))
        types = [conv_type, pa.int32(), pa.int64(), pa.bool_(), pa.list_(ROW), *[pa.int64()] * len(RESULT), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          names=["conv", "part", "seg", "open", "rows", *RESULT, "audit", "sha"])

    def cut(batches):
        from pyspark import TaskContext
        part, seg, first, conv, held, size, was_cut = TaskContext.get().partitionId(), 0, True, None, [], 0, False
        out: list[tuple] = []

        def close(at_edge: bool) -> None:
            nonlocal seg, held, size
            if at_edge or was_cut:
                out.append((conv, part, seg, True, [dict(zip(("turn", "role", "text", "copies", "blank", "truncated"), r)) for r in held], *[None] * 8))
            else:
                out.append((conv, part, seg, False, None, *whole(held)))
            seg, held, size = seg + 1, [], 0

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for c, *r in zip(*(x.to_pylist() for x in b.slice(at, 256).columns)):
                    if held and c != conv:
                        close(first)
                        first, was_cut = False, False
                    elif held and (len(held) >= segment_rows or size >= SEGMENT_CHARS):
                        was_cut = True
                        close(first)
                    conv = c
                    held.append(tuple(r))
                    size += len(r[2] or "")
                if out:
                    yield batch(out)
                    out.clear()
        if held:
            close(True)
            yield batch(out)

    return dealt.mapInArrow(cut, ddl)


AT = ["conv", "part", "seg"]


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.part") == F.col(f"{b}.part")) & (F.col(f"{a}.seg") == F.col(f"{b}.seg"))


def _earlier(open_: DataFrame) -> DataFrame:
    """``conv, part, seg, dup``: per segment, the SHA-256 of its (role, text)
    that an earlier segment of the conversation has."""
    d = (open_.select(*AT, F.explode("rows").alias("r")).filter("r.copies > 0")
         .select(*AT, _digest(F.col("r.role"), F.col("r.text")).alias("d")).distinct())
    at = F.struct("part", "seg")
    first = d.groupBy("conv", "d").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv", "d", "first")
    a, b = d.alias("a"), first.alias("b")
    return (a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.d") == F.col("b.d")))
            .filter(F.struct("a.part", "a.seg") > F.col("b.first"))
            .groupBy("a.conv", "a.part", "a.seg").agg(F.collect_list("a.d").alias("dup")))   # at most SEGMENT_ROWS


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256)


def _marked(rows: list[dict], dup: list[str] | None) -> list[Row]:
    """Rows of a segment with whether an earlier row has their role and text."""
    earlier, seen, out = set(dup or []), set(), []
    for r in rows:
        if not r["copies"]:
            continue
        key = hashlib.sha256(f"{len(r['role'])}:{r['role']}:{r['text']}".encode()).hexdigest() if earlier else None
        same = (r["role"], r["text"])
        out.append((r["turn"], r["role"], r["text"], r["copies"], r["blank"], r["truncated"], same in seen or key in earlier))
        seen.add(same)
    return out


TALLY_DDL = "tally struct<" + ", ".join(f"{f}: {'string' if f.endswith('role') else 'bigint'}" for f in Tally.FIELDS) + ">"
TALLY = pa.struct([(f, pa.string() if f.endswith("role") else pa.int64()) for f in Tally.FIELDS])
PATH = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
PATH_DDL = "paths array<struct<a: int, b: int, cost: bigint, audit: string>>"


def _paths(batches):
    """Each segment parsed from every node: cost and audit from node to node."""
    number = {n: i for i, n in enumerate(LR.nodes)}
    for b in batches:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            rows = _marked(one.column("rows")[0].as_py(), one.column("dup")[0].as_py())
            paths = [{"a": number[a], "b": number[z], "cost": c, "audit": s}
                     for a in LR.nodes for z, (c, s) in parse(rows, {a: (0, "")}).items()]
            yield pa.RecordBatch.from_arrays(
                [one.column(c) for c in AT] + [pa.array([paths], pa.list_(PATH)), pa.array([dict(zip(Tally.FIELDS, tally(rows).values()))], TALLY)],
                names=[*AT, "paths", "tally"])


class Chain:
    """Best way through the segments of one conversation, in order.  Of the
    audits only what follows their common beginning is held."""

    def __init__(self):
        start = with_inserts({LR.bottom: (0, "")})
        number = {n: i for i, n in enumerate(LR.nodes)}
        self.tops = {number[n]: best for n, best in start.items()}
        self.begin = {i: a for i, (_, a) in self.tops.items()}     # inserts before the first row
        self.back: list[dict[int, int]] = []
        self.at: list[tuple] = []
        self.tally = Tally()

    def add(self, at: tuple, paths: list[dict], counts: dict) -> None:
        new: dict[int, tuple[int, str, int]] = {}
        for p in paths:
            if p["a"] in self.tops:
                cost, audit = self.tops[p["a"]]
                offer = (cost + p["cost"], audit + p["audit"], p["a"])
                if p["b"] not in new or offer[:2] < new[p["b"]][:2]:
                    new[p["b"]] = offer
        audits = [a for _, a, _ in new.values()]
        low, high = min(audits), max(audits)
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        self.tops = {b: (c, a[same:]) for b, (c, a, _) in new.items()}
        self.back.append({b: a for b, (_, _, a) in new.items()})
        self.at.append(at)
        self.tally = self.tally.join(Tally(counts.values()))

    def close(self) -> Iterator[tuple]:
        """(place, node before, node after, audit before the first row, cost
        and counts or nulls) of each segment, last first; the last has the
        whole conversation's cost and counts."""
        end = min((i for i in self.tops if LR.nodes[i] in LR.ends), key=self.tops.get)
        cost = self.tops[end][0]
        for k in range(len(self.at) - 1, -1, -1):
            a = self.back[k][end]
            last = k == len(self.at) - 1
            yield (*self.at[k], a, end, self.begin[a] if k == 0 else "", *([*self.tally.result(), cost] if last else [None] * 6))
            end = a


def _chained(conv_type, batches):
    conv, chain, any_ = None, None, False

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        types = [conv_type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*AT, "a", "b", "before", *RESULT])

    for b in batches:
        for at in range(0, b.num_rows, 64):
            for c, part, seg, paths, counts in zip(*(x.to_pylist() for x in b.slice(at, 64).columns)):
                if any_ and c != conv:
                    yield out(list(chain.close()))
                    any_ = False
                if not any_:
                    conv, chain, any_ = c, Chain(), True
                chain.add((c, part, seg), paths, counts)
    if any_:
        yield out(list(chain.close()))


def _rewritten(batches):
    """Each segment's own audit and repaired turns."""
    for b in batches:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            rows = _marked(one.column("rows")[0].as_py(), one.column("dup")[0].as_py())
            audit, before = one.column("path")[0].as_py(), one.column("before")[0].as_py()
            start = LR.bottom if before else LR.nodes[one.column("a")[0].as_py()]
            text = "\n".join(turns) if (turns := list(repaired(rows, start, before + audit))) else None
            yield pa.RecordBatch.from_arrays([one.column(c) for c in AT] + [pa.array([before + audit]), pa.array([text], pa.string())]
                                             + [one.column(c) for c in RESULT], names=[*AT, "audit", "text", *RESULT])


def _joined(conv_type, batches):
    """Segments of whole conversations, in order -> results, hashed piece by piece."""
    conv, any_, digest, audit, some, last = None, False, None, [], False, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], conv_type), *[pa.array([v], pa.int64()) for v in last], pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
            names=["conv", *RESULT, "audit", "sha"])

    for b in batches:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            c = one.column("conv")[0].as_py()
            if any_ and c != conv:
                yield out()
                any_ = False
            if not any_:
                conv, any_, digest, audit, some = c, True, hashlib.sha256(), [], False
            audit.append(one.column("audit")[0].as_py())
            text = one.column("text")[0]
            if text.is_valid:
                digest.update(b"\n" if some else b"")
                digest.update(text.as_py().encode())
                some = True
            last = [one.column(n)[0].as_py() for n in RESULT]
    if any_:
        yield out()


def _across(open_: DataFrame) -> DataFrame:
    """Results of the conversations whose rows lie in several segments."""
    conv_type, name = _conv_type(open_)
    dup = stored(_earlier(open_), "earlier-turns")
    rows = open_.select(*AT, "rows").alias("a").join(dup.alias("b"), _same("a", "b"), "left").select("a.*", "b.dup")
    paths = stored(rows.mapInArrow(_paths, f"{name}, part int, seg long, {PATH_DDL}, {TALLY_DDL}"), "segment-paths")
    chain = stored(paths.repartition("conv").sortWithinPartitions(*AT)
                   .mapInArrow(lambda it: _chained(conv_type, it), f"{name}, part int, seg long, a int, b int, before string, {INTS}"), "chains")
    taken = chain.alias("a").join(paths.alias("b"), _same("a", "b")).select(
        "a.*", F.filter("b.paths", lambda p: (p.a == F.col("a.a")) & (p.b == F.col("a.b")))[0]["audit"].alias("path"))
    pieces = (rows.alias("a").join(taken.alias("b"), _same("a", "b"))
              .select(*[f"a.{c}" for c in AT], "a.rows", "a.dup", "b.a", "b.before", "b.path", *[f"b.{c}" for c in RESULT])
              .mapInArrow(_rewritten, f"{name}, part int, seg long, audit string, text string, {INTS}"))
    pieces = stored(pieces, "repaired-segments")
    return (pieces.repartition("conv").sortWithinPartitions(*AT)
            .mapInArrow(lambda it: _joined(conv_type, it), f"{name}, {INTS}, audit string, sha string"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           copies: Column | None = None, partitions: int | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of every conversation.

    Rows go by turn (nulls first), then by role, the text's first 64
    characters and a hash of the text; null roles and texts count as one
    space.  ``copies`` says how often a row stands in its conversation: with 0
    it doesn't, but its conversation has a result; a conversation without rows
    has zeros, an empty audit and the hash of the empty text.  A row is blank
    (white space only), else a duplicate (role and text of an earlier row),
    else truncated (its last visible character ends no sentence).  Rows without
    a conversation form one.  Repeated rows are duplicates.  Texts of any
    length, conversations of any number of rows; an empty table gives an empty
    result; columns besides the four are not looked at.
    """
    on_executors(rows.sparkSession)
    n = F.lit(1) if copies is None else copies
    d = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                    F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"), n.cast("int").alias("copies"))
    cut = stored(_segments(d, partitions, segment_rows), "segments")
    out = ["conv", *RESULT, "audit", "sha"]
    both = cut.filter(~F.col("open")).select(*out).unionByName(_across(cut.filter("open").select(*AT, "rows")).select(*out))
    return both.select(F.col("conv").alias(conv_col), *RESULT, "audit", F.col("sha").alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows of a conversation table
    damaged by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls as one space):
    0 takes the row away (no copies), 1 empties its text, 2 takes its ``.!?``,
    3 repeats it, 4 gives it the role user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                    (F.crc32(key.cast("binary")) % 20).alias("k"))
    return d.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"))
