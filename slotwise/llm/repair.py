"""Repair of conversation structure by a survivor-coalescence Viterbi search."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import SPACED_WORD, stored
from slotwise.session import sized

START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may be added or given in a state, and the state after it.
_GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What is added behind the last row.
_CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: How much more the rest can cost from the second state than from the first: what the first can do, the second
#: can after inserting a row or instead of keeping one.
_REST = {(START, SYSTEM): 4, (START, USER): 5, (START, ASSISTANT): 3, (SYSTEM, START): 0, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 0,
         (USER, START): 2, (USER, SYSTEM): 2, (USER, ASSISTANT): 2, (ASSISTANT, START): 0, (ASSISTANT, SYSTEM): 4, (ASSISTANT, USER): 2}
_EDITS = ("conv string, slice int, step long, edit string, turn long, role string, fault string, new_role string, text string")
_ROWS = ("conv", "slice", "turn", "role", "text", "fault")


@lru_cache(maxsize=None)
def _moves(initial: str, fault: str | None) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """Per state: (next state, cost, edits) of a row, one for each state that can follow, the cheapest and then least."""
    extra = TRUNCATED if fault == "truncated" else 0
    out = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state = start
        for added in range(3):  # a third insertion would lead back to a state at a cost
            cost, edits = INSERT * added, "I" * added
            ways = [(state, cost + DELETE, edits + "D")]
            if fault not in ("blank", "duplicate"):
                ways.append((_GIVEN[state][1], cost + REROLE + extra, edits + "R"))
                if (state, initial) in _KEPT:
                    ways.append((_KEPT[state, initial], cost + extra, edits + "K"))
            for after, price, text in ways:
                if after not in best or (price, text) < best[after]:
                    best[after] = price, text
            state = _GIVEN[state][1]
        out.append(tuple((after, *best[after]) for after in sorted(best)))
    return tuple(out)


class _Node:
    """A row's edits on a survivor's way back; ``refs`` are the nodes after it and the survivors at it."""

    __slots__ = ("parent", "edits", "refs", "kids")

    def __init__(self, parent: _Node | None, edits: str):
        self.parent, self.edits, self.refs, self.kids = parent, edits, 0, set()
        if parent is not None:
            parent.refs += 1
            parent.kids.add(self)


class Survivors:
    """The cheapest ways to every state, the ASCII-least of equal ones, from ``state`` on.

    Ways are told apart by all of their edits since the last common one. No way's
    edits can begin another's (both end in the edit of the same row), so of two
    ways the order never changes once they part: ``alive`` is kept in that order,
    and a tie between complete unresolved suffixes is settled by their places in
    it. ``emit`` gets the edits of a row, in row order, as soon as all survivors
    come from one node behind it; what is held is the unresolved part. A way that
    costs more than another one with all that its state could save survives no longer.
    """

    def __init__(self, state: int, emit: Callable[[str], None] | None = None):
        self.root = _Node(None, "")
        self.root.refs = 1
        self.emit = emit or (lambda edits: None)
        self.alive = [(state, 0, self.root)]

    def step(self, initial: str, fault: str | None) -> None:
        moves, best = _moves(initial, fault), {}
        for place, (state, cost, node) in enumerate(self.alive):
            for after, price, edits in moves[state]:
                key = cost + price, place, edits
                if after not in best or key < best[after][0]:
                    best[after] = key, node
        costs = [(after, key[0]) for after, (key, _) in best.items()]
        best = {x: b for x, b in best.items() if all(x == y or cost + _REST[x, y] >= b[0][0] for y, cost in costs)}
        before, self.alive = self.alive, []
        for after, ((cost, _, edits), node) in sorted(best.items(), key=lambda x: x[1][0][1:]):
            new = _Node(node, edits)
            new.refs = 1
            self.alive.append((after, cost, new))
        for _, _, node in before:
            self._release(node)
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids.pop()
            self.root.parent = None
            self.emit(self.root.edits)

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node.parent.kids.discard(node)
            node = node.parent
            node.refs -= 1

    def unresolved(self, state: int) -> list[str]:
        """The edits not yet emitted on the way to ``state``."""
        node, out = next(n for s, _, n in self.alive if s == state), []
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return out[::-1]

    def end(self) -> int:
        """The state of the best way once the conversation is closed."""
        return min(enumerate(self.alive), key=lambda x: (x[1][1] + INSERT * len(_CLOSING[x[1][0]]), x[0]))[1][0]


class _Writer:
    """Rows of a piece with their edits, in order."""

    def __init__(self, row: dict, state: int, out: list[tuple]):
        self.conv, self.slice, self.state, self.out, self.steps = row["conv"], row["slice"], state, out, 0
        self.waiting: deque[dict] = deque()

    def _put(self, *values: object) -> None:
        self.out.append((self.conv, self.slice, self.steps, *values))
        self.steps += 1

    def add(self, edits: str) -> None:
        for edit in edits:
            role, after = _GIVEN[self.state]
            if edit == "I":
                self._put("I", None, None, None, role, "")
                self.state = after
                continue
            row = self.waiting.popleft()
            if edit == "K":
                role, after = row["role"], _KEPT[self.state, row["role"][:1]]
            elif edit == "D":
                role, after = None, self.state
            self._put(edit, row["turn"], row["role"], row["fault"], role, row["text"])
            self.state = after


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(whether a new piece begins, row) of sorted batches."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            yield (row["conv"], row["slice"]) != last, row
            last = row["conv"], row["slice"]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece, for each state it may begin in: the states it can end in, with costs, in the order of their edits."""
    schema = pa.schema([("conv", pa.string()), ("slice", pa.int32()), ("ends", pa.list_(pa.list_(pa.list_(pa.int64()))))])

    def row(at: tuple, runs: list[Survivors]) -> pa.RecordBatch:
        ends = [[[state, cost] for state, cost, _ in run.alive] for run in runs]
        return pa.RecordBatch.from_pylist([{"conv": at[0], "slice": at[1], "ends": ends}], schema)

    at, runs = None, []
    for new, r in _pieces(batches):
        if new:
            if at is not None:
                yield row(at, runs)
            at, runs = (r["conv"], r["slice"]), [Survivors(s) for s in range(4)]
        for run in runs:
            run.step(r["role"][:1], r["fault"])
    if at is not None:
        yield row(at, runs)


def _routed(table: pa.Table) -> pa.Table:
    """Where each piece of one conversation begins and ends; ways over pieces are compared as ways over rows are."""
    pieces = sorted(table.to_pylist(), key=lambda r: r["slice"])
    alive, back = [(START, 0)], []
    for piece in pieces:
        best: dict[int, tuple] = {}
        for place, (state, cost) in enumerate(alive):
            for rank, (after, price) in enumerate(piece["ends"][state]):
                key = cost + price, place, rank
                if after not in best or key < best[after][0]:
                    best[after] = key, state
        order = sorted(best.items(), key=lambda x: x[1][0][1:])
        alive = [(after, key[0]) for after, (key, _) in order]
        back.append({after: state for after, (_, state) in order})
    state = min(enumerate(alive), key=lambda x: (x[1][1] + INSERT * len(_CLOSING[x[1][0]]), x[0]))[1][0]
    out = []
    for piece, ways in zip(reversed(pieces), reversed(back)):
        out.append({"conv": piece["conv"], "slice": piece["slice"], "enter": ways[state], "leave": state,
                    "final": piece is pieces[-1]})
        state = ways[state]
    return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("slice", pa.int32()), ("enter", pa.int32()),
                                                ("leave", pa.int32()), ("final", pa.bool_())]))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of every piece, given where it begins and, for pieces of a longer conversation, ends."""
    names = [c.split()[0] for c in _EDITS.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in _EDITS.split(", ")]
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        out.clear()
        return batch

    def close(run: Survivors, writer: _Writer, first: dict) -> None:
        state = run.end() if first["leave"] is None else first["leave"]
        for edits in run.unresolved(state):
            writer.add(edits)
        if first["final"] in (None, True):
            writer.add(_CLOSING[state])

    run = writer = first = None
    for new, row in _pieces(batches):
        if new:
            if run is not None:
                close(run, writer, first)
            first, state = row, row["enter"] or START
            writer = _Writer(row, state, out)
            run = Survivors(state, writer.add)
        writer.waiting.append(row)
        run.step(row["role"][:1], row["fault"])
        if len(out) >= 4096:
            yield flush()
    if run is not None:
        close(run, writer, first)
    yield flush()


def judged(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, digest, row, fault): rows with the first fault that each has, or null.

    blank: no character but spaces; duplicate: its role and text stood earlier in
    the conversation; truncated: the last character that is no space is none of
    ``.!?``. A null role or text is one space. Rows of a conversation stand in the
    order of turn, null first, then role and a digest of the text.
    """
    conv = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    text = F.coalesce("text", F.lit(" "))
    rows = stored(conversations.select(
        conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row")), "conversation-rows", "zstd")
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "row")).alias("f")).select(
        F.col("f.row").alias("row"), F.lit(True).alias("first"))
    fault = F.when(~F.col("text").rlike(SPACED_WORD), "blank").when(F.col("first").isNull(), "duplicate").when(
        ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return rows.join(firsts, "row", "left").withColumn("fault", fault).drop("first")


def repair(conversations: DataFrame, slices: int | None = None) -> DataFrame:
    """The cheapest edits that give every conversation the turn order ``(s?(ua)+)?``, by role initials.

    Per edit: conv (the id as text behind ``v``; ``n`` for a null id), slice and
    step (its order), edit, turn, role, fault, new_role, text. Keep (K) costs 0,
    Rerole (R) to user or assistant 2, Delete (D) 3 and is required for blank and
    duplicate rows, Insert (I) of an empty text 2; truncated rows that stay add 1.
    Of equally cheap ways the one with the ASCII-least edits is taken.

    Rows are dealt by range over conversation and turn (into ``slices``, or as many
    as the session's shuffles have or their sizes ask for) and stream through the
    search, which holds what its survivors have not yet agreed on. A conversation
    that spans slices is searched in two passes: first every piece from each of the
    four states, of which costs and order alone are kept; a few numbers a piece
    then tell where the best way enters and leaves each piece, and the second pass
    searches from there. So one conversation with a third of all rows is many
    tasks, and no group is collected.

    Null ids are one conversation; rows that repeat are duplicates; an empty table
    gives no rows. Other columns are ignored.
    """
    keys = ["conv", "turn", "role", "digest", "row"]
    rows = judged(conversations)
    sliced = stored(rows.repartitionByRange(*([slices] if slices else []), *keys).withColumn("slice", F.spark_partition_id()), "slices", "zstd")
    at = sliced.groupBy("conv", "slice").agg(F.count("*").alias("n"))
    several = at.withColumn("k", F.count("*").over(Window.partitionBy("conv"))).filter("k > 1").select("conv", "slice")

    def streamed(df: DataFrame, run: Callable, schema: str, *more: str) -> DataFrame:
        dealt = df.repartition("conv", "slice").sortWithinPartitions("conv", "slice", "turn", "role", "digest", "row")
        return dealt.select(*_ROWS, *more).mapInArrow(run, schema)

    long = sliced.join(sized(several), ["conv", "slice"], "left_semi")
    ends = streamed(long, _summed, "conv string, slice int, ends array<array<array<long>>>")
    routes = ends.groupBy("conv").applyInArrow(_routed, "conv string, slice int, enter int, leave int, final boolean")
    placed = sliced.join(sized(routes), ["conv", "slice"], "left")
    return stored(streamed(placed, _edited, _EDITS, "enter", "leave", "final"), "edits", "zstd")


def conv_id(conv: Column) -> Column:
    return F.when(conv != "n", F.substring(conv, 2, 30).cast("long"))


def repaired(edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, role and text in the order of slice and step."""
    return edits.filter("edit <> 'D'").select(conv_id(F.col("conv")).alias("conv_id"), "slice", "step", F.col("new_role").alias("role"), "text")


_AUDIT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def audits(edits: DataFrame) -> DataFrame:
    """Per conversation of ``edits``: ``_AUDIT``, read in order in one pass that holds no texts.

    A conversation's digest is over all of its rows in turn, so it is one task's.
    """
    names = [c.split()[0] for c in _AUDIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}

        def row() -> pa.RecordBatch:
            turns = now["turns"]
            gaps = now["last_turn"] - now["first_turn"] + 1 - turns if turns else 0
            values = [now["conv"], gaps, *[now[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")],
                      "".join(now["audit"]), now["hash"].hexdigest()]
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if not now or now["conv"] != r["conv"]:
                    if now:
                        yield row()
                    now = {"conv": r["conv"], "turns": 0, "first_turn": None, "last_turn": None, "initial": None, "audit": [],
                           "hash": hashlib.sha256(), "any": False, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
                edit, fault = r["edit"], r["fault"]
                now["audit"].append(edit)
                now["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if edit != "I":
                    if fault:
                        now[fault] += 1
                        now["cost"] += TRUNCATED if fault == "truncated" and edit != "D" else 0
                    initial = r["role"][:1]
                    if now["initial"] is not None and now["initial"] + initial not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["initial"] = initial
                    if r["turn"] is not None:
                        now["turns"] += r["turn"] != now["last_turn"]
                        now["first_turn"] = r["turn"] if now["first_turn"] is None else now["first_turn"]
                        now["last_turn"] = r["turn"]
                if edit != "D":
                    said = f"{r['new_role']}:{r['text']}"
                    now["hash"].update(("\n" + said if now["any"] else said).encode("utf-8", "surrogatepass"))
                    now["any"] = True
        if now:
            yield row()

    ordered = edits.repartition("conv").sortWithinPartitions("conv", "slice", "step")
    return ordered.select("conv", "edit", "turn", "role", "fault", "new_role", "text").mapInArrow(run, _AUDIT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by their number, the CRC-32 of ``conv_id:turn`` modulo 20 (a null is one space).

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the
    row, 4 makes it the user's.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("code")).filter("code <> 0")
    rows = rows.withColumn("text", F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("code") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "code")


def damage_and_repair(conversations: DataFrame, slices: int | None = None) -> DataFrame:
    """Per conversation before damage: conv_id and what ``audits`` says of its repair; zeros and empty where all rows are gone."""
    conv = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    every = conversations.select(conv.alias("conv")).distinct()
    found = every.join(audits(repair(damaged(conversations), slices)), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(conv_id(F.col("conv")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: Costs to the end from every place and state, backwards; then the least edit that keeps to them, forwards.
SQL = """
WITH RECURSIVE tab AS (SELECT list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t
  FROM (SELECT unnest(range(256)) AS x)),
base AS (SELECT coalesce('v' || conv_id, 'n') AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
  list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM conversations, tab),
hurt AS (SELECT g, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM base WHERE code <> 0),
placed AS (SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
  row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS nth, count(*) OVER (PARTITION BY g) AS n FROM hurt),
kinds AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM placed),
chain AS (SELECT *, lag(ini) OVER (PARTITION BY g ORDER BY k) AS prev, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS w FROM kinds),
togo(g, k, v0, vs, vu, va) AS (
  SELECT g, max(k) + 1, 0::BIGINT, 4::BIGINT, 2::BIGINT, 0::BIGINT FROM chain GROUP BY g
  UNION ALL
  SELECT g, k, least(b0, 2 + bu, 4 + ba), least(bs, 2 + bu, 4 + ba), least(bu, 2 + ba), least(ba, 2 + bu) FROM (
    SELECT c.g, c.k,
      least(3 + v0, CASE WHEN must THEN NULL ELSE 2 + w + vu END, CASE WHEN must THEN NULL WHEN ini = 's' THEN w + vs WHEN ini = 'u' THEN w + vu END) AS b0,
      least(3 + vs, CASE WHEN must THEN NULL ELSE 2 + w + vu END, CASE WHEN NOT must AND ini = 'u' THEN w + vu END) AS bs,
      least(3 + vu, CASE WHEN must THEN NULL ELSE 2 + w + va END, CASE WHEN NOT must AND ini = 'a' THEN w + va END) AS bu,
      least(3 + va, CASE WHEN must THEN NULL ELSE 2 + w + vu END, CASE WHEN NOT must AND ini = 'u' THEN w + vu END) AS ba
    FROM togo JOIN chain c ON c.g = togo.g AND c.k = togo.k - 1)),
costs AS (SELECT g, k, [v0, vs, vu, va] AS v FROM togo),
walk(g, k, s, audit, said, done) AS (
  SELECT g, 1::BIGINT, 1, '', '', false FROM (SELECT DISTINCT g FROM chain)
  UNION ALL
  SELECT g, CASE WHEN e IN ('I', '') THEN k ELSE k + 1 END,
    CASE WHEN e IN ('I', 'R') THEN given WHEN e = 'K' THEN CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE s END, audit || e,
    said || CASE e WHEN 'I' THEN name || ':' || chr(10) WHEN 'R' THEN name || ':' || text || chr(10) WHEN 'K' THEN role || ':' || text || chr(10) ELSE '' END, e = ''
  FROM (SELECT walk.*, c.ini, c.role, c.text, CASE WHEN s = 3 THEN 4 ELSE 3 END AS given, CASE WHEN s = 3 THEN 'assistant' ELSE 'user' END AS name,
      CASE WHEN c.k IS NULL AND here.v[s] = 0 THEN '' WHEN c.k IS NULL THEN 'I' WHEN here.v[s] = 3 + after.v[s] THEN 'D'
        WHEN here.v[s] = 2 + here.v[CASE WHEN s = 3 THEN 4 ELSE 3 END] THEN 'I'
        WHEN (s = 1 AND ini = 's' AND here.v[s] = w + after.v[2]) OR (s <> 3 AND ini = 'u' AND here.v[s] = w + after.v[3])
          OR (s = 3 AND ini = 'a' AND here.v[s] = w + after.v[4]) THEN 'K' ELSE 'R' END AS e
    FROM walk JOIN costs here ON here.g = walk.g AND here.k = walk.k LEFT JOIN chain c ON c.g = walk.g AND c.k = walk.k
    LEFT JOIN costs after ON after.g = walk.g AND after.k = walk.k + 1 WHERE NOT done)),
tally AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (k > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM chain GROUP BY g),
every AS (SELECT DISTINCT g, conv_id FROM base)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v[1], 0) AS cost, coalesce(audit, '') AS audit,
  sha256(CASE WHEN coalesce(said, '') = '' THEN '' ELSE left(said, length(said) - 1) END) AS repaired_sha256
FROM every LEFT JOIN tally ON tally.g = every.g LEFT JOIN costs ON costs.g = every.g AND costs.k = 1 LEFT JOIN walk ON walk.g = every.g AND done
"""
