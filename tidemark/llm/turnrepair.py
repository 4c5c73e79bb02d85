"""Repair of conversation structure: the cheapest edits that make a conversation's roles a legal
sequence, found by a bidirectional Dijkstra search over the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# Costs of the edits, by their letters; a truncated turn that stays costs more.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 4, 3, 0, 3, 3
#: Places in a conversation: before all, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a legal conversation may end.
ENDS = (START, ASSISTANT)
#: The place that an initial leads to, and the initial that comes next (never system when new).
AFTER = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
NEXT = (USER, USER, ASSISTANT, USER)
#: What is wrong with a turn.
FINE, BLANK, COPY, CUT = range(4)
#: Turns that are searched at once; a longer conversation is searched run by run.
RUN = 4096

_INF = 1 << 60


def steps(initials: str, faults: bytes, i: int, place: int) -> Iterator[tuple[str, int, int, int]]:
    """The edits from turn i on, in the order of their letters: (letter, cost, turn, place)."""
    if i < len(initials):
        fault = faults[i]
        stays = fault != BLANK and fault != COPY
        more = TRUNCATED if fault == CUT else 0
        yield "D", DELETE, i + 1, place
        yield "I", INSERT, i, NEXT[place]
        to = AFTER.get((place, initials[i]))
        if stays and to is not None:
            yield "K", KEEP + more, i + 1, to
        if stays:
            yield "R", REROLE + more, i + 1, NEXT[place]
    else:
        yield "I", INSERT, i, NEXT[place]


def back_steps(initials: str, faults: bytes, i: int, place: int) -> Iterator[tuple[int, int, int]]:
    """The edits that lead to turn i at a place: (cost, turn before, place before)."""
    for before in range(4):
        if NEXT[before] == place:
            yield INSERT, i, before
    if i:
        fault = faults[i - 1]
        stays = fault != BLANK and fault != COPY
        more = TRUNCATED if fault == CUT else 0
        yield DELETE, i - 1, place
        for before in range(4):
            if stays and AFTER.get((before, initials[i - 1])) == place:
                yield KEEP + more, i - 1, before
            if stays and NEXT[before] == place:
                yield REROLE + more, i - 1, before


def search(initials: str, faults: bytes, begin: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from place `begin` to one of `ends`; of equal ones the
    audit that is least in ASCII.  None if there is no way.

    A forward and a reverse heap grow in turn.  They go on until their tops cost more than the best
    way found, so every edge by which an equally cheap way crosses from one side to the other is
    known.  From these crossings, ways are marked back to the beginning; then the least letter at
    each node, among marked nodes and then towards the end, spells the audit.
    """
    n = len(initials)
    ahead = [_INF] * (4 * (n + 1))  # cost from the beginning; settled where done
    behind = [_INF] * (4 * (n + 1))  # cost to the end
    done_a, done_b = bytearray(4 * (n + 1)), bytearray(4 * (n + 1))
    ahead[begin] = 0
    front, back = [(0, begin)], []
    for place in ends:
        behind[4 * n + place] = 0
        back.append((0, 4 * n + place))
    back.sort()
    best = _INF
    while front and back and front[0][0] + back[0][0] <= best:
        if front[0][0] <= back[0][0]:
            cost, at = heapq.heappop(front)
            if done_a[at]:
                continue
            done_a[at] = 1
            best = min(best, cost + behind[at])
            for _, step, i, place in steps(initials, faults, at >> 2, at & 3):
                to = 4 * i + place
                if cost + step < ahead[to]:
                    ahead[to] = cost + step
                    heapq.heappush(front, (cost + step, to))
        else:
            cost, at = heapq.heappop(back)
            if done_b[at]:
                continue
            done_b[at] = 1
            best = min(best, cost + ahead[at])
            for step, i, place in back_steps(initials, faults, at >> 2, at & 3):
                to = 4 * i + place
                if cost + step < behind[to]:
                    behind[to] = cost + step
                    heapq.heappush(back, (cost + step, to))
    if best >= _INF:
        return None
    # crossings: from a node settled ahead over one edge to a node settled behind, or the end itself
    marked = bytearray(4 * (n + 1))
    todo = [4 * n + e for e in ends if done_a[4 * n + e] and ahead[4 * n + e] == best]
    for at in range(4 * (n + 1)):
        if not done_a[at]:
            continue
        if done_b[at] and ahead[at] + behind[at] == best:
            todo.append(at)
            continue
        for _, step, i, place in steps(initials, faults, at >> 2, at & 3):
            to = 4 * i + place
            if done_b[to] and ahead[at] + step + behind[to] == best:
                todo.append(at)
                break
    while todo:
        at = todo.pop()
        if marked[at]:
            continue
        marked[at] = 1
        for step, i, place in back_steps(initials, faults, at >> 2, at & 3):
            before = 4 * i + place
            if done_a[before] and not marked[before] and ahead[before] + step == ahead[at]:
                todo.append(before)
    audit, at, cost = [], begin, 0
    while not (at >> 2 == n and at & 3 in ends and cost == best):
        for letter, step, i, place in steps(initials, faults, at >> 2, at & 3):
            to = 4 * i + place
            total = cost + step
            if marked[to] and ahead[to] == total or done_b[to] and total + behind[to] == best:
                audit.append(letter)
                at, cost = to, total
                break
        else:
            raise AssertionError("a way of the least cost ends nowhere")
    return best, "".join(audit)


class Repair:
    """The cheapest edits of a conversation whose turns come one after the other.

    Turns are searched in runs of RUN: between runs the cheapest way to each of the four places is
    kept.  No audit to a place is the beginning of another one of equal cost, so the least audit to
    each place is enough.
    """

    def __init__(self):
        self.ways: dict[int, tuple[int, str]] = {START: (0, "")}
        self.initials: list[str] = []
        self.faults = bytearray()

    def add(self, initial: str, fault: int) -> None:
        if len(self.initials) == RUN:
            self._flush((START, SYSTEM, USER, ASSISTANT))
        self.initials.append(initial if initial in ("s", "u", "a") else "?")
        self.faults.append(fault)

    def _flush(self, ends: tuple[int, ...], together: bool = False) -> None:
        initials, faults = "".join(self.initials), bytes(self.faults)
        ways: dict[int, tuple[int, str]] = {}
        for goal in [ends] if together else [(e,) for e in ends]:
            for place, (cost, audit) in self.ways.items():
                found = search(initials, faults, place, goal)
                if found is None:
                    continue
                key, way = goal[0], (cost + found[0], audit + found[1])
                if key not in ways or way < ways[key]:
                    ways[key] = way
        self.ways = ways
        self.initials, self.faults = [], bytearray()

    def end(self) -> tuple[int, str]:
        """(cost, audit) of the whole conversation."""
        self._flush(ENDS, together=True)
        return self.ways[ENDS[0]]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): every row, nulls of role and text as one space, damaged by
    crc32 of `conv_id:turn` (nulls as one space) modulo 20: 0 drops the row, 1 empties its text,
    2 takes its marks .!? out, 3 repeats it, 4 makes it the user's."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")
    kind = F.crc32(key) % 20
    text = (
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.regexp_replace(known("text"), "[.!?]", ""))
        .otherwise(known("text"))
    )
    role = F.when(kind == 4, F.lit("user")).otherwise(known("role"))
    times = F.array_repeat(F.lit(1), F.when(kind == 3, 2).when(kind == 0, 0).otherwise(1))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")
    ).drop("_")


_WHITE = " \t\n\x0b\x0c\r"


def fault(text: Column) -> Column:
    """Blank, cut or fine, by the text alone."""
    bare = F.rtrim(text, F.lit(_WHITE))
    return (
        F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    )


#: What the turns of a conversation are sorted by within it.
ORDER = ("turn", "role", "digest")

_FACTS = (
    "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, gaps bigint,"
    " cost bigint, audit string"
)


def _columns(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


class _Facts:
    """Counts of a conversation's turns so far."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.of = [0, 0, 0, 0]
        self.illegal, self.last = 0, None
        self.turns = [None, None, 0]
        self.repair = Repair()

    def add(self, turn, initial, fault):
        self.of[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        self.repair.add(initial, fault)

    def row(self):
        cost, audit = self.repair.end()
        low, high, distinct = self.turns
        gaps = 0 if low is None else high - low + 1 - distinct
        return (self.conv_id, self.of[BLANK], self.of[COPY], self.of[CUT], self.illegal, gaps, cost,
                audit)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns by conversation and order -> one row of facts for each."""
    names = _FACTS.replace(" bigint", "").replace(" string", "").split(", ")

    def flush(done):
        columns = list(zip(*done, strict=True)) or [[]] * len(names)
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
        )

    now, done = None, []
    for batch in batches:
        for conv_id, turn, initial, fault in _columns(batch, "conv_id", "turn", "initial", "fault"):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Facts(conv_id)
            now.add(turn, initial, fault)
        if done:
            yield flush(done)
            done = []
    if now is not None:
        yield flush([now.row()])


_TURNS = "conv_id bigint, position bigint, edit string, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit, followed by its turns in order -> the repaired turns."""
    names = [x.split()[0] for x in _TURNS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def flush(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
        )

    conv_id, audit, at, place, made, out, size = None, "", 0, START, 0, [], 0

    def inserts():
        nonlocal at, place, made
        while at < len(audit) and audit[at] == "I":
            place = NEXT[place]
            out.append((conv_id, made, "I", "user" if place == USER else "assistant", ""))
            at, made = at + 1, made + 1

    for batch in batches:
        for cid, edits, role, text in _columns(batch, "conv_id", "audit", "role", "text"):
            if edits is not None:  # a new conversation begins
                inserts()
                conv_id, audit, at, place, made = cid, edits, 0, START, 0
                continue
            inserts()
            letter = audit[at]
            at += 1
            if letter != "D":
                if letter == "K":
                    place = AFTER[place, role[:1]]
                else:
                    place = NEXT[place]
                    role = "user" if place == USER else "assistant"
                out.append((conv_id, made, letter, role, text))
                made, size = made + 1, size + len(text)
            if len(out) >= 2000 or size > 4_000_000:
                yield flush(out)
                out, size = [], 0
    inserts()
    if out:
        yield flush(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns, whole conversations in order -> (conv_id, repaired_sha256)."""
    begun, conv_id, digest = False, None, hashlib.sha256()
    done: list[tuple] = []
    for batch in batches:
        for cid, role, text in _columns(batch, "conv_id", "role", "text"):
            if begun and cid == conv_id:
                digest.update(b"\n")
            else:
                if begun:
                    done.append((conv_id, digest.hexdigest()))
                begun, conv_id, digest = True, cid, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        if done:
            ids, values = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(values, pa.string())],
                ["conv_id", "repaired_sha256"],
            )
            done = []
    if begun:
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv_id], pa.int64()), pa.array([digest.hexdigest()], pa.string())],
            ["conv_id", "repaired_sha256"],
        )


def facts(turns: DataFrame) -> DataFrame:
    """One row a conversation of `turns` (conv_id, turn, role, text; no null role or text): counts
    of faults and gaps, and the cost and audit of its cheapest repair.

    Turns go by turn number (nulls first), role and a digest of the text.  Only numbers, initials
    and digests are shuffled.  Copies are found by (conversation, role, digest), so a conversation
    of many turns is spread there; its lattice is then searched run by run as its turns stream by.
    """
    narrow = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        F.md5("text").alias("digest"),
        fault(F.col("text")).alias("fault"),
    )
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy("turn"))
    checked = narrow.withColumn("seen", seen).withColumn(
        "fault", F.when((F.col("fault") != BLANK) & (F.col("seen") > 1), COPY).otherwise(F.col("fault"))
    )
    ordered = (
        checked.repartition("conv_id")
        .sortWithinPartitions("conv_id", *ORDER)
        .select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    )
    return ordered.mapInArrow(_solve, _FACTS)


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns that are left, kept, reroled or inserted.
    `found` has conv_id and audit of each conversation.  An audit goes before its turns, which then
    stream by: no conversation is ever held whole.  Rows of one conversation stay in one partition,
    in order."""
    empty = F.lit(None).cast("string")
    first = found.select(
        "conv_id", F.lit(0).alias("phase"), F.lit(None).cast("bigint").alias("turn"),
        empty.alias("role"), empty.alias("digest"), empty.alias("text"), "audit",
    )
    rest = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.lit(1).alias("phase"),
        F.col("turn").cast("bigint").alias("turn"), "role", F.md5("text").alias("digest"), "text",
        empty.alias("audit"),
    )
    lined = first.unionByName(rest).repartition("conv_id")
    return (
        lined.sortWithinPartitions("conv_id", "phase", *ORDER)
        .select("conv_id", "audit", "role", "text")
        .mapInArrow(_apply, _TURNS)
    )


def audit_conversations(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Facts and the digest of the repaired text for every conv_id of `rows`; `turns` are their
    turns after whatever happened to them.  Conversations without turns have zeros, an empty audit
    and the digest of nothing.

    Null conv_ids are one conversation; null turn numbers go first and count for no gap; rows of
    one turn number are ordered by role and digest; an unknown role can only be deleted or changed;
    an empty table gives no rows; further columns are left aside.
    """
    found = stored(facts(turns), "repairs")
    texts = repaired_turns(turns, found.select("conv_id", "audit")).mapInArrow(
        _digests, "conv_id bigint, repaired_sha256 string"
    )
    ids = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    zero = lambda c: F.coalesce(found[c], F.lit(0)).alias(c)
    return (
        ids.join(found, same(ids, found), "left")
        .join(texts, same(ids, texts), "left")
        .select(
            ids["conv_id"],
            *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]),
            F.coalesce(found["audit"], F.lit("")).alias("audit"),
            F.coalesce(texts["repaired_sha256"], F.lit(hashlib.sha256().hexdigest())).alias(
                "repaired_sha256"
            ),
        )
    )


def op12(spark, sf_dir: str) -> DataFrame:
    """Every conversation's repair after the damage that its turns take by their hash."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.select("conv_id", "turn", "role", "text")
    return audit_conversations(rows, damaged(rows))


OP12_SQL = r"""
WITH RECURSIVE
moves(q, letter, initial, to_q, cost) AS (VALUES
  (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4),
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
  (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3)),
inserts(q, to_q, letters, cost, made) AS (VALUES
  (0, 0, '', 0, CAST([] AS VARCHAR[])), (0, 2, 'I', 3, ['user:']), (0, 3, 'II', 6, ['user:', 'assistant:']),
  (1, 1, '', 0, []), (1, 2, 'I', 3, ['user:']), (1, 3, 'II', 6, ['user:', 'assistant:']),
  (2, 2, '', 0, []), (2, 3, 'I', 3, ['assistant:']), (3, 3, '', 0, []), (3, 2, 'I', 3, ['user:'])),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k
  FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(
      list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT)),
      lambda c, b: list_reduce(CAST([1, 2, 3, 4, 5, 6, 7, 8] AS BIGINT[]),
        lambda d, j: xor(d >> 1, (d & 1) * 3988292384), xor(c, b)),
      4294967295), 4294967295) % 20 AS kind
  FROM keyed),
turns AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds JOIN (VALUES (1), (2)) t(n) ON n <= CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM turns),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'copy'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'cut' ELSE 'fine' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ways(conv_id, i, q, cost, audit, made) AS (
  SELECT conv_id, CAST(0 AS BIGINT), to_q, CAST(cost AS BIGINT), letters, made
  FROM ids, inserts WHERE q = 0
  UNION ALL
  SELECT conv_id, i, q, cost, audit, made FROM (
    SELECT w.conv_id, j.i, n.to_q AS q,
           w.cost + m.cost + n.cost + CASE WHEN fault = 'cut' AND letter <> 'D' THEN 3 ELSE 0 END AS cost,
           w.audit || letter || letters AS audit,
           list_concat(list_concat(w.made, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
             ELSE [CASE m.to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END), n.made) AS made,
           row_number() OVER (PARTITION BY w.conv_id, n.to_q ORDER BY
             w.cost + m.cost + n.cost + CASE WHEN fault = 'cut' AND letter <> 'D' THEN 3 ELSE 0 END,
             w.audit || letter || letters) AS r
    FROM ways w
    JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    JOIN moves m ON m.q = w.q AND (letter <> 'K' OR initial = left(role, 1))
      AND (letter = 'D' OR fault NOT IN ('blank', 'copy'))
    JOIN inserts n ON n.q = m.to_q)
  WHERE r = 1),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'copy') AS duplicate,
         count(*) FILTER (fault = 'cut') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
ended AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost, w.audit) AS r
  FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.i = coalesce(c.n, 0) AND w.q IN (0, 3))
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, e.cost, e.audit,
       sha256(array_to_string(e.made, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id WHERE r = 1
"""
