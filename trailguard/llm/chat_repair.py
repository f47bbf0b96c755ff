"""Conversation structure repair: the cheapest edits that make a conversation's roles match (s?(ua)+)?, by Bertsekas'
auction algorithm for shortest paths.

A conversation of n rows is a lattice of (row, state): nothing said, system, user or assistant said last. Arcs are edits with
integer costs; every accepting end leads to one target of price 0. Each node has a price, never above the cost of any arc
plus the price of its head. A path grows from an origin: while its last node's price is less than its best arc's cost plus
head's price, the price is raised to that and the path contracted by the node; else it is extended by the best arc. At the
target all arcs of the path are tight and the origin's price is its distance. Origins are taken at every fourth row from the
end backwards, so paths end at rows whose prices have converged and the work grows with n, not with its square; what a block
of rows comes to, given the prices after it, is remembered. The prices
then are dual to the cheapest edits: every arc of every cheapest sequence is tight, and following tight arcs that reach the
target, by least letter, gives the ASCII-least one.

Spark orders and marks the rows: a range partitioning by conversation, turn, role and text cuts through long conversations;
duplicates are found by aggregating first places of equal texts (combined before the shuffle). Then each conversation's rows
meet in one task, sorted: first one byte a row (role and fault), which is what the auction sees and as long as the audit
string that the result has in one cell anyway; then the texts, which are hashed one by one as they pass (SHA-256 takes its
input in sequence) and never kept. So no task holds a conversation's texts, however long it is.

Null roles and texts become one space (blank rows, initials of no role); a null turn sorts first and counts for no gap; a null
conv_id is one conversation, with the key ` :turn`; rows of one turn are in the order of role and text; repeated rows are
duplicates; an empty table gives no rows. Columns besides conv_id, turn, role and text may have any name: they aren't read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, key, save, settled, shuffle_partitions, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more turn of user or assistant.
NEXT = (USER, USER, ASSISTANT, USER)
#: A row's code: its role's initial (0 other, 1 s, 2 u, 3 a) times 4, plus its first fault (0 none, 1 truncated, 2 blank, 3 duplicate).
GOES, DROPPED = 2, 255
_BLOCK = 4
_VISIBLE = "[^\\x20\\x09-\\x0D]"


def _kept(state: int, initial: int) -> int:
    """The state after keeping a row, or -1 where the pattern has no such row."""
    if initial == SYSTEM:
        return SYSTEM if state == NONE else -1
    return initial if initial and initial == NEXT[state] else -1


@lru_cache(maxsize=None)
def _arcs(code: int, state: int) -> tuple[tuple[int, str, int, int], ...]:
    """Cost, letter, rows passed and state after of the edits of a row of this code (-1: after the last row) in this state, by
    letter; state after -1: the target."""
    arcs = [(INSERT, "I", 0, NEXT[state])]
    if code < 0:
        if state in (NONE, ASSISTANT):
            arcs.append((0, "", 0, -1))
    else:
        arcs.append((DELETE, "D", 1, state))
        if code % 4 < GOES:
            extra = TRUNCATED * (code % 4)
            if (kept := _kept(state, code // 4)) >= 0:
                arcs.append((KEEP + extra, "K", 1, kept))
            arcs.append((REROLE + extra, "R", 1, NEXT[state]))
    return tuple(sorted(arcs, key=lambda a: a[1]))


@lru_cache(maxsize=1 << 16)
def _converged(codes: bytes, after: tuple[int, ...] | None) -> tuple[tuple[int, ...], int]:
    """Prices of the nodes of a block of rows, four states a row, and the auction's steps, given the converged prices of the
    row after the block, of which the least is 0; None: the block is the last, and has the nodes after its last row too.
    Prices begin at 0, which no node of the block can be below."""
    n = len(codes)
    price, exact = [0] * (4 * n) + list(after or (0,) * 4), [False] * (4 * n) + [after is not None] * 4
    out = [[(cost, 4 * (row + more) + state if state >= 0 else -1) for cost, _, more, state in _arcs(codes[row] if row < n else -1, s)] for row in range(n + (after is None)) for s in range(4)]
    steps = 0
    for origin in range(4):
        path = [origin]
        while path[-1] >= 0 and not exact[path[-1]]:
            node = path[-1]
            steps += 1
            best, to = min((cost + (price[head] if head >= 0 else 0), head) for cost, head in out[node])
            if price[node] < best:
                price[node] = best  # the path contracts; an origin stays
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:  # tight up to a converged price: converged too
            if node >= 0:
                exact[node] = True
    return tuple(price[: 4 * (n + (after is None))]), steps


class Auction:
    """Prices of the lattice of a conversation, and its cheapest, ASCII-least edits."""

    def __init__(self, codes: bytes) -> None:
        self.n, self.codes, self.steps = len(codes), codes, 0
        self.price = array("q", bytes(8 * 4 * (self.n + 1)))
        first, after, least = self.n, None, 0
        while first or after is None:
            low = max(0, first - _BLOCK)
            prices, steps = _converged(codes[low:first], after)
            self.price[4 * low : 4 * low + len(prices)] = array("q", [least + p for p in prices])
            self.steps += steps
            least += min(prices[:4])
            after = tuple(p - min(prices[:4]) for p in prices[:4])
            first = low

    def cost(self) -> int:
        return self.price[0]

    def tight(self, node: int) -> list[tuple[str, int]]:
        row, state = divmod(node, 4)
        heads = ((cost, letter, 4 * (row + more) + after if after >= 0 else -1) for cost, letter, more, after in _arcs(self.codes[row] if row < self.n else -1, state))
        return [(letter, head) for cost, letter, head in heads if self.price[node] == cost + (self.price[head] if head >= 0 else 0)]

    def audit(self) -> Iterator[tuple[str, int, int]]:
        """Letters of the cheapest edits with the row and state before each."""
        good = bytearray(4 * (self.n + 1))
        for row in range(self.n, -1, -1):
            arcs = [self.tight(node) for node in range(4 * row, 4 * row + 4)]
            for _ in range(3):  # two insertions in a row at most are tight
                for s in range(4):
                    good[4 * row + s] = good[4 * row + s] or any(head < 0 or good[head] for _, head in arcs[s])
        node = 0
        while node >= 0:
            letter, head = next((letter, head) for letter, head in self.tight(node) if head < 0 or good[head])
            if letter:
                yield letter, node // 4, node % 4
            node = head


@lru_cache(maxsize=1 << 16)
def _short(codes: bytes) -> tuple[int, list[tuple[str, int, int]]]:
    auction = Auction(codes)
    return auction.cost(), list(auction.audit())


def solve(codes: bytes) -> tuple[int, Iterable[tuple[str, int, int]]]:
    """The cost and edits (letter, row, state before) of a conversation; short ones, which repeat, are remembered."""
    if len(codes) <= 32:
        return _short(codes)
    auction = Auction(codes)
    return auction.cost(), auction.audit()


def damage(rows: DataFrame) -> DataFrame:
    """k (conv_id), turn, role and text of rows after damage; of rows that it drops role and text are null."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20
    rows = rows.select(key("conv_id").alias("k"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 0, None).when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 0, None).when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("k", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows with `at`, their place among all rows by conversation, turn, role and text."""
    by = ["k", F.asc_nulls_first("turn"), "role", "text"]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    return save(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered")


def coded(rows: DataFrame) -> DataFrame:
    """k, at, turn and code of ordered rows."""
    # a digest per distinct role and text; of those that a conversation repeats, the first place
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    end = F.regexp_extract("text", f"({_VISIBLE})[\\x20\\x09-\\x0D]*\\z", 1)
    fault = F.when(F.col("text").isNull(), DROPPED).when(~F.col("text").rlike(_VISIBLE), 2).when(~end.isin(".", "!", "?"), 1).otherwise(0)
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in zip("sua", (SYSTEM, USER, ASSISTANT), strict=True) for x in p]), F.substring("role", 1, 1)), F.lit(0))
    marked = rows.select("k", "at", "turn", same.alias("same"), fault.alias("fault"), initial.alias("initial"))
    there = marked.where(F.col("fault") != DROPPED)
    first = there.groupBy("k", "same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = marked.join(first, ["k", "same"], "left")
    code = F.when(F.col("fault") == DROPPED, DROPPED).otherwise(F.col("initial") * 4 + F.when((F.col("fault") < 2) & (F.col("at") > F.col("first")), 3).otherwise(F.col("fault")))
    return found.select("k", "at", "turn", code.alias("code"))


_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
RESULT = "k long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """What streams by of one conversation: codes and turns, then texts."""

    def __init__(self, k: int) -> None:
        self.k, self.codes, self.illegal = k, bytearray(), 0
        self.least = self.most = self.turn = None
        self.turns, self.row, self.pending = 0, 0, None
        self.hash, self.begun = hashlib.sha256(), False

    def code(self, code: int, turn: int | None) -> None:
        if code == DROPPED:
            return
        if self.codes and (self.codes[-1] // 4, code // 4) not in _PAIRS:
            self.illegal += 1
        self.codes.append(code)
        if turn is not None:
            if self.turn is None or turn != self.turn:
                self.turns += 1
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn

    def solve(self) -> None:
        if self.pending is None:
            self.codes = bytes(self.codes)
            self.cost, edits = solve(self.codes)
            self.pending, self.letters = iter(edits), bytearray()
            self.edit = next(self.pending, None)

    def emit(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.begun}{role}:{text}".encode())
        self.begun = True

    def until(self, row: int, role: str = "", text: str = "") -> None:
        """Write what the edits make of all up to this row."""
        while self.edit and self.edit[1] <= row:
            letter, _, state = self.edit
            if letter in "IR":
                self.emit("assistant" if NEXT[state] == ASSISTANT else "user", text if letter == "R" else "")
            elif letter == "K":
                self.emit(role, text)
            self.letters += letter.encode()
            self.edit = next(self.pending, None)
            if letter != "I":
                return

    def text(self, role: str, text: str) -> None:
        self.solve()
        self.until(self.row, role, text)
        self.row += 1

    def result(self) -> tuple:
        self.solve()
        self.until(len(self.codes))
        faults = [sum(self.codes.count(i * 4 + f) for i in range(4)) for f in (2, 3, 1)]
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.k, gaps, *faults, self.illegal, self.cost, self.letters.decode(), self.hash.hexdigest())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, codes before texts, in order: a result row for each conversation."""
    now, out = None, []
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [f.split()[0] for f in RESULT.split(", ")]

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for b in batches:
        for k, code, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("k", "code", "turn", "role", "text")), strict=True):
            if now is None or now.k != k:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(k)
            if code is not None:
                now.code(code, turn)
            else:
                now.text(role, text)
        if out:
            yield flush()
            out = []
    if now is not None:
        out = [now.result()]
        yield flush()


def repair(rows: DataFrame) -> DataFrame:
    """The columns RESULT for each conversation of ordered rows (k, turn, role, text, at)."""
    codes = coded(rows).selectExpr("k", "0 as part", "at", "code", "turn", "cast(null as string) as role", "cast(null as string) as text")
    texts = rows.where("text is not null").selectExpr("k", "1 as part", "at", "cast(null as int) as code", "cast(null as long) as turn", "role", "text")
    dealt = codes.unionByName(texts).repartition(shuffle_partitions(rows.sparkSession), "k").sortWithinPartitions("k", "part", "at")
    return dealt.select("k", "code", "turn", "role", "text").mapInArrow(_repair, RESULT)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        found = repair(ordered(damage(table(spark, sf_dir, "conversations"))))
        return found.select(F.when(F.col("k") != NULL_ID, F.col("k")).alias("conv_id"), *[f.split()[0] for f in RESULT.split(", ")[1:]])

    return settled("op11", make)


_STEP = "xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END)"
_NODE = "{{'c': {c}, 's': {s}}}"


def _arc(cost: str, letter: str, to: str) -> str:
    return f"{{'c': {cost} + {to}.c, 's': '{letter}' || {to}.s}}"


def _best() -> str:
    """The prices and least audits of a row's four states from those (v0 to v3) of the row after it."""
    more, base = "CASE WHEN fault = 1 THEN 5 ELSE 0 END", []
    for s, after in enumerate(("v2", "v2", "v3", "v2")):
        keeps = {0: "CASE initial WHEN 's' THEN v1 WHEN 'u' THEN v2 END", 1: "CASE initial WHEN 'u' THEN v2 END", 2: "CASE initial WHEN 'a' THEN v3 END", 3: "CASE initial WHEN 'u' THEN v2 END"}[s]
        base.append(f"least({_arc('2', 'D', f'v{s}')}, CASE WHEN fault < 2 THEN {_arc(f'1 + {more}', 'R', after)} END, CASE WHEN fault < 2 AND ({keeps}) IS NOT NULL THEN {_arc(more, 'K', f'({keeps})')} END) AS b{s}")
    return ", ".join(base)


_CLOSED = f"least(b2, {_arc('5', 'I', 'b3')}) AS v2, least(b3, {_arc('5', 'I', 'b2')}) AS v3"
OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda acc, k: {_STEP}) AS v FROM range(256) r(i))),
told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 20 AS kind FROM told, crc),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM kinds WHERE kind <> 0)),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER w AS i,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS final
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
rows AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 2 WHEN nth > 1 THEN 3 WHEN final NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed)),
fold AS (SELECT conv_id, max(i) + 1 AS i, {{'c': 0::BIGINT, 's': ''}} AS v0, {{'c': 10::BIGINT, 's': 'II'}} AS v1, {{'c': 5::BIGINT, 's': 'I'}} AS v2, {{'c': 0::BIGINT, 's': ''}} AS v3 FROM rows GROUP BY conv_id
  UNION ALL SELECT conv_id, i, least(b0, {_arc('5', 'I', 'v2')}), least(b1, {_arc('5', 'I', 'v2')}), v2, v3 FROM
    (SELECT conv_id, i, b0, b1, {_CLOSED} FROM (SELECT f.conv_id, r.i, {_best()} FROM fold f JOIN rows r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i - 1))),
plans AS (SELECT conv_id, v0.c AS cost, v0.s AS audit FROM fold WHERE i = 1),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS p FROM plans WHERE audit <> ''),
steps AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS e FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
said AS (SELECT s.*, r.role, r.initial, CASE WHEN s.letter = 'I' THEN '' ELSE r.text END AS text FROM steps s LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE s.letter <> 'D'),
led AS (SELECT *, coalesce(max(1) FILTER (e = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY conv_id), 0) AS system FROM said),
written AS (SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (e - system) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || text, chr(10) ORDER BY p) AS all_text FROM led GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(all_text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""
