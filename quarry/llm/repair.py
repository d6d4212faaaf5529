"""Repair of conversation structure by a dynamic program with a persistent audit trail.

Each row of a conversation is kept, given another role or deleted, and empty
rows may be inserted, so that the roles' initials read ``(s?(ua)+)?`` at the
least cost. After each row there is one cell per state of that pattern: its
cost, the running digest of the repaired text, and its audit, the initials of
the edits so far. Audits share prefixes: an audit is a node with its last
letter, its parent, a rolling hash and binary-lifting ancestors. Of two cheapest
audits the ASCII-least wins: halving jumps find their longest common prefix by
hash, the letters behind it decide, and equal hashes are verified letter by
letter up to a shared node, so a collision can't change the result.

A conversation is one stream of rows sorted by turn, in one task: its digest is
a chain over its text, so no second task could help. The task holds no
conversation: four cells, and the letters of the audit, which is the output.
Where all live audits agree, their prefix leaves the trail for a byte string.
Rows seen earlier are marked before by a window over (conversation, digest), which
spills and needs no shuffle of its own.

Defined cases: a null conversation id is a conversation of its own; null roles
and texts are read as one space, and so is a null id or turn in the damage
code's text; a null turn comes first and counts for no gap; rows of one turn
are ordered by role, then text; an empty role has no legal initial and is never
kept; repeated rows are rows like any other (and
duplicates); a conversation without rows has zeros, an empty audit and the
digest of the empty text; an empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
LEGAL = ("su", "ua", "au")
#: States: nothing yet, after s, after u, after a. The pattern may end in the first and the last.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The only role that may be set or inserted in each state, and the state it leads to.
_FORCED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_FINAL = (0, 3)
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003
_TRAIL = 1 << 14


class Audits:
    """Strings that share prefixes as linked nodes; node 0 is the empty one."""

    def __init__(self, modulus: int = _MODULUS) -> None:
        self.modulus = modulus
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[0]]

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letter)
        up, k = [parent], 0
        while k < len(self.up[up[k]]) and up[k]:
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % self.modulus)
        self.up.append(up)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        up = self.up
        while self.depth[node] > depth:
            node = up[node][min((self.depth[node] - depth).bit_length(), len(up[node])) - 1]
        return node

    def _first_difference(self, x: int, y: int) -> tuple[int, int]:
        """The first nodes of two strings of one length whose letters differ, or (0, 0); by letters alone."""
        found = (0, 0)
        while x != y:
            if self.letter[x] != self.letter[y]:
                found = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        return found

    def less(self, x: int, y: int) -> bool:
        """Whether the string of x comes before that of y in ASCII order."""
        if x == y:
            return False
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if a != b and self.hash[a] == self.hash[b]:
            a, b = self._first_difference(a, b)
        elif a != b:
            # The last jump ends at the first letters behind the longest prefix of equal hashes.
            for k in range(max(len(self.up[a]), len(self.up[b])) - 1, -1, -1):
                if k < len(self.up[a]) and k < len(self.up[b]):
                    p, q = self.up[a][k], self.up[b][k]
                    if self.hash[p] != self.hash[q]:
                        a, b = p, q
            above = self._first_difference(self.up[a][0], self.up[b][0])
            a, b = above if above != (0, 0) else (a, b)
        if self.letter[a] != self.letter[b]:
            return self.letter[a] < self.letter[b]
        return self.depth[x] < self.depth[y]

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def settle(self, live: list[int]) -> tuple[str, "Audits", list[int]]:
        """The prefix that all live strings share, and new audits with what is left of each."""
        texts = [self.text(n) for n in live]
        low, high = min(texts), max(texts)
        shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        fresh, nodes, known = Audits(self.modulus), [], {}
        for text in texts:
            node = 0
            for letter in text[shared:]:
                key = (node, letter)
                if key not in known:
                    known[key] = fresh.add(node, letter)
                node = known[key]
            nodes.append(node)
        return low[:shared], fresh, nodes


class Repair:
    """The cells of one conversation; rows are given in order, then `result` is asked."""

    def __init__(self, modulus: int = _MODULUS) -> None:
        self.audits, self.settled, self.limit = Audits(modulus), bytearray(), _TRAIL
        # state: (cost, audit node, running digest of the repaired rows)
        self.cells = {0: (0, 0, hashlib.sha256())}
        self._insert()

    def _better(self, cells: dict, state: int, cost: int, parent: int, letter: str, digest, role: str | None, text: str) -> bool:
        """Put an edit into the cell of `state` if it is cheaper than what is there, or as cheap and ASCII-less."""
        old = cells.get(state)
        if old and old[0] < cost:
            return False
        node = self.audits.add(parent, letter)
        if old and old[0] == cost and not self.audits.less(node, old[1]):
            return False
        if role is not None:
            # Only the states behind a first row are reached with a role, and only state 0 has no row before.
            first, digest = digest[1] == 0, digest[0].copy()
            digest.update((("" if first else "\n") + role + ":" + text).encode())
        else:
            digest = digest[0]
        cells[state] = (cost, node, digest)
        return True

    def _insert(self) -> None:
        changed = True
        while changed:
            changed = False
            for state in sorted(self.cells):
                cost, node, digest = self.cells[state]
                role, to = _FORCED[state]
                changed |= self._better(self.cells, to, cost + COSTS[INSERT], node, INSERT, (digest, state), role, "")

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        cells: dict = {}
        extra = TRUNCATED_COST if truncated else 0
        for state, (cost, node, digest) in self.cells.items():
            self._better(cells, state, cost + COSTS[DELETE], node, DELETE, (digest, state), None, "")
            if must_go:
                continue
            to = _NEXT[state].get(role[:1])
            if to is not None:
                self._better(cells, to, cost + COSTS[KEEP] + extra, node, KEEP, (digest, state), role, text)
            new, to = _FORCED[state]
            self._better(cells, to, cost + COSTS[REROLE] + extra, node, REROLE, (digest, state), new, text)
        self.cells = cells
        self._insert()
        # After an assistant all goes on as before any row, but that a system row must be deleted: dearer cells
        # can't win any more, and without them the live audits share a prefix.
        if 3 in cells:
            for state, saves in ((0, COSTS[DELETE]), (1, 0)):
                if state in cells and cells[state][0] > cells[3][0] + saves:
                    del cells[state]
        if len(self.audits.letter) > self.limit:
            states = list(self.cells)
            prefix, self.audits, nodes = self.audits.settle([self.cells[s][1] for s in states])
            self.settled += prefix.encode()
            self.cells = {s: (self.cells[s][0], n, self.cells[s][2]) for s, n in zip(states, nodes, strict=True)}
            self.limit = max(_TRAIL, 2 * len(self.audits.letter))

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest) of the cheapest repair."""
        best = None
        for state in _FINAL:
            cell = self.cells.get(state)
            if cell and (best is None or cell[0] < best[0] or (cell[0] == best[0] and self.audits.less(cell[1], best[1]))):
                best = cell
        return best[0], self.settled.decode() + self.audits.text(best[1]), best[2].hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows after damage by the checksum of ``conv_id:turn``.

    A dropped row stays, marked and without role and text, so that its conversation is known.
    """
    blank = F.lit(" ")
    code = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank),
                               F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    hurt = (F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
    return (conversations.select("conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(role).alias("role"), hurt.alias("text"),
                                 (code == 0).alias("dropped"), F.when(code == 3, 2).otherwise(1).alias("times"))
            .select("conv_id", "turn", F.when(~F.col("dropped"), F.col("role")).alias("role"),
                    F.when(~F.col("dropped"), F.col("text")).alias("text"), "dropped",
                    F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
            .drop("copy"))


def _faults(rows: DataFrame) -> DataFrame:
    """The rows by conversation and turn, each with its first fault (none: null)."""
    blank = F.lit(" ")
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), dropped.alias("dropped"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    seen = Window.partitionBy("conv_id", "dropped", "digest").orderBy(F.col("turn").asc_nulls_first())
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.rlike(r"\A[.!?]\z"), "truncated")
    return (rows.repartition("conv_id").withColumn("digest", digest).withColumn("nth", F.row_number().over(seen))
            .withColumn("fault", F.when(~F.col("dropped"), fault)))


def _order() -> list:
    """Rows that only name their conversation come last; equal rows are in the order in which they were counted."""
    return ["conv_id", "dropped", F.col("turn").asc_nulls_first(), "role", "text", "nth"]


def _repairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
    out: list[tuple] = []
    size, at, state = 0, object(), None

    def close() -> None:
        nonlocal size
        if state is None:
            return
        repair, counts, turns, illegal, _ = state
        cost, audit, digest = repair.result()
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        out.append((at, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
        size += len(audit) + 200

    for conv, turn, role, text, dropped, fault in rows:
        if state is None or conv != at:
            close()
            at, state = conv, [Repair(), {"blank": 0, "duplicate": 0, "truncated": 0}, None, 0, None]
            if size > 1 << 22:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
        if dropped:
            continue
        repair, counts, turns, _, before = state
        if turn is not None:
            # Turns ascend, so a new one differs from the last.
            state[2] = [turn, turn, 1] if turns is None else [turns[0], turn, turns[2] + (turn != turns[1])]
        if before is not None and before + role[:1] not in LEGAL:
            state[3] += 1
        state[4] = role[:1]
        if fault:
            counts[fault] += 1
        repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    close()
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    `rows` has conv_id, turn, role, text and may have `dropped`, true for rows
    that only name their conversation.
    """
    sorted_rows = _faults(rows).sortWithinPartitions(*_order()).select("conv_id", "turn", "role", "text", "dropped", "fault")
    kind = sorted_rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    longs = [(n, pa.int64()) for n in names[1:7]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([("conv_id", first.schema.field(0).type), *longs, ("audit", pa.string()), ("repaired_sha256", pa.string())])
            yield from _repairs(chain([first], batches), schema)

    return sorted_rows.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of the repaired conversations, by replaying the audits.

    `repairs` is the result of `repair_conversations` on the same rows. An audit
    goes ahead of its conversation's rows in one sorted stream, so no
    conversation is held.
    """
    marked = _faults(rows).where(~F.col("dropped")).select("conv_id", F.lit(True).alias("dropped"), "turn", "role", "text", "nth")
    ahead = repairs.select("conv_id", F.lit(False).alias("dropped"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                           F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("nth"))
    stream = (ahead.unionByName(marked).repartition("conv_id").sortWithinPartitions(*_order())
              .select("conv_id", F.col("dropped").alias("is_row"), "role", "text"))
    kind = stream.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        edits, state, position, size = iter(""), 0, 0, 0
        for batch in batches:
            ids = batch.schema.field(0).type
            schema = pa.schema([("conv_id", ids), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            for conv, is_row, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_row:
                    # Inserts behind the last row of a conversation have no row to wait for.
                    audit, state, position = text, 0, 0
                    tail = len(audit) - len(audit.rstrip(INSERT))
                    edits, left = iter(audit), len(audit) - tail
                for edit in edits if is_row or not left else ():
                    left -= 1
                    if edit in (KEEP, DELETE):
                        kept, to = role, _NEXT[state].get(role[:1], state)
                    else:
                        kept, to = _FORCED[state]
                    if edit != DELETE:
                        out.append((conv, position, edit, kept, "" if edit == INSERT else text))
                        size += len(text) + 50
                        state, position = to, position + 1
                    if edit != INSERT and left:
                        break
                if size > 1 << 22:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return stream.mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string")
