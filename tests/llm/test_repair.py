"""Conversation repair against enumeration, a plain program over strings, and a replay of the audits."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from quarry.llm import repair
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")
WORDS = re.compile(r"[^\x20\x09-\x0D]")


def enumerated(rows):
    """The cheapest (cost, audit, repaired rows) by trying all edits within the cost of deleting every row."""
    bound, found = 2 * len(rows), []

    def go(i, cost, audit, kept):
        if cost > bound:
            return
        if i == len(rows):
            if LEGAL.fullmatch("".join(r[:1] for r, _ in kept)):
                found.append((cost, audit, kept))
        else:
            role, text, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", kept)
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role:
                    go(i + 1, cost + extra, audit + "K", [*kept, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + extra, audit + "R", [*kept, (new, text)])
        for new in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*kept, (new, "")])

    go(0, 0, "", [])
    return min(found, key=lambda x: x[:2])


def by_strings(rows):
    """The same by a plain program that keeps whole strings and rows per state."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def put(cells, state, entry):
        if state is not None and (state not in cells or entry[:2] < cells[state][:2]):
            cells[state] = entry

    def inserts(cells):
        for _ in range(3):
            for state, (cost, audit, kept) in list(cells.items()):
                for new in ("user", "assistant"):
                    put(cells, step.get((state, new[0])), (cost + 5, audit + "I", [*kept, (new, "")]))

    cells = {0: (0, "", [])}
    inserts(cells)
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, kept) in cells.items():
            put(after, state, (cost + 2, audit + "D", kept))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                put(after, step.get((state, role[:1])), (cost + extra, audit + "K", [*kept, (role, text)]))
                for new in ("user", "assistant"):
                    put(after, step.get((state, new[0])), (cost + 1 + extra, audit + "R", [*kept, (new, text)]))
        cells = after
        inserts(cells)
    return min((cells[s] for s in (0, 3) if s in cells), key=lambda x: x[:2])


def digest(kept):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def repaired(rows, modulus=repair._MODULUS, trail=None):
    r = repair.Repair(modulus)
    if trail:
        r.limit = trail
    for role, text, fault in rows:
        r.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        if trail:
            r.limit = min(r.limit, len(r.audits.letter) + trail)
    return r.result()


ROLES, FAULTS = ["system", "user", "assistant", "tool", ""], [None, None, None, "truncated", "blank", "duplicate"]


def test_all_short_conversations_against_enumeration():
    for n in range(3):
        for roles in itertools.product(ROLES, repeat=n):
            for faults in itertools.product([None, "truncated", "blank"], repeat=n):
                rows = [(r, f"t{i}", f) for i, (r, f) in enumerate(zip(roles, faults))]
                cost, audit, kept = enumerated(rows)
                assert repaired(rows) == (cost, audit, digest(kept)) == (by_strings(rows)[0], by_strings(rows)[1], digest(by_strings(rows)[2]))


def test_random_conversations_against_enumeration():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(ROLES), rng.choice("ab") * 3, rng.choice(FAULTS)) for _ in range(rng.randint(3, 5))]
        cost, audit, kept = enumerated(rows)
        assert repaired(rows) == (cost, audit, digest(kept))


@pytest.mark.parametrize("modulus,trail", [(repair._MODULUS, None), (7, None), (1, None), (repair._MODULUS, 30), (3, 50)])
def test_long_conversations_with_collisions_and_settled_prefixes(modulus, trail):
    rng = random.Random(modulus % 97 + (trail or 0))
    for n in (40, 300):
        rows = [(rng.choice(ROLES), f"text {i}", rng.choice(FAULTS)) for i in range(n)]
        cost, audit, kept = by_strings(rows)
        assert repaired(rows, modulus, trail) == (cost, audit, digest(kept))


def test_trail_of_a_long_conversation_is_settled():
    r = repair.Repair()
    for i in range(30000):
        r.row("user" if i % 2 == 0 else "assistant", "x", False, False)
    assert len(r.audits.letter) < 3 * repair._TRAIL and len(r.settled) > 10000
    assert r.result()[:2] == (0, "K" * 30000)


def test_audits_compare_like_strings():
    rng = random.Random(9)
    for modulus in (repair._MODULUS, 5, 1):
        audits, texts = repair.Audits(modulus), [""]
        for _ in range(400):
            parent = rng.randrange(len(texts))
            letter = rng.choice("DIKR")
            audits.add(parent, letter)
            texts.append(texts[parent] + letter)
        for _ in range(3000):
            x, y = rng.randrange(len(texts)), rng.randrange(len(texts))
            assert audits.less(x, y) == (texts[x] < texts[y])
            assert audits.text(audits.ancestor(x, len(texts[x]) // 2)) == texts[x][:len(texts[x]) // 2]


def plain(rows):
    """What the query returns for (conv_id, turn, role, text) rows, without Spark."""
    by_conv = {}
    for conv, turn, role, text in rows:
        hurt = by_conv.setdefault(conv, [])
        role, text = (" " if role is None else role), (" " if text is None else text)
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        hurt += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, hurt in by_conv.items():
        hurt.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faulty = set(), []
        for _, role, text in hurt:
            shown = WORDS.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in hurt if t is not None]
        initials = [r[:1] for r, _, _ in faulty]
        cost, audit, kept = by_strings(faulty)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *[sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, digest(kept))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    found = QUERIES["op13_repair"](spark, sf).collect()
    want = plain(map(tuple, pq.read_table(f"{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pandas().astype(object).values))
    assert len(found) == len(want)
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == want


SCHEMA = "conv_id long, turn long, role string, text string, dropped_by string, digest string, nth int, fault string, copy int"


def test_odd_rows(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "ok.", "ok", "well? \n", "é!", "line\nbreak.", "long " * 20000 + "end."]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2, 5]), rng.choice([None, "", "user", "assistant", "system", "tool"]), rng.choice(texts))
            for _ in range(120)]
    rows += rows[:30] + [(c, t, "user", "hi.") for c in range(100, 140) for t in range(2)]
    table = spark.createDataFrame([(*r, "x", "y", 1, "z", 2) for r in rows], SCHEMA)
    hurt = repair.damage(table).withColumnRenamed("text", "text")
    found = repair.repair_conversations(hurt)
    want = plain(rows)
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found.collect()} == want
    turns = {}
    for r in sorted(repair.repaired_turns(hurt, found).collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert {c: digest(turns.get(c, [])) for c in want} == {c: v[-1] for c, v in want.items()}
    assert all(len(v) == len([e for e in want[c][-2] if e != "D"]) for c, v in turns.items())


def test_all_rows_dropped_and_empty_table(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "hi.", *["x", "y", 1, "z", 2])], SCHEMA)
    row = repair.repair_conversations(repair.damage(table)).collect()
    assert [tuple(r) for r in row] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    none = repair.damage(spark.createDataFrame([], SCHEMA))
    assert repair.repair_conversations(none).count() == 0
    assert repair.repaired_turns(none, repair.repair_conversations(none)).count() == 0


def test_rows_without_the_dropped_mark_and_one_shuffle(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    plan = repair.repair_conversations(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = [("assistant", "a.", None), ("user", "b.", None), ("assistant", "c", "truncated")]
    assert [(r.cost, r.audit) for r in repair.repair_conversations(table).collect()] == [by_strings(rows)[:2]]
