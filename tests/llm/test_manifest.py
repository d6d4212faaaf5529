"""The manifest against a plain tree, on odd rows and on trees of many shapes."""

import hashlib
import zlib

import pytest

from quarry.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, rank int, g string, node string, way string, seen string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(hashes):
    """All levels of a tree, each a list of digests."""
    found = [hashes]
    while len(found[-1]) > 1:
        at = found[-1]
        found.append([sha("".join(at[i:i + 8])) for i in range(0, len(at), 8)])
    return found


def steps(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        out.append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
        i //= 8
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees = {}
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in members])
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way = steps(trees[g], i) + steps(top, at)
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf([*r[:4], text])
            for before, after in way:
                folded = sha(before + folded + after)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(b + a for b, a in way)), folded, folded == top[-1][0]))
    return out


def check(spark, rows):
    table = spark.createDataFrame([(*r, "h", 3, "g", "n", "w", "s") for r in rows], SCHEMA)
    found = [tuple(r) for r in manifest.verify_documents(table).collect()]
    assert sorted(found, key=str) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    rows = [(1, "s", "en", 3, "Abc"), (1, "s", "en", 3, "Abc"), (1, "s", "en", 4, "abcd"), (None, None, None, None, None), (None, "s", "en", 1, "X"),
            (2, "s", "", 0, ""), (3, None, "de", 2, "ÄÖ A"), (4, "s", "é", 1, "😀Z"), (5, "s", "z", 9, "long " * 50000), (-7, "s", "en", 1, " \n\t")]
    check(spark, rows)


@pytest.mark.parametrize("digits,sizes", [(1, [1, 2, 7, 8, 9, 63, 64, 65, 130]), (2, [64, 65, 600, 5]), (3, [513, 1, 3]), (1, [1] * 75)])
def test_trees_of_many_shapes(spark, monkeypatch, digits, sizes):
    monkeypatch.setattr(manifest, "DIGITS", digits)
    rows = [(i * 3 - 50, "s", f"l{g}", i, f"Text {g} {i}") for g, n in enumerate(sizes) for i in range(n)]
    check(spark, rows)


def test_empty_table(spark):
    assert manifest.verify_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_join_hands_down_a_proof(spark):
    leaves = spark.createDataFrame([(0, 1, 0, "a" * 64)], "g int, n long, rank long, hash string")
    nested = manifest._nest(leaves, [])
    plan = manifest._hand_down(nested, spark.createDataFrame([], f"g int, block long, way {manifest._WAY}"), [])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2  # one for the nesting, one where both meet
