"""The operators against brute force, round trips and the defined cases."""

import hashlib
import html
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import attribution, chat, chunks, html_main, lm, mixing, packing, rules, sharding, simhash
from quarry.llm.common import tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, block string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, " \n\t"), (None, "x y"), (None, None), (5, long), (6, long + " end")]
    return spark.createDataFrame([(i, t, None, None if i == 2 else "s", None, "clash", "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "mix": lambda d: mixing.mix_documents(d),
    "shard": lambda d: sharding.shard_documents(d),
    "rules": lambda d: rules.apply_rules(d, [[rules.Condition("digit_share", True, 0.5)]]),
    "chunks": lambda d: chunks.fingerprint_edits(d),
    "counts": lambda d: attribution.token_counts(d, tokenizer("byte_bpe_50k.json"), fields=("text",)),
    "pack": lambda d: packing.pack_documents(d, tokenizer("word_bpe_49k.json")).where("piece = 0"),
    "lm": lambda d: lm.score_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(name, odd, empty):
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a[/INST]\n"]), st.text(alphabet="<s>/[INST] \\\n", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for _, a, b in spans] == [t for _, t in turns]


def test_chat_mask_is_the_assistant_text(spark):
    turns = [(7, 0, "user", "</s>[INST] ok [/INST]"), (7, 1, "assistant", "</s>[INST] é漢 ok [/INST]"), (7, 2, "assistant", None), (8, 0, None, "x"),
             (None, None, "assistant", "<\\s>")]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
                                                   tokenizer("byte_bpe_50k.json"))).collect()
    found = {r["conv_id"]: r for r in got}
    assert found[7]["loss_sha256"] == hashlib.sha256("</s>[INST] é漢 ok [/INST]".encode()).hexdigest()
    assert found[None]["loss_chars"] == 4 and found[8]["loss_chars"] == 0 and found[7]["n_turns"] == 3


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_cover_the_text(data):
    ends = chunks.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert sum(sizes) == len(data)
    assert all(chunks.LEAST <= s <= chunks.LARGEST for s in sizes[:-1])


def test_gear_hash_equals_the_rolling_form():
    data = hashlib.sha512(b"x").digest() * 3
    h, table = 0, chunks.gear_table()
    for i, b in enumerate(data):
        h = ((h << 1) + int(table[b])) & 0xFFFFFFFF
        assert chunks.gear_hashes(data)[i] == h


def test_edits_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(rows)
    for r in chunks.fingerprint_edits(docs).collect():
        following = rows[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        edited = chunks.edit(rows[r["doc_id"]], following)
        own, other = chunks.chunk_set(rows[r["doc_id"]]), chunks.chunk_set(edited)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert chunks.from_text(r["fingerprint"]) == own
        assert r["near_edited"] == pytest.approx(chunks.containment(own, other))
        assert r["near_next"] == pytest.approx(chunks.containment(own, chunks.chunk_set(following)))


def test_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"].encode().lower().split() + [0] for r in docs.collect()}
    trained = [w for i, w in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(), Counter()
    for w in trained:
        one.update(w)
        two.update(zip([1, *w], w))
    n, v = sum(one.values()), len(one)
    # Small blocks, so that most counts come from other blocks.
    for r in lm.score_documents(docs, block_bytes=5000).collect():
        w = rows[r["doc_id"]]
        base = math.fsum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = math.fsum(math.log10((two[u, x] + lm.MU * (one[x] + 1) / (n + v + 1)) / ((one[0] if u == 1 else one[u]) + lm.MU))
                          for u, x in zip([1, *w], w))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_scores_of_blocks_whose_files_are_split(spark):
    """A stored block that several tasks read in parts gives the same scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    whole = sorted(map(tuple, lm.score_documents(docs).collect()))
    small = {"spark.sql.files.maxPartitionBytes": "10k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, value in small.items():
            spark.conf.set(k, value)
        hadoop.set("parquet.block.size", "30000")
        hadoop.set("parquet.block.size.row.check.min", "5")
        split = sorted(map(tuple, lm.score_documents(docs).collect()))
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.block.size.row.check.min")
    assert [r[:5] for r in split] == [r[:5] for r in whole]
    assert [r[6] for r in split] == pytest.approx([r[6] for r in whole])


def test_mixture_against_sql(spark):
    import duckdb

    from quarry.llm import queries

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        expected = sorted(db.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.ORACLE_SQL['op2_mix_sources']})").fetchall())
    assert sorted(map(tuple, queries.op2_mix_sources(spark, SF).collect())) == expected


def test_components_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    least = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x, _ in rows:
            for b, y, _ in rows:
                if (x ^ y).bit_count() <= 4 and least[a] > least[b]:
                    least[a], changed = least[b], True
    assert least == {i: c for i, _, c in rows}


def test_long_runs_give_the_same_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert a == {tuple(r) for r in simhash.near_duplicates(docs, run_limit=1).collect()}


def test_statistics_by_brute_force(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect():
        words = WORD.findall(r["text"])
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in r["text"].split("\n") if WORD.search(x)]
        assert rules.statistics(r["text"])[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r["text"])),
                                                   len(lines) - len(set(lines)), len(repeated))


def test_rules_on_held_out_labels():
    rng = np.random.default_rng(3)

    def draw(n):
        rows = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
        return rows, ((rows["a"] > 0.8) & (rows["b"] < 0.5)) | (rows["c"] > 0.9)

    rows, bad = draw(3000)
    learned = rules.learn(rows, bad)
    rows, bad = draw(3000)
    rejected = np.any([rules._covered(r, rows, 3000) for r in learned], axis=0)
    assert (rejected == bad).mean() > 0.97


def test_extraction_on_held_out_pages():
    model = html_main.default_field()
    pages = [html_main.leaf_blocks(p) for p in html_main.labelled_pages(100, seed=5)]
    wrong = sum(s != b.label for p in pages for s, b in zip(model.decode(p), p, strict=True))
    assert wrong < 0.02 * sum(map(len, pages))
    assert html_main.extract(None, model) == html_main.extract("", model) == ""


def test_extraction_of_articles(spark):
    model = html_main.default_field()
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        parts = [html.unescape(" ".join(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)).split())) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert html_main.extract(r["html"], model) == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_conserves_tokens(spark, rule):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    found = attribution.token_counts(docs, tokenizer("byte_bpe_50k.json"), by_line=True, rule=rule).collect()
    encode = attribution._encoder(tokenizer("byte_bpe_50k.json"))
    for d in docs.collect():
        own = sorted((r for r in found if r["doc_id"] == d["doc_id"]), key=lambda r: r["start"])
        text = f"{d['source']}\n{d['lang']}\n{d['text']}\n"
        offsets = encode.encode(text, add_special_tokens=False).offsets
        assert sum(r["n_tokens"] for r in own) == len(offsets)
        if rule == "first":
            assert [r["n_tokens"] for r in own] == [sum(r["start"] <= a < r["start"] + r["n_chars"] for a, _ in offsets) for r in own]


def test_search_asks_every_open_bin():
    lengths = [1400] * 200 + [2696, 200] * 50
    bins = [[2 * x, 2 * x + 1] for x in range(150)]
    got = packing.improve(bins, lengths, 4096)
    assert sorted(i for b in got for i in b) == list(range(300))
    assert max(sum(lengths[i] for i in b) for b in got) <= 4096
    assert len(got) <= 130


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_search_ends_where_no_gift_improves(lengths):
    lengths.sort(reverse=True)
    got = packing.improve(packing.best_fit(lengths, 30), lengths, 30)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    fill = [sum(lengths[i] for i in b) for b in got]
    assert max(fill, default=0) <= 30
    if len(got) > -(-sum(fill) // 30):
        few = [[c for k in range(3) for c in itertools.combinations([lengths[i] for i in b], k)] for b in got]
        assert not [1 for x in range(len(got)) for y in range(len(got)) if x != y and fill[x] <= fill[y]
                    for a in few[x] for c in few[y] if 0 < sum(a) - sum(c) <= 30 - fill[y]]


def test_underfull_bins_of_all_blocks_are_packed_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 7)
    items = spark.createDataFrame([(i, 0, 0, 2, i) for i in range(40)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(items, 10).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(40))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(b)]).tolist()]
        assert [a for a, _ in sorted(b)] == ends[:-1] and ends[-1] <= 10
    assert len(bins) == 8


def test_cut_beside_a_mixed_tied_group():
    values = np.concatenate([np.zeros(900), np.arange(1, 101)])
    bad = values > 0
    bad[810:900] = True  # the last zero row is a rejected one
    rule = rules._grow({"a": values}, bad)
    assert (rules._covered(rule, {"a": values}, 1000) == (values > 0)).all()


def test_one_row_stays_of_each_component(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(3, a), (7, a), (7, b), (7, b), (None, a), (None, c), (None, c), (9, None), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(3, a), (7, b), (9, None), (None, c)]))


def test_formulas_and_open_heads():
    model = html_main.default_field()
    long = "This sentence of the article is long enough to be its text, and it ends as sentences do."
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1 in TeX</annotation></semantics></math>"
    body = f"<article><h1>A title</h1><p>{long}</p><p>{long} Here {formula} holds.</p><p>{long}</p></article>"
    expected = f"A title\n{long}\n{long} Here x=1 holds.\n{long}"
    for page in (f"<html><head><title>t</title></head><body>{body}</body></html>", f"<head><title>t</title>{body}",
                 f"<html><head><noscript><p>{long}</p></noscript><title>t</title>{body}"):
        assert html_main.extract(page, model) == expected
    blocks = html_main.leaf_blocks(f"<head><title>t</title> {long}")
    assert [x.text for x in blocks] == [long]
