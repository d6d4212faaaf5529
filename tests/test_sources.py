import csv
import gzip
import io
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import files as FS
from quarry.sources import passages as PS


def _write_tsv(path, rows, header):
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "wt", newline="") as f:
        w = csv.writer(f, delimiter="\t")
        if header:
            w.writerow(header)
        w.writerows(rows)


def test_passage_tsv_edge_cases(spark):
    d = tempfile.mkdtemp()
    rows = [("1", 'He said "hi"', "T1"), ("2", "two\nlines", "T2"), ("1", "second copy", "T1b"),
            ("3", 'tab\tinside', 'q"t')]
    for name in ("p.tsv", "p.tsv.gz"):
        path = os.path.join(d, name)
        _write_tsv(path, rows, ["id", "text", "title"])
        got = {r["id"]: (r["title"], r["text"], r["dataset"]) for r in PS.passage_table(spark, path).collect()}
        assert got[1] == ("T1b", "second copy", None)          # last duplicate wins, missing dataset -> null
        assert got[2] == ("T2", "two\nlines", None)            # newline inside quotes
        assert got[3] == ('q"t', "tab\tinside", None)
        raw = FS.read_passage_tsv(spark, path).orderBy("line_no").collect()
        assert [r["line_no"] for r in raw] == [0, 1, 2, 3]
        assert raw[0]["text"] == 'He said "hi"'               # doubled quotes


def test_qa_literal_parsing(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "qa.tsv")
    _write_tsv(path, [("q1", "['a', \"b's\", 'c\\'d']"), ("q2", "[]"), ("q3", '["x"]')], None)
    got = {r["question"]: r["answers"] for r in FS.read_qa_tsv(spark, path).collect()}
    assert got == {"q1": ["a", "b's", "c'd"], "q2": [], "q3": ["x"]}


def test_qa_roundtrip_through_writer(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("why?", ["it's", 'say "x"', "back\\slash"])], "question string, answers array<string>")
    FS.write_qa_tsv(df, os.path.join(d, "out"))
    back = FS.read_qa_tsv(spark, os.path.join(d, "out")).first()
    assert back["answers"] == ["it's", 'say "x"', "back\\slash"]


def test_json_lines_and_array(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(1, "é", None), (2, "b", "x")], "id long, s string, n string")
    FS.write_json_items(df, os.path.join(d, "a.jsonl"))
    FS.write_json_items(df, os.path.join(d, "b.json"))
    for p in ("a.jsonl", "b.json"):
        back = FS.read_json_items(spark, os.path.join(d, p), schema="id long, s string, n string")
        assert sorted((r["id"], r["s"], r["n"]) for r in back.collect()) == [(1, "é", None), (2, "b", "x")]


def test_gold_passages_last_wins(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "gold.json")
    with open(path, "w") as f:
        f.write('{"data": [{"question": "Q", "question_tokens": "q", "example_id": 1, "title": "A", "context": "c"},'
                ' {"question": "Q", "example_id": 2, "title": "B", "context": "d"}]}')
    gold, canon = FS.read_gold_passages(spark, path)
    g = {r["key"]: r["id"] for r in gold.collect()}
    assert g == {"Q": 2, "q": 1}
    assert {r["key"]: r["canonical"] for r in canon.collect()} == {"q": "Q", "Q": "Q"}


def test_line_numbers_span_part_files(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "many")
    spark.range(0, 100).repartitionByRange(5, "id").select(F.col("id").cast("string").alias("id"),
                                                           F.lit("t").alias("text"), F.lit("x").alias("title"),
                                                           F.lit(None).cast("string").alias("dataset")) \
        .write.option("sep", "\t").option("header", "true").csv(path)
    df = FS.dense_index(FS.read_passage_tsv(spark, path), list(FS.INPUT_ORDER), "pos")
    assert all(r["pos"] == r["id"] for r in df.collect())


def test_lookup_strict_and_loose(spark):
    store = spark.createDataFrame([(1, "t", "x", None)], "id long, title string, text string, dataset string")
    ids = spark.createDataFrame([(1,), (9,)], "id long")
    loose = sorted((r["id"], r["title"]) for r in PS.lookup(ids, store, strict=False).collect())
    assert loose == [(1, "t"), (9, None)]
    try:
        PS.lookup(ids, store).collect()
    except Exception as exc:  # noqa: BLE001
        assert "invalid passage id" in str(exc)
    else:
        raise AssertionError("unknown id accepted in strict mode")


def test_json_lines_gzip_line_order(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "items.jsonl.gz")
    with gzip.open(path, "wt") as f:
        for i in range(50):
            f.write('{"question": "q%d", "answers": ["a"]}\n' % i)
    df = FS.read_json_items(spark, path, schema="question string, answers array<string>")
    assert [r["question"] for r in df.orderBy("line_no").collect()] == [f"q{i}" for i in range(50)]


def _random_tsv(seed, n, crlf=False):
    """Records with quoted line feeds, doubled and stray quotes, empty fields, blank lines; as text and as csv reads it."""
    rng = random.Random(seed)
    lines = []
    for i in range(n):
        fields = [str(i)]
        for _ in range(2):
            kind = rng.random()
            body = "".join(rng.choices(["a", "word ", "\n", "\t", '""', "é", "\n\n", " "], k=rng.randint(1, 12)))
            if kind < 0.5:
                fields.append('"' + body + 'z"')
            elif kind < 0.8:
                fields.append("plain" + rng.choice(["", ' say "hi"', 'x"y']))
            else:
                fields.append('"' + "q" * rng.randint(1, 40) + '"')
        lines.append("\t".join(fields))
        if rng.random() < 0.1:
            lines.append("")
    return "id\ttext\ttitle\n" + "\n".join(lines) + ("\n" if seed % 2 else "")


@pytest.mark.parametrize("seed", range(2))
def test_quoted_tsv_is_the_same_from_one_and_from_many_splits(spark, tmp_path, seed):
    text = _random_tsv(seed, 150)
    path = tmp_path / "p.tsv"
    path.write_text(text, newline="")
    want = [tuple(r) for r in list(csv.reader(io.StringIO(text, newline=""), delimiter="\t"))[1:] if r]
    seen = []
    for size, cost in ((1 << 20, 1 << 20), (len(text.encode()) // 60, 0)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(cost))
        try:
            seen.append(spark.read.text(str(path)).rdd.getNumPartitions())
            records = FS.read_passage_tsv(spark, str(path))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        got = records.orderBy("line_no").collect()
        assert [(str(r["id"]), r["text"], r["title"]) for r in got] == want
        assert [r["line_no"] for r in got] == list(range(len(want)))
    assert seen[0] == 1 and seen[1] >= 50


def test_carriage_returns_stay_inside_quotes_only(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_bytes(b'id\ttext\ttitle\r\n1\t"a\r\nb"\tt\r\n2\tx\ty\r\n')
    got = FS.read_tsv_records(spark, str(path)).orderBy("line_no").collect()
    assert [r["record"] for r in got] == ["id\ttext\ttitle", '1\t"a\r\nb"\tt', "2\tx\ty"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _text_rows(plan, operator):
    """The plan lines of an operator whose output carries a text column."""
    return [x for x in plan.split("\n") if operator in x and "text" in x]


def test_numbering_moves_keys_not_texts(spark, tmp_path):
    store = str(tmp_path / "store")
    spark.range(300).select("id", F.lit("t").alias("title"), F.concat(F.lit("text "), "id").alias("text"), F.lit("d").alias("dataset")).write.parquet(store)
    s = PS.scan_store(spark, store)
    got = PS.key_order_positions(s)
    assert [r["id"] for r in got.orderBy("pos").collect()] == sorted(range(300), key=str)
    assert "text" not in _plan(got)
    df = s.select(F.lit(0).alias("file_no"), F.lit("f").alias("src_file"), (F.col("id") * 7).alias("line_no"), "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = FS.dense_index(df, list(FS.INPUT_ORDER), "index")
        plan = _plan(numbered)
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and not _text_rows(plan, "Sort [")
        assert "Scan parquet" in plan                    # the rows come from the file, not from a checkpoint
        assert all(r["text"] == f"text {r['index']}" for r in numbered.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_last_wins_aggregates_numbers_only(spark):
    rows = [(i % 7, f"text {i}", 0, "f", i) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, file_no int, src_file string, line_no long")
    best = FS.last_wins(df)
    plan = _plan(best)
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "LeftSemi" in plan
    assert sorted((r["id"], r["text"]) for r in best.collect()) == sorted((i % 7, f"text {i}") for i in range(93, 100))


def test_json_array_files_are_streams_of_their_partitions(spark, tmp_path):
    df = spark.range(1000).repartition(5).select("id", F.concat(F.lit('quote " and\\nline '), "id").alias("s"), F.lit(None).cast("string").alias("n"))
    path = str(tmp_path / "items.json")
    FS.write_json_items(df, path)
    items = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            items += json.load(open(os.path.join(path, name)))
    assert sorted(i["id"] for i in items) == list(range(1000)) and all(i["n"] is None for i in items)
    back = FS.read_json_items(spark, path, schema="id long, s string, n string")
    assert back.count() == 1000 and back.where(F.col("s") != F.concat(F.lit('quote " and\\nline '), "id")).count() == 0
    assert "Exchange SinglePartition" not in _plan(df)


def test_variant_items_from_lines_and_arrays(spark, tmp_path):
    items = [{"question": f"q{i}", "free": {"deep": [i, None]}} for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, items)))
    (tmp_path / "b.json").write_text(json.dumps(items, indent=1))
    for name in ("a.jsonl", "b.json"):
        got = FS.read_variant_items(spark, str(tmp_path / name)).orderBy("line_no")
        assert [(r[0], json.loads(r[1])) for r in got.select("line_no", F.to_json("item")).collect()] == list(enumerate(items))


def test_store_of_copies_shuffles_no_text(spark, tmp_path):
    """Records with line feeds over three files: the last file's copy wins, and no exchange or sort carries a text."""
    paths = [str(tmp_path / f"v{i}.tsv") for i in range(3)]
    for i, path in enumerate(paths):
        spark.range(200).repartition(3).select("id", F.lit("t").alias("title"), F.concat(F.lit('a "quoted"\nline\n\n'), "id", F.lit(f" v{i}")).alias("text"),
                                F.lit("d").alias("dataset")).createOrReplaceTempView("copies")
        FS.write_passage_tsv(spark.table("copies"), path)
    split = str(max(f.stat().st_size for f in (tmp_path / "v0.tsv").iterdir()) // 7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = FS.last_wins(FS.read_passage_tsv(spark, paths))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = _plan(best)
    assert "LeftSemi" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert sorted((r["id"], r["text"]) for r in best.collect()) == [(i, f'a "quoted"\nline\n\n{i} v2') for i in range(200)]


def test_lookup_sorts_no_texts(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.range(50).select("id", F.lit("t").alias("title"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("dataset")).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = PS.lookup(spark.range(0, 50, 7), spark.read.parquet(path))
        assert "SortMergeJoin" not in _plan(got) and "Sort [" not in _plan(got)
        assert sorted(r["id"] for r in got.collect()) == list(range(0, 50, 7))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_store_inputs_are_written_compressed(spark, tmp_path):
    """A name ending in .gz gives gzip parts, which read back as they were, with the last file's copies winning."""
    rows = [(1, 'say "x"', "two\nlines," * 400, "d"), (2, None, "tab\there", None), (3, "t", "", "d")]
    passages = spark.createDataFrame(rows, "id long, title string, text string, dataset string")
    paths = [str(tmp_path / f"v{i}.tsv.gz") for i in (1, 2)]
    for path, df in zip(paths, (passages, passages.where("id > 1").withColumn("title", F.lit("later"))), strict=True):
        FS.write_passage_tsv(df, path)
    parts = [f for f in os.listdir(paths[0]) if f.startswith("part-")]
    assert parts and all(f.endswith(".gz") for f in parts)
    assert sum(os.path.getsize(os.path.join(paths[0], f)) for f in parts) < 1000
    PS.build_passage_store(spark, paths, str(tmp_path / "store"))
    got = {r["id"]: (r["title"], r["text"]) for r in PS.scan_store(spark, str(tmp_path / "store")).collect()}
    assert got[1] == ('say "x"', rows[0][2]) and got[2] == ("later", "tab\there") and got[3][0] == "later"
