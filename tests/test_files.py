"""Readers, writers, whole plans and the corpus stream on files."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from personaloom.operators import blocks, pairing
from personaloom.plans import batch_job
from personaloom.plans.corpus_build import build_corpus, write_corpus
from personaloom.plans.mention_report import mention_report
from personaloom.registry import fixtures as X
from personaloom.sources import readers, writers
from personaloom.streaming.corpus import start_corpus_stream


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_bad_line_policies(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", ["{bad", '{"a": 1}', "", "   ", "7", '{"a": 2}', '{"a": '])
    rows = readers.read_json_lines(spark, path, "a int")
    assert sorted(r["a"] for r in readers.good_rows(rows).collect()) == [1, 2]
    assert sorted(r["original_line"] for r in readers.bad_rows(rows).collect()) == sorted(
        ["7", "{bad", '{"a": ']
    )
    assert readers.read_json_lines(spark, path, "a int", on_bad="skip").count() == 2
    with pytest.raises(Exception):
        readers.read_json_lines(spark, path, "a int", on_bad="fail").collect()
    with pytest.raises(ValueError):
        readers.read_json_lines(spark, path, "a int", on_bad="other")


def test_positional_pairs_of_files(spark, tmp_path):
    left = write(tmp_path / "l.jsonl", ['{"a": 1}', "bad", '{"a": 3}', "", '{"a": 5}', '{"a": 6}'])
    right = write(tmp_path / "r.jsonl", ['{"b": "u"}', '{"b": "v"}', '{"b": "w"}', '{"b": "x"}', '{"b": "y"}'])
    one = readers.parse_numbered(readers.read_numbered_lines(spark, left), "a int")
    two = readers.parse_numbered(readers.read_numbered_lines(spark, right), "b string")
    both = pairing.pair_by_position(
        one.select("line_number", F.col("record").alias("l")), two.select("line_number", F.col("record").alias("r"))
    )
    got = [(n, l and l["a"], r and r["b"]) for n, l, r in both.orderBy("line_number").collect()]
    assert got == [(1, 1, "u"), (2, None, "v"), (3, 3, "w"), (4, None, "x"), (5, 5, "y")]


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name in ("p1", "p2"):
        write(tmp_path / f"{name}.txt", [f"{name} line {i}" for i in range(1000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.read_numbered_lines(spark, str(tmp_path)).orderBy("line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line_number"] for r in rows] == list(range(1, 2001))
    assert [r["value"] for r in rows] == [f"{n} line {i}" for n in ("p1", "p2") for i in range(1000)]


TEXTS = ['tab\there "quoted"', "line\nbreak\\", "", "plain é €", '"', "'single'", "\\t \\"]


def test_corpus_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "Online Ad", t) for i, t in enumerate(TEXTS)], "id string, content_type string, text string")
    writers.write_corpus_tsv(rows, str(tmp_path / "c"))
    back = readers.read_corpus_tsv(spark, str(tmp_path / "c")).collect()
    assert {r["UniqueID"]: json.loads(r["Text"]) for r in back} == {str(i): t for i, t in enumerate(TEXTS)}


def test_quoted_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "i string, text string")
    writers.write_tsv(rows, str(tmp_path / "t"))
    back = {r["i"]: r["text"] or "" for r in readers.read_tsv(spark, str(tmp_path / "t"), "i string, text string").collect()}
    assert back == {str(i): t for i, t in enumerate(TEXTS)}


CELLS = ["plain", "two\nlines", "", '"', 'quote "inside"\nand\n\nblank lines', "tab\there", "é 日本\n", "end\\", "a,b", None]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_one_large_multiline_file_is_read_by_many_tasks(spark, tmp_path, line_end):
    """Records that lie across one split or several, against Python's own reader."""
    path = tmp_path / "t.tsv"
    rows = [[str(i), CELLS[i % len(CELLS)], CELLS[i * 7 % 9] if i % 50 else "long\n" * 400 + "end"] for i in range(1500)]
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, delimiter="\t", lineterminator=line_end)
        out.writerow(["id", "a", "b"])
        out.writerows(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 8
        got = readers.read_tsv(spark, str(path)).collect()
        named = readers.read_tsv(spark, str(path), "x string, y string, z string")
        assert named.columns == ["x", "y", "z"] and named.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with path.open(newline="", encoding="utf-8") as f:
        want = list(csv.reader(f, delimiter="\t"))[1:]
    assert sorted([r["id"], r["a"] or "", r["b"] or ""] for r in got) == sorted(want)


def test_multiline_files_of_a_folder(spark, tmp_path):
    """Every file has its header; one holds nothing else, one is empty, one ends inside quotes."""
    (tmp_path / "a.tsv").write_text('k\tv\n1\t"x\ny"\n\n2\tz\n')
    (tmp_path / "b.tsv").write_text("k\tv\n")
    (tmp_path / "c.tsv").write_text("")
    (tmp_path / "d.tsv").write_text('k\tv\n3\t"never\nclosed\n')
    got = sorted(map(tuple, readers.read_tsv(spark, str(tmp_path), "k string, v string").collect()))
    assert [r[0] for r in got] == ["1", "2", "3"] and got[0][1] == "x\ny" and got[2][1].startswith("never\nclosed")


def test_json_sink_keeps_nulls(spark, tmp_path):
    writers.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"a": 1, "b": None}


def test_corpus_plan(spark, sf_dir, tmp_path):
    records = X.records(spark, sf_dir)
    stored = write_corpus(records, str(tmp_path))
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, build_corpus(records).collect()))
    assert readers.read_corpus_tsv(spark, f"{tmp_path}/corpus_tsv").count() == stored.count()
    assert spark.read.json(f"{tmp_path}/stats").count() == 5


def test_mention_plan(spark, sf_dir, tmp_path):
    records = blocks.add_content_pairs(X.records(spark, sf_dir))
    order = ["conv_id", "turn", "content_pair_index"]
    report = mention_report(records, str(tmp_path), blocks.CONTENT_TYPES, order)
    sizes = {name: df.count() for name, df in report.items()}
    assert all(sizes.values()), sizes
    assert (tmp_path / "details" / "type_name=Blog_News_Article_Comment").exists()


def test_batch_job_goes_on_behind_its_marker(spark, tmp_path):
    profiles = write(tmp_path / "profiles.jsonl", ['{"Unique ID": "p1", "n": 1.50, "é": null}', "{bad", '{"n": 2}', "[1]", '{"Unique ID": "p5"}', '{"Unique ID": "p6"}'])
    people = write(tmp_path / "people.jsonl", ['{"Abstract": " A ", "Early_Life": "E\\nx"}', "{}", "{}", "{}", "broken"])
    args = (profiles, people, str(tmp_path / "out"), "m", "Be short.", 9)

    def results():
        done = batch_job.prepare_batches(spark, *args)
        lines = {k: sorted(r[0] for r in done[k].collect()) for k in ("requests", "metadata")}
        return lines, sorted(map(tuple, done["errors"].collect())), tuple(done["counts"].first())

    lines, errors, counts = first = results()
    assert counts == (2, 3)
    assert [(n, e, p) for n, e, p, _ in errors] == [(2, "JSON Decode Error", "{bad"), (4, "JSON Decode Error", "[1]"), (5, "JSON Decode Error", '{"Unique ID": "p5"}')]
    known = {m["line_number"]: m for m in map(json.loads, lines["metadata"])}
    assert known[1]["synthetic_pii_input"] == {"Unique ID": "p1", "n": 1.5, "é": None}
    assert known[1]["real_person_text_input"] == "A \n\nE\nx" and known[3]["real_person_text_input"] == ""
    asked = {r["custom_id"]: r for r in map(json.loads, lines["requests"])}
    assert set(asked) == {"p1", known[3]["custom_id"]} and len(known[3]["custom_id"]) == 36
    assert asked["p1"]["body"]["messages"][1]["content"] == known[1]["user_prompt"]
    assert '{"Unique ID": "p1", "n": 1.50, "é": null}' in known[1]["user_prompt"]
    # the next calls read what is there: other inputs change nothing, a part without its marker is written again
    write(tmp_path / "profiles.jsonl", ['{"Unique ID": "other"}'])
    for part in ("requests", "counts"):
        (tmp_path / "out" / part / "_SUCCESS").unlink()
    assert results() == first


def test_corpus_stream(spark, sf_dir, tmp_path):
    records = X.records(spark, sf_dir)
    writers.write_table(records, f"{tmp_path}/in")
    arriving = spark.readStream.schema(records.schema).parquet(f"{tmp_path}/in")
    start_corpus_stream(arriving, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, build_corpus(records).collect()))


def test_numbered_lines_keep_all_lines_when_splits_change(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(30_000).selectExpr("concat('line ', id)").coalesce(2).write.text(path)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        lines = readers.read_numbered_lines(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
        got = sorted((r.line_number, r.value) for r in lines.collect())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [n for n, _ in got] == list(range(1, 30_001))
    assert sorted(v for _, v in got) == sorted(f"line {i}" for i in range(30_000))
