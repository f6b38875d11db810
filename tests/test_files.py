"""Files written as one transaction, large documents read in byte ranges, trees listed by tasks."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annolake.sinks import files as named_files
from annolake.sinks.files import write_large_files, write_named_files
from annolake.sources import documents
from annolake.sources.documents import list_elements
from annolake.sources.files import list_assets, read_coco

AWKWARD = '{}[]",:\\ aé\n'


def element(rnd, depth=0):
    junk = lambda: "".join(rnd.choice(AWKWARD) for _ in range(rnd.randrange(14)))
    made = {}
    for _ in range(rnd.randrange(0, 4)):
        kind = rnd.randrange(6 if depth < 3 else 3)
        made[junk() + str(rnd.random())] = element(rnd, depth + 1) if kind == 3 else [element(rnd, depth + 1)] if kind == 4 else [junk(), None, [[1.5, 2], [3]], [], [], []][kind]
    return made


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent,ascii_only,mark", [(None, True, ""), (None, False, "﻿"), (1, True, "")])
def test_elements_of_a_document_read_in_many_ranges(spark, tmp_path, small_ranges, indent, ascii_only, mark):
    rnd, expected = random.Random(f"{indent}{mark}"), []
    for name in ("a", "b"):
        document = {
            "info": {"a": {"b": 1}, "c": [{"x": "]}"}], "images": [{"no": 1}]}, "licenses": [], "numbers": [1, [{"deep": 1}]],
            "images": [element(rnd) for _ in range(40)], "weird": [[{"q": 1}]], "text": '"],"images":[{',
            "annotations": [element(rnd) for _ in range(30)] if name == "a" else [], "tail": {"images": [{"z": 2}]}}
        (tmp_path / f"{name}.json").write_text(mark + json.dumps(document, indent=indent, ensure_ascii=ascii_only))
        expected += [(name, part, one) for part in ("images", "annotations") for one in document[part]]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    rows = list_elements(spark, str(tmp_path), ["images", "annotations"]).orderBy("file", "place").collect()
    assert [(r["file"][-6], r["list"], json.loads(r["text"])) for r in rows] == expected


def test_document_without_elements(spark, tmp_path):
    (tmp_path / "instances_train.json").write_text('{"images":[],"annotations":[ ]}')
    assert [df.count() for df in read_coco(spark, str(tmp_path / "*.json"))] == [0, 0, 0]


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files)


def test_named_files_keep_empty_ones_and_replace_the_old_set(spark, tmp_path):
    target = str(tmp_path / "out")
    rows = [("train/a.txt", 2, "two"), ("train/a.txt", 1, "one "), ("val/b.txt", 1, ""), ("val/c.txt", 1, None)]
    df = spark.createDataFrame(rows, "name string, place int, t string").repartition(3)
    for text in ("t", "name"):
        write_named_files(df, target, F.col("name"), F.col(text), ["place"])
    assert tree(target) == ["train/a.txt", "val/b.txt", "val/c.txt"] and os.listdir(tmp_path) == ["out"]
    write_named_files(df, target, F.col("name"), F.col("t"), ["place"])
    assert (tmp_path / "out/train/a.txt").read_text() == "one two" and (tmp_path / "out/val/b.txt").read_text() == ""
    write_named_files(df.limit(0), target, F.col("name"), F.col("t"))
    assert tree(target) == []


@pytest.mark.parametrize("bad", ["failing", "outside"])
def test_an_aborted_job_leaves_nothing_and_keeps_the_old_set(spark, tmp_path, bad):
    target = str(tmp_path / "out")
    df = spark.range(40).repartition(4).withColumn("name", F.concat(F.lit("x/"), F.col("id").cast("string")))
    write_named_files(df.where("id < 3"), target, F.col("name"), F.lit("old"), whole=True)
    text = F.when(F.col("id") == 39, F.raise_error(F.lit("no text"))).otherwise(F.lit("new")) if bad == "failing" else F.lit("new")
    name = F.when(F.col("id") == 39, F.lit("../y")).otherwise(F.col("name")) if bad == "outside" else F.col("name")
    with pytest.raises(PySparkException):
        write_named_files(df, target, name, text, whole=True)
    assert os.listdir(tmp_path) == ["out"] and tree(target) == ["x/0", "x/1", "x/2"]
    assert (tmp_path / "out/x/0").read_text() == "old"


def test_tree_is_listed_with_empty_files_and_without_hidden_ones(spark, tmp_path):
    names = [f"d{i % 7}/e{i % 3}/f{i}.{'PNG' if i % 2 else 'txt'}" for i in range(300)] + ["top.png", "d0/.hid.png", "_x/y.png", "d1/sp ace+%é.png"]
    for i, name in enumerate(names):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text("x" * (i % 5))
    os.makedirs(tmp_path / "void")
    seen = {os.path.relpath(r["path"], tmp_path): (r["size"], r["mtime"]) for r in list_assets(spark, str(tmp_path)).collect()}
    assert set(seen) == {n for n in names if not n.startswith("_") and "/." not in n}
    assert all(seen[n] == (os.stat(tmp_path / n).st_size, os.stat(tmp_path / n).st_mtime_ns) for n in seen)
    assert list_assets(spark, str(tmp_path), ["png"]).count() == 150 + 2
    assert {os.path.basename(r["path"]) for r in list_assets(spark, f"file:{tmp_path}", glob="f1?.*").collect()} == {f"f{i}.{'PNG' if i % 2 else 'txt'}" for i in range(10, 20)}
    assert list_assets(spark, str(tmp_path / "missing")).count() == 0


def test_a_large_file_is_sorted_and_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """one task sorted and wrote all lines of a document."""
    pieces, found = [], named_files.list_tree
    monkeypatch.setattr(named_files, "list_tree", lambda *a: pieces.append(found(*a)) or pieces[-1])
    df = spark.range(5000).selectExpr("if(id % 5 = 0, '_val/x.json', 'f.json') as name", "id", "concat('line ', id, '\n') as t").orderBy(F.rand(3))
    write_large_files(df, f"{tmp_path}/out", F.col("name"), F.col("t"), ["id"])
    assert len([r for r in pieces[0].collect() if "/ff.json/" in r["path"]]) > 8
    assert os.listdir(tmp_path) == ["out"] and tree(tmp_path / "out") == ["_val/x.json", "f.json"]
    for name, rest in (("_val/x.json", [0]), ("f.json", [1, 2, 3, 4])):
        assert (tmp_path / "out" / name).read_text() == "".join(f"line {i}\n" for i in range(5000) if i % 5 in rest)
    write_large_files(df.limit(0), f"{tmp_path}/out", F.col("name"), F.col("t"), ["id"])
    assert tree(tmp_path / "out") == []
    with pytest.raises(PySparkException):
        write_large_files(df, f"{tmp_path}/out", F.lit("../y"), F.col("t"), ["id"])
    assert os.listdir(tmp_path) == ["out"]


@pytest.mark.parametrize("chunk", [1, 60, 1 << 20])
def test_elements_are_found_in_chunks_of_any_size(spark, tmp_path, small_ranges, monkeypatch, capsys, chunk):
    """the text of every element went through windows, joins and an aggregate."""
    rnd = random.Random(chunk)
    document = {"info": {"a": {"b": "}"}, "c": 1}, "deep": [[{"q": [{"r": 1}]}, {"s": "]["}], {"t": {}}], "ke\"y\\": [{"u": 1}], "images": [],
                "images ": [{"v": 2}], "annotations": [{"long": [{"x": i} for i in range(200)]}, *[element(rnd) for _ in range(40)]], "last": [{"w": 3}]}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=chunk % 2 or None))
    monkeypatch.setattr(documents, "CHUNK", chunk)
    rows = list_elements(spark, str(tmp_path), ["images", "annotations"])
    assert [json.loads(r["text"]) for r in rows.orderBy("place").collect()] == document["annotations"]
    rows.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert [json.loads(r["text"]) for r in list_elements(spark, str(tmp_path), ["deep"]).collect()] == [{"t": {}}]
