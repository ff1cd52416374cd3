"""Written sets: whole or not there."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skytile.sources import sinks


def test_files_are_put_together_in_order(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i % 7}.txt", j % 2, j, f"{i}.{j};") for i in range(21) for j in (3, 1, 2)]
    path = sinks.write_texts(spark.createDataFrame(rows, "name string, position int, sub long, text string"), f"file://{tmp_path}/set")
    assert sinks.committed(spark, path)
    want = {}
    for name, position, sub, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want.setdefault(name, []).append(text)
    got = {}
    for folder, _, names in os.walk(tmp_path / "set"):
        for n in names:
            full = os.path.join(folder, n)
            if "part-" in full and not n.endswith(".crc"):
                got[full.split("/part-")[1].split("/", 1)[1]] = open(full).read()
    assert {k: sorted(v.split(";")) for k, v in got.items()} == {k: sorted("".join(v).split(";")) for k, v in want.items()}
    assert not [n for n in os.listdir(tmp_path / "set") if n.startswith("_staged")]
    assert open(tmp_path / "set" / sinks.MARKER).read() == str(len(want))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("f"), "id").alias("name"), F.lit(0).alias("position"), F.lit(0).alias("sub"), F.when(F.col("id") == 13, F.raise_error(F.lit("stop"))).otherwise("x").cast("string").alias("text"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_texts(rows, f"file://{tmp_path}/set")
    assert not sinks.committed(spark, f"file://{tmp_path}/set")
    assert not os.path.exists(tmp_path / "set") or not [n for n in os.listdir(tmp_path / "set") if n.startswith(("part-", "_staged"))]


def test_coco_documents_of_shards(spark, tmp_path):
    images = spark.createDataFrame([("train", i, f"t{i}", 10, 20) for i in range(1, 6)] + [("val", 1, "v", 10, 20)], "split string, id long, file_name string, width int, height int")
    anns = spark.createDataFrame([("train", i, 1 + i % 4, 2) for i in range(1, 9)], "split string, id long, image_id long, category_id int")
    classes = spark.createDataFrame([(2, "b", "s"), (1, "a", "s")], "id int, name string, supercategory string")
    sinks.write_texts(sinks.coco_texts(images, anns, classes, 2), f"file://{tmp_path}/coco")
    docs = {}
    for folder, _, names in os.walk(tmp_path / "coco"):
        for n in names:
            if n.endswith(".json"):
                docs[n] = json.load(open(os.path.join(folder, n)))
    assert sorted(docs) == ["train-00000.json", "train-00001.json", "train-00002.json", "val-00000.json"]
    assert [i["id"] for n in sorted(docs) for i in docs[n]["images"]] == [1, 2, 3, 4, 5, 1]
    assert sorted(a["id"] for d in docs.values() for a in d["annotations"]) == list(range(1, 9)) and not docs["val-00000.json"]["annotations"]
    assert all([c["id"] for c in d["categories"]] == [1, 2] for d in docs.values())


def test_box_text_is_a_file_for_each_scene(spark, monkeypatch):
    """However many tasks hold a scene's boxes; and the files are found by folder, not one by one."""
    from skytile.plans import source_queries
    from skytile.plans.registry import QUERIES

    asked = []
    monkeypatch.setattr(source_queries.annotations, "read_box_text", lambda s, path, own=source_queries.annotations.read_box_text: asked.append(path) or own(s, path))
    got = QUERIES["a4_box_text"](spark, "/root/testdata/sf0.001")
    scenes = got.select("prefix").distinct().count()
    assert len(got.inputFiles()) == scenes > 1
    assert [p.rsplit("/", 1)[1] for p in asked] == ["part-*"]
