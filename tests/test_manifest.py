"""Manifests of real folders, bounded samples and the report stream that survives a failure."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from voxloom.operators import catalog, manifest
from voxloom.streaming import reports


def test_folder_to_document_and_back(spark, tmp_path):
    folder, want = tmp_path / "models", {}
    (folder / "deep").mkdir(parents=True)
    for name, raw in {"a.h5": b"one", "b.cfg": b"[c]", "c.txt": b"x", ".gitignore": b"y", "models.json": b"{}"}.items():
        (folder / name).write_bytes(raw)
        if name in ("a.h5", "b.cfg"):
            want[name] = (hashlib.sha256(raw).hexdigest(), len(raw))
    (folder / "deep" / "z.h5").write_bytes(b"deep")
    (tmp_path / "urls.json").write_text(json.dumps({"a.h5": "https://x/a", "other": "https://x/o"}))
    made = manifest.build(manifest.scan(spark, f"file://{folder}"), manifest.read_urls(spark, f"file://{tmp_path}/urls.json"))
    out = f"file://{tmp_path}/out/models.json"
    manifest.write_manifest(made, out)
    with pytest.raises(FileExistsError):
        manifest.write_manifest(made, out, overwrite=False)
    manifest.write_manifest(made, out)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["models.json"]
    document = json.loads((tmp_path / "out" / "models.json").read_text())
    assert {n: (e["sha256"], e["bytes"]) for n, e in document.items()} == want and list(document) == sorted(document)
    assert document["a.h5"]["url"] == "https://x/a" and document["b.cfg"]["url"] == "" and document["a.h5"]["version"].endswith("Z")
    back = manifest.read_manifest(spark, out)
    assert {(r["name"], r["url"], r["sha256"], r["bytes"], r["version"]) for r in back.collect()} == {(n, e["url"], e["sha256"], e["bytes"], e["version"]) for n, e in document.items()}
    (folder / "a.h5").write_bytes(b"two")
    assert {r["name"]: r["status"] for r in manifest.verify(back, manifest.scan(spark, f"file://{folder}")).collect()} == {"a.h5": "digest", "b.cfg": "ok"}
    assert [r["name"] for r in manifest.select(back, ["b.cfg", "b.cfg"]).collect()] == ["b.cfg"]
    with pytest.raises(Exception, match="unknown model: z"):
        manifest.select(back, ["a.h5", "z"]).collect()


def test_what_is_no_manifest_is_refused(spark, tmp_path):
    for text in ("[1]", "no json", ""):
        with pytest.raises(Exception, match="not a manifest"):
            manifest.from_document(spark.createDataFrame([(text,)], "document string")).collect()
    empty = spark.createDataFrame([], "name string, bytes long, sha256 string, version string")
    with pytest.raises(ValueError):
        manifest.write_manifest(manifest.build(empty), f"file://{tmp_path}/m.json")
    twice = spark.createDataFrame([("a.h5", 1, "s", "v")] * 2, "name string, bytes long, sha256 string, version string")
    with pytest.raises(Exception, match="stands twice"):
        manifest.to_document(manifest.build(twice)).collect()


def test_bounded_samples_of_a_hot_group(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") < 30, "few").alias("g"), "id")
    got = catalog.bounded(rows.repartition(6), "g", "id", 9, 25).collect()
    again = catalog.bounded(rows.repartition(3), "g", "id", 9, 25).collect()
    assert set(got) == set(again)
    members = {}
    for r in rows.collect():
        members.setdefault(r["g"], []).append(r["id"])
    for g, ids in members.items():
        want = sorted(ids, key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())[:25]
        assert sorted(r["id"] for r in got if r["g"] == g) == sorted(want)
    assert catalog.bounded(rows, "g", "id", 8, 25).select("id").exceptAll(spark.createDataFrame(got).select("id")).count() > 0
    plan = catalog.bounded(rows, "g", "id", 9, 25)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_batch_that_runs_again_adds_nothing_twice(spark, tmp_path, monkeypatch):
    source, target, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "log"))
    spark.createDataFrame([(i, [0, 1, 1, 2]) for i in range(5)], "vec_id long, lab array<int>").write.parquet(source)
    schema = "vec_id long, lab array<int>"
    real, failed = reports.volume_report, []

    def breaking(volumes, *rest):
        rows = real(volumes, *rest)
        stop = F.udf(lambda i: 1 / 0 if i == 3 else i, "long")
        return rows.withColumn("vec_id", stop("vec_id"))

    monkeypatch.setattr(reports, "volume_report", breaking)
    with pytest.raises(Exception):
        reports.report_to_tables(spark, source, schema, target, checkpoint).awaitTermination()
    monkeypatch.setattr(reports, "volume_report", real)
    # A first attempt that wrote its batch but was lost before the batch was noted.
    spark.createDataFrame([(99, 9, 9, 9)], "vec_id long, segment1_mm3 long, segment2_mm3 long, segment3_mm3 long").write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{target}/batch=0")
    for _ in range(2):
        reports.report_to_tables(spark, source, schema, target, checkpoint).awaitTermination()
        rows = spark.read.option("header", True).option("sep", "\t").csv(target).collect()
        assert sorted((int(r["vec_id"]), r["segment1_mm3"], r["segment2_mm3"]) for r in rows) == [(i, "2", "1") for i in range(5)]
    spark.createDataFrame([(7, [3])], schema).write.mode("append").parquet(source)
    reports.report_to_tables(spark, source, schema, target, checkpoint).awaitTermination()
    assert spark.read.option("header", True).option("sep", "\t").csv(target).count() == 6
    assert not failed
