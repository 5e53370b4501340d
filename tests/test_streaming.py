from voxloom.streaming import reports


def test_files_are_reported_once_over_restarts(spark, tmp_path):
    schema, at = "vec_id long, lab array<int>", f"file://{tmp_path}"
    rows = [(1, [0, 1, 1, 2]), (2, [3, 3, 3, 3])]
    for k in range(2):
        spark.createDataFrame(rows[k : k + 1], schema).write.mode("append").parquet(f"{at}/in")
        reports.report_new_files(spark, f"{at}/in", schema, f"{at}/out", f"{at}/check", voxel=0.5).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{at}/out").collect())
    assert got == [(1, 1, 0, 0), (2, 0, 0, 2)]
