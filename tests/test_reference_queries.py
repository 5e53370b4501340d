import oracle
import pytest

from voxloom.operators import geometry, volumes
from voxloom.plans import catalog_queries, dicom_queries, ensemble_queries, geometry_queries, grid_queries, manifest_queries, metadata_queries, patient_queries  # noqa: F401
from voxloom.plans.volume_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert oracle.canonical(QUERIES[name](spark, SF).toPandas()) == oracle.canonical(duck.execute(SQL[name]).df())


def test_greedy_takes_each_leaf_and_key_once(spark):
    got = QUERIES["demix_greedy"](spark, SF).toPandas()
    assert not got.duplicated(["l_orderkey", "l_linenumber"]).any()
    assert not got.duplicated(["l_orderkey", "l_returnflag"]).any()


def test_greedy_choice_and_moves_by_hand(spark):
    rows = QUERIES["demix_keys"](spark, SF).toPandas()
    want, targets = set(), {}
    for order, some in rows.groupby("l_orderkey"):
        ranked = sorted(zip(-some["n"], some["l_linenumber"], some["l_returnflag"], strict=True))
        taken_leaves, taken_keys = set(), set()
        for n, leaf, key in ranked:
            if leaf not in taken_leaves and key not in taken_keys:
                taken_leaves.add(leaf)
                taken_keys.add(key)
                want.add((order, leaf, key, -n))
        whole = {leaf: key for leaf, own in some.groupby("l_linenumber") for key in own["l_returnflag"] if len(own) == 1 and (own["n"] == own["total"]).all()}
        leaves, keys = set(whole), set(whole.values())
        targets |= {(order, key): leaf for leaf, key in whole.items()}
        for _, leaf, key in ranked:
            if leaf not in leaves and key not in keys:
                leaves.add(leaf)
                keys.add(key)
                targets[order, key] = leaf
    assert {tuple(r) for r in QUERIES["demix_greedy"](spark, SF).select("l_orderkey", "l_linenumber", "l_returnflag", "n").collect()} == want
    got = QUERIES["demix_moves"](spark, SF).collect()
    assert len(got) == len(rows)
    assert all(r["target"] == targets.get((r["l_orderkey"], r["l_returnflag"])) for r in got)


def test_expressions_are_whitelisted(spark):
    from pyspark.sql import functions as F

    for text in ("__import__('os')", "A.b", "A + E", "A if B else A"):
        with pytest.raises(ValueError):
            volumes.volume_expr(text, {"A": F.lit(1.0), "B": F.lit(1.0)})


def test_null_volumes_and_empty_masks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None,)], "v array<double>")
    assert df.select(volumes.flip(F.col("v"), (1, 1, 1), (0,))).first()[0] is None
    with pytest.raises(Exception, match="mask is empty"):
        spark.createDataFrame([([1.0], [0])], "v array<double>, m array<int>").select(volumes.zscore(F.col("v"), F.col("m"))).collect()


def test_cascade_labels_by_hand(spark):
    n = len(metadata_queries.CASCADE)
    rows = {r["event_id"]: (r["final_label"], r["is_postcontrast"], r["is_derived"], r["confidence"]) for r in QUERIES["classify_cascade"](spark, SF).collect()}
    want = {
        2: ("Localizer(MPR_SAG)", False, True, 0.95), 4: ("Localizer", False, False, 0.9), 6: ("DWI", False, False, 0.9), 7: ("DWI(ADC)", False, True, 0.95), 11: ("DWI(EXP_ATTEN)", False, False, 0.95),
        13: ("SWI", False, True, 0.9), 15: ("SWI(PHASE)", False, False, 0.95), 22: ("Perfusion(PROJECTION)", False, True, 0.9), 25: ("T2w", False, True, 0.8), 27: ("T1n", False, False, 0.7),
        28: ("T1c", True, False, 0.8), 29: ("T1c(MIP)", True, True, 0.8), 31: ("T1c", True, False, 0.65), 33: ("T1n", False, False, 0.65), 35: ("T1c", True, False, 0.85),
        36: ("T1c", True, False, 0.8), 37: ("T1n", False, False, 0.85), 38: ("T1c", True, False, 0.85), 39: ("Unknown-derived", False, True, 0.3), 41: ("Unknown", False, False, 0.3), 44: ("T1n", False, False, 0.7),
    }
    runs = [k for k in range(max(rows) // n) if all(k * n + i in rows for i in range(n))]
    assert len(runs) > 5 and all({i: rows[k * n + i - 1] for i in want} == want for k in runs)


def test_classes_of_an_empty_slice_and_unknown_modes(spark):
    from pyspark.sql import functions as F

    none = F.array().cast("array<int>")
    rules = [{(): "all"}, {(): "any"}, {(): "none"}, {(1,): "all"}, {(1,): "any"}, {(1,): "none"}, {}]
    assert list(spark.range(1).select(*[geometry.passes_classes(none, r) for r in rules]).first()) == [True, False, True, False, False, True, True]
    with pytest.raises(ValueError):
        geometry.passes_classes(none, {(1,): "some"})


def test_slices_are_not_cut_away_whole(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(list(map(float, range(5))),)], "v array<double>")
    cut = lambda p: geometry.undo_pad_slices(F.col("v"), (1, 1, 5), p)
    assert [(df.select(cut(p)[0]).first()[0], cut(p)[1]) for p in (0, 1, 9)] == [([0.0, 1.0, 2.0, 3.0, 4.0], (1, 1, 5)), ([1.0, 2.0, 3.0], (1, 1, 3)), ([1.0, 2.0, 3.0], (1, 1, 3))]


def test_shape_and_record_of_an_aligned_volume(spark):
    from pyspark.sql import functions as F

    for plane in volumes.PLANES:
        aligned, shape, steps = geometry.align(F.col("v"), (2, 3, 4), plane, (3, 3), 1)
        assert shape == geometry.input_shape((2, 3, 4), plane, (3, 3), 1)
        df = spark.createDataFrame([(list(map(float, range(24))),), (None,)], "v array<double>")
        back = volumes.apply_steps(aligned, shape, geometry.from_record(geometry.to_record(steps)), reverse=True)[0]
        assert [r[0] for r in df.select(back).collect()] == [list(map(float, range(24))), None]
