"""The patient table from files on disk, and its rules by hand."""

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import catalog, patients
from voxloom.sources import dicom

PIXELS = np.zeros((2, 2), "u2")


def write(root, path, **tags):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(dicom.encode(tags, PIXELS) if tags else b"no header")


def table(df):
    return [tuple(r) for r in df.collect()]


def test_patients_from_files_to_a_table_and_back(spark, tmp_path):
    root = tmp_path / "root"
    write(root, "Zoe/T1/MR/s1/b.dcm", PatientName="Doe^Jane", PatientID=" A  1")
    write(root, "Zoe/T1/MR/s1/a.dcm")  # cannot be read: the next one by name counts
    write(root, "Zoe/T2/MR/s2/c.DCM", PatientName="DOE^JANE^", PatientID="b2")
    write(root, "Zoe/T2/MR/s2/c0.dcm", PatientName="Other", PatientID="c3")
    write(root, "Ann/MR/s/plain", PatientName="O'Hara-Smith", PatientID="9")  # no file named .dcm can be read
    write(root, "Ann/MR/s/x.dcm")
    write(root, "Bob/CT/s/a.dcm", PatientName="Bob", PatientID="1")
    write(root, "Bob/MR/a.dcm", PatientName="Bob", PatientID="1")  # in the named folder itself
    write(root, "Bob/MR/s/deep/a.dcm", PatientName="Bob", PatientID="1")  # below a series
    write(root, "MR/s/a.dcm", PatientName="", PatientID="q")  # a patient so named
    write(root, "loose.dcm", PatientName="None", PatientID="0")
    files = dicom.read_headers(spark, f"file://{root}", "*")
    got = patients.scan(files, f"file://{root}")
    assert got.columns == patients.COLUMNS
    assert table(got) == [("Bob", "", "", "", ""), ("MR", "", "", "q", ""), ("Zoe", "", "doe jane", "a 1; b2", ""), ("Ann", "", "o'hara smith", "9", "")]
    assert [r[0] for r in table(patients.scan(files, f"file://{root}/", exclude_empty=True))] == ["MR", "Zoe", "Ann"]
    assert {r[0]: r[2] for r in table(patients.scan(files, f"file://{root}", ["CT", "PET"]))}["Bob"] == "bob"
    out = str(tmp_path / "patients.csv")
    catalog.write_table(got.withColumn("patientID", F.concat(F.lit("no-"), "Directory")), out)
    before = catalog.read_table(spark, out)
    assert {r[0]: r[1] for r in table(patients.scan(files, f"file://{root}", previous=[before]))} == {x: f"no-{x}" for x in ("Ann", "Bob", "MR", "Zoe")}
    some = before.where("Directory in ('Ann', 'Bob')")
    assert [r[0] for r in table(patients.scan(files, f"file://{root}", previous=[some], omit_previous=True))] == ["MR", "Zoe"]


def test_previous_tables_in_order(spark):
    tags = F.create_map(F.lit("PatientName"), F.lit("x"))
    files = spark.createDataFrame([(f"/r/{d}/MR/s/a.dcm",) for d in "abcd"], "path string").withColumn("tags", tags)
    one = spark.createDataFrame([("a", "1"), ("b", ""), ("c", None)], "Directory string, patientID string")
    two = spark.createDataFrame([("a", "2", "d2"), ("b", "2", None), ("z", "9", "d9")], "Directory string, patientID string, day0Date string")
    three = spark.createDataFrame([("8", "d8")], "patientID string, day0Date string")
    got = table(patients.scan(files, "/r", previous=[one, three, two]))
    assert [(r[0], r[1], r[4]) for r in got] == [("a", "1", "d2"), ("b", "2", ""), ("c", "", ""), ("d", "", "")]


def test_odd_files(spark):
    none = spark.createDataFrame([], "path string, tags map<string,string>")
    assert table(patients.scan(none, "/r")) == [] and table(patients.leaves(none)) == []
    files = spark.createDataFrame([(None, None), ("/r/", None), ("/r/p/MR/s/", None), ("/rr/p/MR/s/a.dcm", {"PatientName": "n"}), ("a.dcm", None)], "path string, tags map<string,string>")
    assert table(patients.scan(files, "/r")) == [("p", "", "", "", "")]
    assert table(patients.leaves(files)) == [("/rr/p/MR", ["/rr/p/MR/s"])]


def test_files_of_other_names_are_tried_up_to_a_number(spark):
    rows = [(f"g{k % 2}", f"f{k:03}", None if k < 40 else {"PatientName": str(k)}) for k in range(60)]
    files = spark.createDataFrame(rows, "g string, name string, tags map<string,string>")
    assert table(patients.first_readable(files, ["g"])) == []
    assert sorted(table(patients.first_readable(files, ["g"], probed=21))) == [("g0", {"PatientName": "40"}), ("g1", {"PatientName": "41"})]
