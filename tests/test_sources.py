import pytest
from pyspark.sql import functions as F

from assayer.sources import library, lines, records, sinks, structures


def write(path, text):
    path.write_text(text)
    return str(path)


def test_library_lines(spark, tmp_path):
    p = write(tmp_path / "a.smi", "\n# head\nCCO\tethanol extra\n  C  \n\nN n1\n")
    got = [(r.item, r.name, r.line_no) for r in library.read_library(spark, p).orderBy("line_no").collect()]
    assert got == [("CCO", "ethanol", 3), ("C", "mol_4", 4), ("N", "n1", 6)]


def test_library_without_rows_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        library.read_library(spark, write(tmp_path / "a.smi", "# only\n\n"))


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 700)):
        write(tmp_path / f"{name}.txt", "".join(f"{i} x\n" for i in range(1, n + 1)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = lines.read_numbered(spark, str(tmp_path))
        assert got.count() == 3700
        assert got.filter(F.col("line_no") != F.split("value", " ")[0].cast("int")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_records(spark, tmp_path):
    text = (
        "one\n x\n> < 'minimizedAffinity' >\n-7.5 kcal\n\n$$$$\n"
        "\n y\n>  <MINIMIZEDAFFINITY>\n1e-1$$ rest\n$$$$\n"
        "three\n z\n> <other>\n5\n\n$$$$\n   \n$$$$\n"
    )
    found = records.read_records(spark, write(tmp_path / "a.sdf", text)).orderBy("ordinal").collect()
    assert [(r.name, r.score) for r in found] == [("one", -7.5), ("mol_2", 0.1), ("three", None)]
    assert lines.count_records(spark, str(tmp_path / "a.sdf")).first().n == 4


@pytest.mark.parametrize("higher, want", [(False, ["c", "a"]), (True, ["b", "a"])])
def test_reorder(spark, higher, want):
    df = spark.createDataFrame([("a", 2, -1.0), ("b", 1, -1.0), ("c", 3, -5.0), ("d", 4, None)], "name string, ordinal long, score double")
    got = [r.name for r in records.reorder_records(df, 2, higher).collect()]
    assert got == (["c", "b"] if not higher else want)


def test_parts_keep_one_header(spark, tmp_path):
    a = write(tmp_path / "a.csv", "h\n1\n2\n")
    b = write(tmp_path / "b.csv", "h\n3")
    c = write(tmp_path / "c.csv", "other\nh\n")
    got = [r.value for r in library.read_parts(spark, [a, b, c, str(tmp_path / "no.csv")]).orderBy("part", "line_no").collect()]
    assert got == ["h", "1", "2", "3", "other", "h"]
    with pytest.raises(ValueError):
        library.read_parts(spark, [str(tmp_path / "no.csv")])


def test_a_header_of_later_parts_stays_once(spark, tmp_path):
    a, b, c = (write(tmp_path / f"{n}.csv", t) for n, t in (("a", "own\n1\n"), ("b", "h\n2\n"), ("c", "h\n3\n")))
    got = [r.value for r in library.read_parts(spark, [a, b, c]).orderBy("part", "line_no").collect()]
    assert got == ["own", "1", "h", "2", "3"]


def test_a_thousand_parts_are_one_scan(spark, tmp_path):
    paths = [write(tmp_path / f"part {i}+.csv", f"h\n{i}\n") for i in range(1000)]
    df = library.read_parts(spark, paths)
    assert str(df._jdf.queryExecution().optimizedPlan()).count("Union") == 0
    assert len(str(df._jdf.queryExecution().optimizedPlan()).splitlines()) < 100
    got = df.orderBy("part", "line_no").collect()
    assert [r.value for r in got] == ["h", *map(str, range(1000))] and got[-1].part == 999


def test_an_unreadable_part_is_an_error(spark, tmp_path):
    good = write(tmp_path / "good.csv", "h\n1\n")
    with pytest.raises(Exception) as error:
        library.read_parts(spark, [good, "nosuchstore://host/part.csv"]).collect()
    assert "PATH_NOT_FOUND" not in str(error.value) and not isinstance(error.value, AssertionError)


def test_weights(spark, tmp_path):
    assert library.weights_dict(spark, write(tmp_path / "w.txt", "a: 0.7\nb: 0.3\n\n")) == {"a": 0.7, "b": 0.3}
    with pytest.raises(Exception):
        library.weights_dict(spark, write(tmp_path / "bad.txt", "a: x\n"))


def test_triples(spark, tmp_path):
    p = write(tmp_path / "t.txt", "r.pdbqt; l.PDBQT ;f.pdbqt\nr.pdbqt;l.pdbqt\nnone\n")
    assert [tuple(r) for r in library.read_triples(spark, p).collect()] == [("r.pdbqt", "l.PDBQT", "f.pdbqt")]
    assert [r.ligand for r in library.read_triples(spark, p, files=2).collect()] == ["l.pdbqt"]


def atom(x, y, z, kind, head="ATOM  "):
    return f"{head}{1:5d}  C   LIG A   1    {x:8.3f}{y:8.3f}{z:8.3f}  0.00  0.00     0.000 {kind}\n"


def test_atoms_stop_and_types(spark, tmp_path):
    text = "REMARK\n" + atom(1, -2, 3.5, "OA") + atom(0, 0, 0, "Zn", "HETATM") + "TORSDOF 2\n" + atom(9, 9, 9, "C")
    p = write(tmp_path / "l.pdbqt", text)
    assert [(r.x, r.y, r.z, r.type) for r in structures.read_atoms(spark, p, "TORSDO").orderBy("line_no").collect()] == [
        (1.0, -2.0, 3.5, 2), (0.0, 0.0, 0.0, 1000),
    ]
    assert structures.read_atoms(spark, p).count() == 3


def test_terms_take_the_second_mark(spark, tmp_path):
    p = write(tmp_path / "o.txt", "x\n## a b\n## n 1 2.5 -3 4 5 6\n## z\n")
    r = structures.read_terms(spark, p).first()
    assert (r.term1, r.term2, r.term3, r.term4, r.term5) == (1.0, 2.5, -3.0, 4.0, 5.0)


def test_site_report(spark, tmp_path):
    p = write(
        tmp_path / "i.txt",
        "Volume : 1\nPocket 1 :\n\tVolume : \t 120.5\n\tTOTAL SASA : 9\n\tvolume : 7\nPocket 12 :\n\tDruggability Score : 0.2\n",
    )
    got = {r.section: (r.volume, r.total_sasa, r.druggability_score) for r in structures.read_site_report(spark, p).collect()}
    assert got == {"1": (120.5, 9.0, None), "12": (None, None, 0.2)}


def test_residues_and_centres(spark, tmp_path):
    row = "ATOM      1  CA  ALA B  12    "
    p = write(tmp_path / "p.pdb", row + "\n" + row + "\n" + row[:21] + " " + row[22:] + "\n" + row[:22] + "  xx    \nATOM short\n")
    got = [(r.chain, r.resnum, r.resname, r.first_line) for r in structures.read_residues(spark, p).orderBy("first_line").collect()]
    assert got == [("B", 12, "ALA", 1), ("A", 12, "ALA", 3)]
    c = write(tmp_path / "v.pqr", atom(1, 2, 3, "C") + "ATOM 1 O STP 1 4.5 5 6 0\nATOM no numbers\nTER\n")
    assert [(r.x, r.y, r.z) for r in structures.read_centres(spark, c).orderBy("line_no").collect()] == [(1.0, 2.0, 3.0), (4.5, 5.0, 6.0)]


def test_point_serials_wrap(spark):
    df = spark.createDataFrame([(99999, "KAA", 1.0, 2.0, 3.0), (100000, "KAA", 1.0, 2.0, 3.0)], "n long, group_id string, x double, y double, z double")
    got = [r.value[6:11] for r in sinks.point_lines(df).orderBy("n").collect()]
    assert got == ["99999", "    1"]
