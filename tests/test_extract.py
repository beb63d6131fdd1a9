from pyspark.sql import functions as F

from doclake.operators import extract
from doclake.sources import results


def _doc(spark, *lines):
    return spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")


TABLES = ["글", "| 이름 | b |", "|---|:-:|", "| 가, 나 | \"3\" |", "| c \\| d |  |", "", "|x| is no table", "| nor this |", "",
          "  | 한 칸 |", "| - |", "| - | x |", "|---|", "끝"]


def test_cells(spark):
    got = [tuple(r)[1:] for r in extract.extract_tables(_doc(spark, *TABLES)).orderBy("table_no", "row_no", "col_no").collect()]
    assert got == [(1, 0, 0, "이름"), (1, 0, 1, "b"), (1, 1, 0, "가, 나"), (1, 1, 1, '"3"'), (1, 2, 0, "c | d"), (1, 2, 1, ""),
                   (2, 0, 0, "한 칸"), (2, 1, 0, "-"), (2, 1, 1, "x"), (2, 2, 0, "---")]


def test_csv_matches_pandas(spark):
    import io
    import pandas as pd
    got = {r.table_no: r.csv for r in extract.csv_tables(_doc(spark, *TABLES)).collect()}
    assert got[1] == '이름,b\n"가, 나","""3"""\nc | d,'
    frame = pd.read_csv(io.StringIO(got[1]), keep_default_na=False, dtype=str)
    assert frame.to_csv(index=False).rstrip("\n") == got[1]
    assert extract.csv_tables(_doc(spark, "| a |", "|:--|", "|  |")).first().csv == 'a\n""'


def test_a_line_above_the_header_and_dashes_in_the_first_line(spark):
    rows = ["| above |", "|---|---|", "|---|---|", "| 1 | 2 |", "| - | - |", "| 3 | 4 |"]
    got = [(r.row_no, r.col_no, r.value) for r in extract.extract_tables(_doc(spark, *rows)).orderBy("row_no", "col_no").collect()]
    assert got == [(0, 0, "above"), (1, 0, "---"), (1, 1, "---"), (2, 0, "1"), (2, 1, "2"), (3, 0, "-"), (3, 1, "-"), (4, 0, "3"), (4, 1, "4")]


def test_counts_and_image_modes(spark):
    doc = _doc(spark, "<!-- image -->", "![Image](/tmp/x/images/i1.png) ![b](images/i2.png)", *TABLES)
    assert tuple(extract.count_artifacts(doc).first()) == (1, 2, 3)
    other = _doc(spark, "![a](https://host/images/y.png) ![b](/abs/pic.png) ![c](data:image/png;base64,AA/B) ![d](up/../e.png)")
    assert extract.apply_image_mode(other, F.lit(True)).first().text == (
        "![a](https://host/images/y.png) ![b](images/pic.png) ![c](data:image/png;base64,AA/B) ![d](images/e.png)")
    on = extract.apply_image_mode(doc, F.lit(True)).first().text
    assert "![Image](images/i1.png) ![b](images/i2.png)" in on and "](/" not in on
    off = extract.apply_image_mode(doc, F.lit(False))
    assert off.first().text.count("<!-- image -->") == 3
    assert extract.count_artifacts(off).first().n_images == 3


def test_csv_files(spark, tmp_path):
    many = ["| t |", "|---|", ""] * 101
    results.write_table_csv(_doc(spark, *many), str(tmp_path / "out"))
    folders = sorted(p.name for p in (tmp_path / "out" / "doc_id=1").iterdir())
    assert folders[0] == "table=table-01" and "table=table-101" in folders and len(folders) == 101
    file = next((tmp_path / "out" / "doc_id=1" / "table=table-01").glob("*.txt"))
    assert file.read_bytes() == b"\xef\xbb\xbft\n"


def test_safe_names(spark):
    names = ["a/b/보고서.pdf", "보고서.pdf", "..", ".", "", "x:y?.pdf", ".bashrc", "a.b.pdf", "  sp  .pdf", "...", "dir/", "a."]
    df = spark.createDataFrame(list(enumerate(names)), "i int, filename string")
    got = {r.i: r.folder for r in results.safe_names(df, [F.col("i")]).collect()}
    assert [got[i] for i in range(len(names))] == ["보고서", "보고서-1", "file", "file-1", "file-2", "x_y_", ".bashrc", "a.b",
                                                   "sp", "file-3", "dir", "a."]


def test_bundle(spark, job_rows):
    df = job_rows(dict(id="a", status="done", filename="r.pdf", result_dir="r/1", created_at=1.0),
                  dict(id="b", status="done", filename="r.pdf", result_dir="r/gone", created_at=2.0),
                  dict(id="c", status="done", filename="r.pdf", result_dir="r/3", created_at=3.0),
                  dict(id="d", status="failed", filename="r.pdf", created_at=4.0),
                  dict(id="e", status="done", filename="r.pdf", result_dir="r/1", session_id="s2"))
    files = spark.createDataFrame([("r/1", "doc.md"), ("r/3", "doc.md"), ("r/3", "images/1.png"), ("r/9", "doc.md")],
                                  "result_dir string, rel_path string")
    assert sorted(r.entry for r in results.bundle_manifest(df, files, "s1").collect()) == [
        "r-1/doc.md", "r/doc.md", "r/images/1.png"]
    assert results.bundle_manifest(df, files, "nobody").count() == 0


def test_results_are_stored_once_per_key(spark, tmp_path):
    rows = [("s", "o", "text", 1, 2), ("s", "o", "text", 1, 2), ("s", "p", "text", 1, 2)]
    results.write_results(spark.createDataFrame(rows, "sha256 string, opts_hash string, text string, n_tables int, n_images int"),
                          str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
