"""Season files at size."""

import os

from pooltide.catalog import ingest as I


def test_written_parts_have_no_checksum_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"L{k}_9899.csv", f"Date\nline {k}") for k in range(3)], "file string, content string")
    I._write_parts(rows, "file", 2, str(tmp_path / "parts"))
    found = {os.path.join(os.path.basename(at), f) for at, _, files in os.walk(tmp_path / "parts") for f in files}
    assert len([f for f in found if "/part-" in f]) == 3 and not [f for f in found if f.endswith(".crc")]
    assert sorted(r.content for r in I.CSV.read_season_files(spark, str(tmp_path / "parts")).collect()) == [f"Date\nline {k}\n" for k in range(3)]


def test_report_stores_what_it_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "A_9899.csv").write_text("Date,HomeTeam,AwayTeam,FTR,B365H\n01/08/1998,x,y,H,1.5\n01/08/1998,x,y,H,1.5\n,x,z,A,2\n")
    kept, stage = [], I.staged
    monkeypatch.setattr(I, "landed_season_files", lambda s, d: str(tmp_path))
    monkeypatch.setattr(I, "staged", lambda df, name: kept.append(df.columns) or stage(df, name))
    assert [tuple(r) for r in I.season_file_report(spark, "").collect()] == [("A_9899.csv", 1, 1, 1)]
    assert kept == [["file", "row_no", "valid", "date", "home", "away"]]
