import json
import os
import zipfile

import pytest

from sieveline.sources import xlsx
from sieveline.sources.load import LoadError, load_records
from sieveline.sources.sinks import write_results
from sieveline.sources.tagged import PUBMED, RIS, WOS, parse_tagged, read_pieces, sniff
from sieveline.sources.xlsx import read_xlsx, write_xlsx


def parse(spark, grammar, text):
    return [r.asDict() for r in parse_tagged(spark.createDataFrame([("f", text)], "path string, value string"), grammar).orderBy("rec").collect()]


def test_ris(spark):
    got = parse(spark, RIS, "TY  - JOUR\nTI  - A\nT1  - B\nAU  - \nAU  - Doe, A\nA2  - Roe\nAU  - \nKW  - x\n continued line\nDO  - 10.1/a\nDO  - 10.1/b\n"
                            "PY  - 2021/03\nER  - \nZZ  - only unknown\nER  - \nTI  - open end\nAB  - kept\n")
    assert len(got) == 2
    assert (got[0]["title"], got[0]["author"], got[0]["doi"], got[0]["publication_year"], got[0]["keywords"]) == ("A B", "Doe, A; Roe; ", "10.1/b", "2021", "x")
    assert got[1]["title"] == "open end" and got[1]["author"] is None


def test_pubmed(spark):
    got = parse(spark, PUBMED, "PMID- 1\r\nTI  - A\r\n      b\r\nFAU - Doe, Ann\r\n      ignored\r\nAU  - Doe A\r\nLID - S1 [pii]\r\nAID - 10.1/z [doi]\r\nLID - 10.2/y [doi]\r\n"
                               "OT  - k\r\n      more\r\nJT  - Long\r\nTA  - L\r\n\r\nPMID- 2\r\n      lost\r\nTI  - C\r\n")
    assert (got[0]["title"], got[0]["author"], got[0]["doi"], got[0]["keywords"], got[0]["journal"], got[0]["pmid"]) == (
        "A b", "Doe, Ann; Doe A", "10.1/z", "k; more", "Long L", "1")
    assert got[1]["title"] == "C" and got[1]["pmid"] == "2"


def test_wos(spark):
    got = parse(spark, WOS, "FN x\nVR 1.0\nPT J\nAU Doe, A\n   Roe, B\nAF Doe, Ann\nTI One\n   two\nDE a\nID b\nDI 10.1/q\nPY 1999\nER\n\nPT J\nTI open\n")
    assert (got[0]["author"], got[0]["title"], got[0]["keywords"], got[0]["doi"], got[0]["publication_year"]) == (
        "Doe, A; Roe, B; Doe, Ann", "One two", "a; b", "10.1/q", "1999")
    assert got[1]["title"] == "open"


def test_sniffing(spark):
    late = "TY  - J\nTI  - t\nAU  - a\nAB  - b\n" + "KW  - k\n" * 200 + "ER  - \n"
    texts = ["TY  - J\nER  - \n", "PMID- 1\nTI  - x\n", "PT J\nAU A\nER\n", "hello", "", late]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", sniff(df.t)).orderBy("i").collect()]
    assert got == ["ris", "pubmed_tagged_txt", "wos_tagged_txt", "unknown_txt", "unknown_txt", "wos_tagged_txt"]


def test_folder(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.csv").write_text('﻿Article  TITLE,Authors,Keywords Plus,Author Keywords,Extra\n"Two\nlines",A,,kw,e\nNA,B,plus,kw,\n', encoding="utf-8")
    (d / "b.tsv").write_text("TI\tDI\nT2\tdoi:10.1/X\n")
    (d / "c.json").write_text(json.dumps([{"title": "J", "year": 2021, "n": None}, {"title": "K", "year": "007"}]))
    (d / "sub" / "d.jsonl").write_text('{"title": "L"}\n\n{"title": "M"}\n')
    (d / "bad.json").write_text('{"title": ')
    (d / "u.txt").write_text("nothing known\n")
    (d / "old.xls").write_bytes(b"\xd0\xcf")
    (d / "e.ris").write_bytes(b"TY  - J\nTI  - bad \xff byte\nER  - \n")
    (d / "skip.pdf").write_text("x")
    write_xlsx(str(d / "f.xlsx"), ["Title", "AU"], [("X", "n"), ("Y", None)])
    records, log = load_records(spark, str(d), {"n": "journal"})
    rows = {r.title: r for r in records.collect()}
    assert set(rows) == {"Two lines", "", "T2", "J", "K", "L", "M", "X", "Y", "bad byte"}
    assert rows["Two lines"].keywords == "kw" and rows[""].keywords == "plus" and rows["Two lines"].Extra == "e"
    assert rows["T2"].doi == "10.1/x" and rows["K"].publication_year == "007" and rows["X"].source_format == "table_like_xlsx"
    status = {r.source_file: (r.status, r.record_count) for r in log.collect()}
    assert [status[f][0] for f in ("bad.json", "u.txt", "old.xls")] == ["failed"] * 3
    assert status["a.csv"] == ("success", 2) and "skip.pdf" not in status
    assert [r.full_path for r in log.collect()] == sorted(r.full_path for r in log.collect())


def test_paths_are_uris_with_any_characters(spark, tmp_path):
    d = tmp_path / "in put+ä%20"
    d.mkdir()
    (d / "a b.csv").write_text("title\nT1\n")
    (d / "c+%41.ris").write_text("TY  - J\nTI  - T2\nER  - \n")
    for path in (str(d), f"file://{d}", f"file:{d}/a b.csv"):
        records, log = load_records(spark, path)
        want = {"a b.csv": "T1"} if path.endswith("csv") else {"a b.csv": "T1", "c+%41.ris": "T2"}
        assert {r.source_file: r.title for r in records.collect()} == want
        assert [(r.source_file, r.record_count, r.full_path) for r in log.collect()] == [(f, 1, str(d / f)) for f in sorted(want)]


def test_one_large_tagged_file_is_many_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for name, form in (("r.ris", "TY  - J\nTI  - Title {i}\n  \nKW  - a\nDO  - 10.1/{i}\nER  - \n\n"), ("p.nbib", "\nPMID- {i}\nTI  - Title\n      {i}\nOT  - a\nAID - 10.1/{i} [doi]\n"),
                           ("w.txt", "PT J\nAU Doe, A\n   Roe, B\nTI Title\n   {i}\nDE a\nDI 10.1/{i}\nER\n\n")):
            (tmp_path / name).write_text("".join(form.replace("{i}", str(i)) for i in range(3000)))
            grammar = {"r.ris": RIS, "p.nbib": PUBMED, "w.txt": WOS}[name]
            assert read_pieces(spark, [str(tmp_path / name)], grammar).rdd.getNumPartitions() > 4
            records, log = load_records(spark, str(tmp_path / name))
            assert sorted((r.title, r.keywords, r.doi) for r in records.collect()) == sorted((f"Title {i}", "a", f"10.1/{i}") for i in range(3000))
            assert log.first().record_count == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_broken_sheet_fails_alone(spark, tmp_path):
    write_xlsx(str(tmp_path / "a.xlsx"), ["Title"], [("X",)])
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    (tmp_path / "c.json").write_text('[{"title": "J", "Title": "K"}]')
    (tmp_path / "d.json").write_text('[{"title": "L"}]')
    records, log = load_records(spark, str(tmp_path))
    assert {r.title for r in records.collect()} == {"X", "L"}
    assert {r.source_file: r.status for r in log.collect()} == {"a.xlsx": "success", "b.xlsx": "failed", "c.json": "failed", "d.json": "success"}


def test_errors(spark, tmp_path):
    with pytest.raises(LoadError):
        load_records(spark, str(tmp_path))
    with pytest.raises(LoadError):
        load_records(spark, str(tmp_path / "none.csv"))
    (tmp_path / "u.txt").write_text("x")
    with pytest.raises(LoadError):
        load_records(spark, str(tmp_path))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "ä,\"x", 0.5)], "record_id long, t string, v double")
    path = write_results(df, str(tmp_path / "o.csv"))
    assert open(path, "rb").read().startswith(b"\xef\xbb\xbf") and open(path, encoding="utf-8-sig").read().splitlines()[1] == '1,"ä,""x",0.5'
    assert json.load(open(write_results(df, str(tmp_path / "o.json")), encoding="utf-8"))[1] == {"record_id": 2, "t": "b", "v": None}
    assert write_results(df, str(tmp_path / "o.dat")).endswith("o.dat.csv")
    rows = read_xlsx(open(write_results(df, str(tmp_path / "o.xlsx")), "rb").read())
    assert rows[0]["t"] == 'ä,"x' and len(rows) == 2
    assert os.path.isdir(write_results(df, str(tmp_path / "o.parquet")))


def test_a_sheet_goes_on_in_the_next(spark, tmp_path, monkeypatch):
    for name, value in (("SHEET_ROWS", 150), ("SHEET_BYTES", 20_000), ("PIECE_BYTES", 500)):
        monkeypatch.setattr(xlsx, name, value, raising=False)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20_000)  # as 2 GB of XML
    rows = [(i, f"<T> & {i}", None if i % 3 else "x" * (i % 70)) for i in range(1000)]
    want = [{"Nr": str(i), "Title": t, "AU": v} for i, t, v in rows]
    write_xlsx(str(tmp_path / "a.xlsx"), ["Nr", "Title", "AU"], rows)
    df = spark.createDataFrame(rows, "Nr long, Title string, AU string")
    for path in (str(tmp_path / "a.xlsx"), write_results(df, str(tmp_path / "b.xlsx"), "Nr"), write_results(df.repartition(9), str(tmp_path / "c.xlsx"), None)):
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None
            sheets = [i for i in z.infolist() if i.filename.startswith("xl/worksheets/")]
            assert len(sheets) > 5 or not path.endswith("a.xlsx")
            assert all(z.read(i).count(b"<row>") <= 150 and i.file_size <= 20_000 for i in sheets if path.endswith("a.xlsx"))
        got = read_xlsx(open(path, "rb").read())
        assert (sorted(got, key=lambda r: int(r["Nr"])) if path.endswith("c.xlsx") else got) == want
        records, log = load_records(spark, path)
        assert sorted((int(r.Nr), r.title, r.author) for r in records.collect()) == [(i, t, v or "") for i, t, v in rows]
        assert log.first().record_count == 1000


def test_a_sheet_that_breaks_off_fails_alone(spark, tmp_path):
    write_xlsx(str(tmp_path / "a.xlsx"), ["Title", "Nr"], [("X", 1)])
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{xlsx._NS["m"]}"><sheetData>' + "".join(  # noqa: SLF001
            f'<row r="{k}"><c r="B{k}"><v>{k}</v></c></row>' for k in range(1, 3000)) + "<row>")
    records, log = load_records(spark, str(tmp_path))
    assert [(r.title, r.Nr) for r in records.collect()] == [("X", "1")] and "1" not in records.columns
    assert [(r.source_file, r.status, r.record_count) for r in log.collect()] == [("a.xlsx", "success", 1), ("b.xlsx", "failed", 0)]
