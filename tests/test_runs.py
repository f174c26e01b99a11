import json
import zipfile

import pytest
from pyspark.sql import functions as F

from maskloom.plans.runs import anonymise_folder, ignore_values, restore_folder
from maskloom.sinks.files import mapping_json, read_index, recovered, write_files, write_mapping
from maskloom.sources.files import read_blocks, read_mapping, scan
from maskloom.streaming.incremental import anonymise_stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path):
    body = f"""<w:document xmlns:w="{W}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>
<w:p><w:r><w:t>Пишите </w:t></w:r><w:ins><w:r><w:t>anna@mail.example</w:t></w:r></w:ins><w:del><w:r><w:delText>нет</w:delText></w:r></w:del></w:p>
<w:p><w:r><a:blip r:embed="rId1"/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Поле</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>ИНН 7712345678</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="media/image1.png" Type="t"/></Relationships>')
        z.writestr("word/media/image1.png", b"\x89PNG")


def xlsx(path):
    rows = [["Название поля", "Тип поля", "Обязательность", "Значение по умолчанию"], ["Блок"], ["Почта a@b.ru", "Строка", "Обязательное", "RUB"], ["Число", 3, "Нет", None]]
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{"ABCD"[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{"ABCD"[c]}{r}"><v>{v}</v></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Форма" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="t"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("xl/media/pic.PNG", b"img")


@pytest.mark.parametrize("name", ["map.json", "map"])
def test_mapping_outlives_runs(spark, tmp_path, name):
    """Two runs with one mapping number on from each other, and it restores both; as a file of JSON and as a folder."""
    mapping = str(tmp_path / name)
    for i, text in enumerate(["пишите anna@mail.example", "и boris@mail.example, anna@mail.example"]):
        (tmp_path / f"in{i}").mkdir()
        (tmp_path / f"in{i}" / "a.txt").write_text(text, encoding="utf-8")
        anonymise_folder(spark, str(tmp_path / f"in{i}"), str(tmp_path / f"out{i}" / "anonimized"), mapping)
    assert "и EMAIL_0002, EMAIL_0001" in (tmp_path / "out1" / "anonimized" / "a_anon.md").read_text(encoding="utf-8")
    if name.endswith(".json"):
        told = (tmp_path / name).read_text(encoding="utf-8")
        wanted = {"EMAIL": {"anna@mail.example": "EMAIL_0001", "boris@mail.example": "EMAIL_0002"}}
        assert told.rstrip("\n") == json.dumps(wanted, ensure_ascii=False, indent=2, sort_keys=True)
    restore_folder(spark, str(tmp_path / "out1"), mapping)
    assert "и boris@mail.example, anna@mail.example" in (tmp_path / "out1" / "deanonimized" / "a_deanon.md").read_text(encoding="utf-8")


def test_json_mapping_equals_the_library(spark, tmp_path):
    rows = [("PERSON", 'q"u\\o\nte', "PERSON_0001"), ("PERSON", "Яна", "PERSON_0002"), ("BANK", "é😀", "BANK_0001"), ("BANK", "/", "BANK_0002"), ("PERSON", "a", "PERSON_10000")]
    m = spark.createDataFrame(rows, "type string, original string, pseudonym string")
    path = str(tmp_path / "map.json")
    write_mapping(m, path)
    write_mapping(m, path)
    buckets = {}
    for t, a, b in rows:
        buckets.setdefault(t, {})[a] = b
    assert (tmp_path / "map.json").read_text(encoding="utf-8").rstrip("\n") == json.dumps(buckets, ensure_ascii=False, indent=2, sort_keys=True)
    assert sorted(tuple(r) for r in read_mapping(spark, path).collect()) == sorted(rows)
    write_mapping(m.limit(0), path)
    assert read_mapping(spark, path).count() == 0 and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["map.json"]


def test_a_broken_write_leaves_the_old_mapping(spark, tmp_path):
    m = spark.createDataFrame([("EMAIL", "a@b.c", "EMAIL_0001")], "type string, original string, pseudonym string")
    path = tmp_path / "map"
    write_mapping(m, str(path))
    path.rename(tmp_path / "map.old")  # as if a run had ended between the two moves
    assert recovered(spark, str(path)) and read_mapping(spark, str(path)).count() == 1
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "part-0.parquet").write_bytes(b"no parquet")
    assert read_index(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception):
        read_index(spark, str(tmp_path / "index")).count()


def test_ignored_values_stay_out_of_reviews(spark, tmp_path):
    src, own = tmp_path / "in", tmp_path / "dict"
    src.mkdir(), own.mkdir()
    (src / "a.txt").write_text("программы Луч Плюс: срок", encoding="utf-8")
    assert anonymise_folder(spark, str(src / "a.txt"), str(tmp_path / "out"), dictionaries=str(own))["review_candidates"] == 1
    assert (tmp_path / "out" / "a_anon.md").exists()
    ignore_values(spark, str(own), ["# eigen", "Луч Плюс"])
    ignore_values(spark, str(own), ["Юг"])
    assert (own / "ignore.txt").read_text(encoding="utf-8") == "# eigen\nЛуч Плюс\nЮг\n"
    assert anonymise_folder(spark, str(src / "a.txt"), str(tmp_path / "out"), dictionaries=str(own))["review_candidates"] == 0


def test_files_that_need_other_programs_are_error_rows(spark, tmp_path):
    for name in ("a.pdf", "b.doc"):
        (tmp_path / name).write_bytes(b"%PDF-1.4")
    rows = {r.source_format: r.error for r in read_blocks(scan(spark, str(tmp_path))).collect()}
    assert set(rows) == {"pdf", "doc"} and all(rows.values())


def test_paths_of_other_file_systems_are_refused(spark):
    with pytest.raises(Exception, match="mounted"):
        write_files(spark.createDataFrame([("hdfs://host/x", "t")], "path string, data string"))


def folder(tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("Клиент Сидоров Олег Львович\n\nanna@mail.example и программы Луч Плюс: срок\x0bвторая", encoding="utf-8")
    (src / "skip.png").write_bytes(b"x")
    docx(src / "a.docx")
    xlsx(src / "sub" / "form.xlsx")
    (src / "sub" / "bad.docx").write_bytes(b"no zip")
    return src


def test_folder_there_and_back(spark, tmp_path):
    src, out, mapping = folder(tmp_path), tmp_path / "anonimized", str(tmp_path / "mapping")
    report = anonymise_folder(spark, str(src), str(out), mapping)
    assert report["processed"] == 3 and report["error_count"] == 1 and report["review_candidates"] == 1
    text = (out / "a_txt_anon.md").read_text(encoding="utf-8").split("\n")
    assert text[0].startswith("<!-- DOC: source=a.txt | format=txt | entities: EMAIL=1, PERSON=1 | assets: 0")
    assert text[1] == "Клиент PERSON_0001" and text[2].startswith("EMAIL_0001 и") and text[3] == "вторая"
    word = (out / "a_anon.md").read_text(encoding="utf-8").split("\n")
    assert word[1] == "Пишите EMAIL_0001" and "anchor=para-1" in word[2] and word[4] == "| Поле | a\\|b |" and word[6] == "| ИНН INN_0001 |  |"
    assert (out / "a_anon_assets/assets/img-001.png").read_bytes() == b"\x89PNG"
    assert json.loads((out / "a_anon_assets/index.json").read_text())["assets"][0]["anchor"] == 1
    sheet = (out / "form_anon.md").read_text(encoding="utf-8")
    assert "assets: media=1" in sheet and "| Почта EMAIL_0002 | Строка |" in sheet and "| Число | 3 |" in sheet
    data = json.loads((out / "form_anon.json").read_text(encoding="utf-8"))
    form = data["sheets"][0]
    assert list(data) == ["schema_version", "source", "agent", "sheets", "summary"] and data["source"] == {"file_name_anon": "form.xlsx"}
    assert form["sheet_name_anon"] == "Форма" and form["header_row"] == 1 and form["blocks"] == [{"name_anon": "Блок", "row": 2}] and form["ambiguous_cases"] == form["notes"] == []
    assert form["headers"]["required"] == "Обязательность" and len(form["parameters"]) == 2
    p = form["parameters"][0]
    assert p["source"] == {"sheet": "Форма", "row": 3, "cell_range": "A3:D3"} and p["name_anon"] == "Почта EMAIL_0002" and p["block"] == "Блок" and p["required"]["status"] == "required" and p["availability"] is None
    assert data["summary"]["total_parameters"] == 2 and data["summary"]["with_default"] == 1
    assert json.loads((out / "a_txt_anon_review.json").read_text(encoding="utf-8"))["candidates"][0]["value"] == "Луч Плюс"
    assert {r.output.rsplit("/", 1)[1] for r in spark.read.parquet(str(out / "index")).collect()} == {"a_anon.md", "a_txt_anon.md", "form_anon.md"}

    again = anonymise_folder(spark, str(src), str(out), mapping)
    assert again["entities"] == report["entities"] and read_mapping(spark, mapping).count() == 4

    done = restore_folder(spark, str(out), mapping)
    back = (tmp_path / "deanonimized" / "a_txt_deanon.md").read_text(encoding="utf-8")
    assert "Клиент Сидоров Олег Львович" in back and "anna@mail.example" in back and done["unresolved"] == 0
    assert json.loads((tmp_path / "deanonimized" / "form_deanon.json").read_text(encoding="utf-8"))["sheets"][0]["parameters"][0]["name_anon"] == "Почта a@b.ru"


def test_scan_skips_outputs(spark, tmp_path):
    src = folder(tmp_path)
    (src / "anonimized").mkdir()
    (src / "anonimized" / "x.txt").write_text("x")
    found = sorted((r.doc_id, r.path.rsplit("/", 1)[1]) for r in scan(spark, str(src)).select("doc_id", "path").collect())
    assert found == [(0, "a.docx"), (1, "a.txt"), (2, "bad.docx"), (3, "form.xlsx")]


def test_mapping_json(spark, tmp_path):
    m = spark.createDataFrame([("PERSON", "б", "PERSON_0002"), ("PERSON", "а", "PERSON_0001"), ("OWN", "x", "OWN_1")], "type string, original string, pseudonym string")
    assert [tuple(r) for r in mapping_json(m).collect()] == [("PERSON", '{"а":"PERSON_0001","б":"PERSON_0002"}')]
    path = tmp_path / "mapping.json"
    path.write_text('{"PERSON": {"а": "PERSON_0001"}, "odd": 3}', encoding="utf-8")
    assert [tuple(r) for r in read_mapping(spark, str(path)).collect()] == [("PERSON", "а", "PERSON_0001")]


def test_stream_numbers_across_batches(spark, tmp_path):
    src = tmp_path / "texts"
    for i, t in enumerate(["a@b.ru", "c@d.ru и a@b.ru"]):
        spark.createDataFrame([(i, t)], "i long, text string").coalesce(1).write.mode("append").parquet(str(src))
        q = anonymise_stream(spark.readStream.schema("i long, text string").parquet(str(src)), ["i"], str(tmp_path / "out"), str(tmp_path / "map"), str(tmp_path / "check"), available_now=True)
        assert q.awaitTermination(120)
    got = [r.text for r in spark.read.parquet(str(tmp_path / "out")).orderBy("i").select(F.col("text")).collect()]
    assert got == ["EMAIL_0001", "EMAIL_0002 и EMAIL_0001"]
    assert {r.original: r.pseudonym for r in read_mapping(spark, str(tmp_path / "map")).collect()} == {"a@b.ru": "EMAIL_0001", "c@d.ru": "EMAIL_0002"}
    spark.createDataFrame([("EMAIL", "z@z.zz", "EMAIL_0009")], "type string, original string, pseudonym string").write.parquet(str(tmp_path / "known"))
    q = anonymise_stream(spark.readStream.schema("i long, text string").parquet(str(src)), ["i"], str(tmp_path / "out2"), str(tmp_path / "known"), str(tmp_path / "check2"), available_now=True)
    assert q.awaitTermination(120)
    assert {r.pseudonym for r in read_mapping(spark, str(tmp_path / "known")).collect()} == {"EMAIL_0009", "EMAIL_0010", "EMAIL_0011"}
