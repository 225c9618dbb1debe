"""Readers, sinks, the stream, and the driver's contract."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from escriba.sources import readers, sinks
from escriba.streaming import metrics as stream


def test_files(spark, tmp_path):
    for path, body in {"models/baseline/x/normalized/p_1.txt": "uno\ndos", "models/solo/normalized/p_2.txt": "tres", "models/_skip/normalized/p_3.txt": "no", "gt/codea/ground_truth/critical/p_1.txt": "uno"}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body, encoding="utf-8")
    found = {(r.model, r.page_id): r.text for r in readers.model_texts(spark, str(tmp_path / "models")).collect()}
    assert found == {("baseline/x", "p_1"): "uno\ndos", ("solo", "p_2"): "tres"}
    assert [tuple(r) for r in readers.ground_truth_texts(spark, str(tmp_path / "gt")).collect()] == [("codea", "critical", "p_1", "uno")]


def test_manifests_and_reports(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"dataset": "codea", "doc_id": "d", "page_id": "p", "gt_paths": {"critical": "x"}}]), encoding="utf-8")
    rows = readers.manifests(spark, str(tmp_path / "m.json"), str(tmp_path / "missing.json"))
    assert [(r.page_id, r.gt_paths) for r in rows.collect()] == [("p", {"critical": "x"})]
    (tmp_path / "r_metrics.json").write_text(json.dumps({"results": [{"model": "m", "cer": 0.5}]}), encoding="utf-8")
    assert readers.reports(spark, str(tmp_path / "r_metrics.json")).first().cer == 0.5


def test_xml_and_html(spark):
    page = (
        '<PcGts xmlns="x"><Page><ReadingOrder><OrderedGroup><RegionRefIndexed index="1" regionRef="a"/><RegionRefIndexed index="0" regionRef="b"/></OrderedGroup></ReadingOrder>'
        '<TextRegion id="a"><TextLine><TextEquiv><Unicode>dos</Unicode></TextEquiv></TextLine></TextRegion>'
        '<TextRegion id="b"><TextLine><TextEquiv><Unicode>uno</Unicode></TextEquiv></TextLine></TextRegion>'
        '<TextRegion id="c"><TextLine><TextEquiv><Unicode>header</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>'
    )
    assert readers.page_xml_text(page) == "uno\ndos"
    assert readers.alto_xml_text('<alto><TextLine><String CONTENT="a"/><SP/><String CONTENT="b"/></TextLine><TextLine/></alto>') == "a b"
    tei = '<TEI><tok form="Aug" fform="Augustin" nform="Augustín">Aug<ex>ustin</ex></tok><tok form="--" nform=",">,</tok></TEI>'
    assert set(readers.tei_tokens(tei)) == {("paleographic", "Augustin"), ("paleographic", "Aug"), ("expanded", "Augustin"), ("normalized", "Augustín"), ("paleographic", ",")}
    html = '<table><tr class="tr-texto"><td class="textopaleo"><img src="/f/CODEA-0001_1r.jpg">Sepan<br>q</td><td class="textocritico">Sepan que</td></tr></table>'
    assert readers.transcription_table(html) == [("1r", "Sepan\nq", "Sepan que")]
    row = '<tr><td><a href="t.jpg"></a></td><td>T<div class="list-group"><a href="/x/1289-12-20_cd.pdf"></a><a href="/x/1289-12-20_d.pdf"></a><a href="/x/1289-12-20_t.pdf"></a></div></td></tr>'
    assert readers.document_links(f"<table>{row}<tr><td>none</td></tr></table>") == [(1, "1289-12-20", "/x/1289-12-20_cd.pdf", "/x/1289-12-20_d.pdf", "/x/1289-12-20_t.pdf")]
    df = spark.createDataFrame([(1, page), (2, "<broken"), (3, None)], "id int, xml string")
    assert [tuple(r) for r in readers.xml_texts(df, "id", "xml").collect()] == [(1, "uno\ndos")]


def test_description(spark):
    md = '---\nslug: "x"\narchive: \'A\'\n---\n**FONDO-COLECCIÓN=** uno\ndos **NIVEL DE DESCRIPCIÓN=** b **PRODUCTOR=** c'
    df = spark.createDataFrame([(md,)], "t string")
    assert df.select(readers.front_matter(F.col("t")).alias("m")).first().m == {"slug": "x", "archive": "A"}
    row = df.select(*[v.alias(k) for k, v in readers.description(F.col("t")).items()]).first()
    assert row.fondo == "uno dos" and row.nivel_descripcion == "b"


def test_probe(spark):
    rows = [("d", i, f"p{i}", i in (0, 1, 3, 8)) for i in range(10)]
    found = readers.facsimiles_found(spark.createDataFrame(rows, "doc_id string, place int, page string, found boolean"))
    assert [r.page for r in found.orderBy("place").collect()] == ["p0", "p1", "p3"]


def test_resume_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a_b", 0.12345), (2, "c", None)], "rank int, model string, cer double")
    out = str(tmp_path / "out")
    assert sinks.resume(df, out, ["rank"]) == 2 and sinks.resume(df, out, ["rank"]) == 0
    assert [r.text for r in sinks.markdown_rows(df, ["rank", "model", "cer"]).collect()][2:] == ["| 1 | a_b | 0.1235 |", "| 2 | c | - |"]
    assert sinks.latex_rows(df, ["model"]).first().text == r"a\_b \\"
    sinks.json_report(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    gt = spark.createDataFrame([("codea", "critical", "p", "hola mundo")], "subset string, edition string, page_id string, gt_text string")
    rows = spark.createDataFrame([("m", "p", "hola mvndo", "2024-01-01 00:00:00"), ("m", "p", "hola mvndo", "2024-01-01 01:00:00"), ("m", "q", "x", "2024-01-01 00:00:00"), ("m", "p", None, "2024-01-02 00:00:00")], "model string, page_id string, hyp_text string, run_at string")
    rows = rows.withColumn("run_at", F.to_timestamp("run_at"))
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    scored = stream.scored_stream(spark.readStream.schema(rows.schema).parquet(source), gt)
    for _ in range(2):  # the second call finds nothing new
        stream.run(scored, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.model, r.page_id, r.cer) for r in found] == [("m", "p", pytest.approx(0.1))]


def test_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert {"model", "cer_mean", "rank"} <= set(entry.entry(spark).columns)
