"""Normalization: vectors of markers, tiers, model output and editions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from escriba.functions import editions, text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("t")).first().t


@pytest.mark.parametrize(
    ("value", "content", "lenient"),
    [
        ("[firma: Juan] fin", "Juan fin", "fin"),
        ("a [margen: nota] b", "a b", "a b"),
        ("a [interlineado: x] b", "a x b", "a x b"),
        ("a[blanco]b", "a b", "ab"),
        ("a [rúbrica]", "a", "a"),
        ("a [RÚBRICA]", "a", "a"),
        ("[e]llo", "ello", "ello"),
        ("[firma: Juan\nPérez] x", "Juan\nPérez x", "x"),
        ("", "", ""),
    ],
)
def test_markers(spark, value, content, lenient):
    assert one(spark, value, lambda c: text.strip_markers(c, "strict")) == value
    assert one(spark, value, lambda c: text.strip_markers(c, "content")) == content
    assert one(spark, value, lambda c: text.strip_markers(c, "lenient")) == lenient


@pytest.mark.parametrize(
    ("value", "tiers"),
    [
        ("hello\t world", ("hello world", "helloworld", "helloworld", "helloworld")),
        ("Hello, World! 123", ("Hello, World! 123", "Hello,World!123", "hello,world!123", "helloworld123")),
        ("bro­ken", ("broken",) * 4),
        ("Straße", ("Straße", "Straße", "strasse", "strasse")),
        ("café", ("café",) * 4),
        ("hello world​foo", ("hello world​foo", "helloworld​foo", "helloworld​foo", "helloworldfoo")),
        ("   ", ("",) * 4),
    ],
)
def test_tiers(spark, value, tiers):
    assert tuple(one(spark, value, fn) for fn in text.TIERS.values()) == tiers


def test_model_output(spark):
    raw = "Here is the transcription:\n## Page\n**Sepan** quantos “esta” – carta\n\n\n\n[Rubrica] [illegible] [...]\nNote: unsure"
    assert one(spark, raw, text.normalize_model_output) == 'Sepan quantos "esta" - carta\n\n[rúbrica] [ilegible] [ilegible]'
    churro = "Spanish\nltr\npaper\npage\nLatin\nSepan quantos"
    df = spark.createDataFrame([(churro, "baseline/churro_3b"), (churro, "other")], "t string, m string")
    assert [r.t for r in df.select(text.normalize_model_output(F.col("t"), F.col("m")).alias("t")).collect()] == ["Sepan quantos", churro]
    assert one(spark, None, text.normalize_model_output) is None


def test_forms_and_categories(spark):
    forms = {"Ami=go": "amigo", "dos palabras": None, "12": None, "...": None, "x": None, "y": "y", "de": "de", "zz": None, "AÑO": "año", '"a': None}
    df = spark.createDataFrame([(k,) for k in forms], "w string").select("w", text.clean_form(F.col("w")).alias("f"))
    assert {r.w: r.f for r in df.collect()} == forms
    letras = {"Procesal": "procesal", "procesal/cortesana": "procesal", "letra cortesana": "cortesana/procesal", "tipo procesal encadenada": "procesal encadenada", "humanística redonda": "humanística/procesal", "Grifa ": "grifa"}
    df = spark.createDataFrame([(k,) for k in letras], "w string").select("w", text.normalize_letra(F.col("w")).alias("f"))
    assert {r.w: r.f for r in df.collect()} == letras
    siglos = {"XV": "XV", "1499": "XV", "1530-01-01": "XVI", "1601": "XVII", "s. XVI": "unknown", "": "unknown"}
    df = spark.createDataFrame([(k,) for k in siglos], "w string").select("w", text.normalize_siglo(F.col("w")).alias("f"))
    assert {r.w: r.f for r in df.collect()} == siglos


def test_edition(spark):
    raw = "{h. 1r}\n1\nSep\na\nn quantos |esta\n2\n[mano 2: carta]\n*** fin\n3\n\n4\n[rubrica] /"
    assert one(spark, raw, editions.parse_edition) == "Sepan quantos esta\ncarta][ilegible] fin\n[rúbrica]"


def test_folio_pages(spark):
    md = "---\nslug: x\n---\n\ntítulo\n[Fol. 1 vuelto]\nuno\n[Fol. 2 recto]\ndos"
    df = spark.createDataFrame([("d", md), ("e", None)], "doc_id string, md string")
    rows = {r.page_no: r.page_text.strip() for r in editions.folio_pages(df).collect()}
    assert rows == {1: "título", 2: "uno", 3: "dos"}


def test_page_of_a_transcription(spark):
    md = "---\nslug: x\n---\n\n( _Cruz_ ) Sepan quan- /tos esta <carta> 1 vieren / [ _Al margen_ ] nota / al margen\nque / yo [ e ]llo / [ tachado: no / si ] fin\n\n[Fol. 1 vuelto]\notra / página"
    df = spark.createDataFrame([(md,)], "t string")
    first, second = (df.select(editions.parse_transcription(F.col("t"), F.lit(n)).alias("t")).first().t for n in (1, 2))
    assert first.split("\n") == ["[cruz] Sepan quan", "tos esta [interlineado: carta] vieren", "[margen: nota al margen] que", "yo [e]llo", "[tachado: no si] fin"]
    assert second == "otra\npágina"


def test_every_page_of_a_transcription(spark, tmp_path):
    from escriba.plans.core_queries import n17_transcriptions

    folios = [f"[Fol. {n // 2 + 1} {'vuelto' if n % 2 else 'recto'}]\npágina / {n + 1}" for n in range(7)]
    covered = "Portada de la escritura " * 6 + "\n" + "\n".join(folios)
    rows = [("plain", "\n".join(["página / 1", *folios[1:5]])), ("covered", covered), ("none", "sin / folios"), ("null", None)]
    spark.createDataFrame(rows, "doc_id string, md string").write.parquet(str(tmp_path / "transcripcion.parquet"))
    found = {(r.doc_id, r.page): r.text for r in n17_transcriptions(spark, str(tmp_path)).collect()}
    assert {p: found["plain", p] for d, p in found if d == "plain"} == {p: f"página\n{p}" for p in range(1, 6)}
    assert {p for d, p in found if d == "covered"} == set(range(1, 9)) and found["covered", 8] == "página\n7" and found["covered", 1] == ""
    assert found["none", 1] == "sin\nfolios" and {p for d, p in found if d == "none"} == {1}


def test_footnotes():
    body = "texto / 3 sigue\n[Fol. 1 vuelto]\n3 En el original se lee otra cosa distinta\nque sigue aquí.\nfin"
    notes, rest = editions.Notes.take(body)
    assert notes[0][:2] == (3, "En el original se lee otra cosa distinta que sigue aquí.") and rest.endswith("fin")
    assert editions.Notes.pages(body, notes) == [1]
