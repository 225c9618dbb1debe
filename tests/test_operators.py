"""Operators: statistics, errors, layout, sampling, vocabulary, joins, on small fixtures against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from escriba.operators import corpus, errors, evaluation, layout, matching, pairs, quality, sampling, stats, vocabulary


def test_by_page_splits_hot_keys(spark):
    left = spark.createDataFrame([(p, f"{p}{i}") for p in "abc" for i in range(2)], "page_id string, ref string")
    right = spark.createDataFrame([("a", i) for i in range(5000)] + [("b", 1), ("z", 2), (None, 3)], "page_id string, hyp int")
    found = pairs.by_page(left, right)
    assert found.count() == 2 * 5000 + 2 == found.distinct().count()


def test_ranking_ties_and_spread(spark):
    rows = spark.createDataFrame([("b", "1", 0.5), ("a", "1", 0.5), ("c", "1", 0.2), ("c", "2", 0.4)], "model string, page_id string, cer double")
    found = {r.model: (r["rank"], r.cer_stdev) for r in evaluation.ranking(evaluation.model_summary(rows)).collect()}
    assert found["c"][0] == 1 and found["a"] == (2, 0.0) and found["b"] == (3, 0.0)


def test_common_pages_and_pairs(spark):
    rows = spark.createDataFrame([("a", "1", 1.0), ("b", "1", 2.0), ("a", "2", 3.0), ("c", "1", 4.0)], "model string, page_id string, cer double")
    assert [r.page_id for r in evaluation.common_pages(rows).collect()] == ["1"]
    assert {(r.model_a, r.model_b, r.value_a, r.value_b) for r in evaluation.model_pairs(rows).collect()} == {("a", "b", 1, 2), ("a", "c", 1, 4), ("b", "c", 2, 4)}


def test_holm(spark):
    df = spark.createDataFrame([("m", str(i), p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "model_a string, model_b string, p_value double")
    rows = sorted(stats.holm(df).collect(), key=lambda r: r.model_b)
    assert [r.p_adjusted for r in rows] == pytest.approx([0.03, 0.06, 0.06, 0.02]) and [r.significant for r in rows] == [True, False, False, True]
    one = spark.createDataFrame([("m", "n", 0.05)], "model_a string, model_b string, p_value double")
    assert stats.holm(one).first().significant is False


def test_wilcoxon(spark):
    a = [106, 108, 114, 116, 123, 124, 128, 129, 141, 52, 149, 156, 160, 33, 175]
    df = spark.createDataFrame([("a", "b", str(i), float(x), 100.0) for i, x in enumerate(a)] + [("a", "c", "1", 1.0, 1.0), ("b", "c", "1", 1.0, 2.0)], "model_a string, model_b string, page_id string, value_a double, value_b double")
    found = {(r.model_a, r.model_b): (r.statistic, r.p_value) for r in stats.wilcoxon(df).collect()}
    assert found["a", "b"] == pytest.approx((24.0, 0.041259765625)) and found["a", "c"] == (0.0, 1.0) and found["b", "c"] == (0.0, 1.0)


def test_bootstrap(spark):
    point, low, high = stats.bootstrap(np.array([0.1, 0.2, 0.3, 0.4, 0.5]))
    assert (point, low, high) == pytest.approx((0.3, 0.18, 0.42))
    assert stats.bootstrap(np.full(5, 0.5))[1:] == (0.5, 0.5) and stats.bootstrap(np.array([])) == (0.0, 0.0, 0.0)
    rows = spark.createDataFrame([("m", str(i), v) for i, v in enumerate([0.1, 0.2, 0.3, 0.4, 0.5])], "model string, page_id string, cer double")
    assert stats.bootstrap_intervals(rows).first()[1:] == pytest.approx((5, 0.3, 0.18, 0.42))
    values = np.random.default_rng(1).random(600)
    many = spark.createDataFrame([("m", str(i), float(v)) for i, v in enumerate(values)], "model string, page_id string, cer double")
    whole, split = stats.bootstrap_intervals(many).first(), stats.bootstrap_intervals(many, slice_rows=100).first()
    assert whole[1:] == pytest.approx((600, *stats.bootstrap(values[np.argsort([str(i) for i in range(600)])])), abs=1e-9)
    assert split[1:] == pytest.approx(whole[1:], abs=0.003) and split == stats.bootstrap_intervals(many.repartition(5), slice_rows=100).first()


def test_errors(spark):
    df = spark.createDataFrame([("m", "p", "çenso uno dos", "censo vno"), ("m", "q", "abc", "abc"), ("m", "r", "", "x")], "model string, page_id string, ref string, hyp string")
    rows = errors.spans(df, ["model", "page_id"])
    found = {(r["class"]): r.n for r in errors.error_classes(errors.counted_spans(df, ["model"]), ["model"]).collect()}
    assert found == {"diacritical": 1, "paleographic_alternation": 1, "deleted_text": 1, "inserted_text": 1}
    words = {(r.tag, r.ref_word, r.hyp_word) for r in errors.word_errors(errors.counted_spans(df, ["model"], words=True), ["model"]).collect()}
    assert ("replace", "çenso", "censo") in words and ("delete", "dos", None) in words and ("insert", None, "x") in words
    run = spark.createDataFrame([("m", "p", "x" * 25 + "fin", "y" * 25 + "fin"), ("m", "q", "fin" + "x" * 25, "fin" + "y" * 25)], "model string, page_id string, ref string, hyp string")
    assert [(r.page_id, r.errors) for r in errors.garbled_runs(errors.spans(run, ["model", "page_id"]), ["model", "page_id"]).collect()] == [("p", 25)]


def test_runs_over_ranges(spark):
    rng = random.Random(7)
    rows = [(m, i * 3 + rng.randint(0, 2), rng.choice(["a", "b", None])) for m in "xy" for i in range(400)]
    df = spark.createDataFrame(rows, "model string, id long, v string").repartition(5)
    want = {}
    for m in "xy":
        run, before = 0, object()
        for _, i, v in sorted(r for r in rows if r[0] == m):
            run, before = run + (v != before), v
            want[m, i] = run
    for slices in (1, 7, 5000):
        assert {(r.model, r.id): r.run for r in layout.runs(df, ["model"], "id", ["v"], slices=slices).collect()} == want
    assert layout.runs(df.limit(0), ["model"], "id", ["v"]).count() == 0


def test_samples_keep_to_the_target(spark):
    rng = random.Random(2)
    rows = [(i, f"d{i}", rng.choice(["XV", "XVI", None]), rng.choice(["procesal", None]), rng.choice("abc"), rng.choice("xy"), rng.choice(["s", "---", None]), [f"{k}r" for k in range(rng.randint(0, 6))] or None) for i in range(200)]
    df = spark.createDataFrame(rows, "entry_id int, doc_id string, siglo string, letra string, provincia string, tipologia string, copista string, facsimile_pages array<string>")
    for target in (10, 150, 5000):
        found = sampling.sample_pages(sampling.first_entries(df), target).collect()
        assert len(found) <= target and len(set(found)) == len(found) and (target != 150 or len(found) > 120)
    assert sampling.sample_pages(sampling.first_entries(df.limit(0)), 5).count() == 0
    md = [(f"t{i}", "".join(f"[Fol. {k} recto]\n{'palabra ' * 12}\n" for k in range(1, n))) for i, n in enumerate((2, 4, 9, 30))]
    pages = sampling.sample_valid_pages(spark.createDataFrame(md, "doc_id string, md string"), 12).collect()
    assert len(pages) == 12 and len(set(pages)) == 12 and {r.doc_id for r in pages} == {"t1", "t2", "t3"}  # page 1 is what stands before the first folio


def test_layout(spark):
    boxes = [((0, 0, 100, 100), "main_text", 0.9), ((10, 10, 100, 100), "main_text", 0.5), ((20, 20, 40, 40), "graphic", 0.8), ((300, 300, 400, 400), "margin", 0.7)]
    assert layout.settle(boxes) == [((0, 0, 100, 100), "main_text", 0.9), ((300, 300, 400, 400), "margin", 0.7)]
    areas = spark.createDataFrame([("fits", 0, 0, 1000, 1200), ("high", 0, 0, 1200, 3500), ("tail", 0, 0, 1200, 1600), ("empty", 5, 5, 5, 5)], "page_id string, x1 int, y1 int, x2 int, y2 int")
    strips = {}
    for r in layout.strips(areas, F.lit(1568)).orderBy("page_id", "strip").collect():
        strips.setdefault(r.page_id, []).append((r.y1, r.y2))
    assert strips == {"fits": [(0, 1200)], "high": [(0, 1568), (1368, 2936), (2736, 3500)], "tail": [(0, 1600)]}
    tiles = {(r.page_id, r.row, r.col): (r.x1, r.y1, r.x2, r.y2) for r in layout.tiles(areas, F.lit(1568)).collect()}
    assert tiles["fits", 0, 0] == (0, 0, 1000, 1200) and ("high", 2, 0) in tiles and tiles["tail", 0, 0] == (0, 0, 1200, 1600)


def test_blocks_and_decisions(spark):
    rows = [("p", 1, "main_text", 0.9, "uno "), ("p", 2, "main_text", 0.9, "dos"), ("p", 3, "margin", 0.5, "nota"), ("p", 4, "graphic", 0.5, "  ")]
    blocks = spark.createDataFrame(rows, "page_id string, place int, region_type string, confidence double, text string")
    assert layout.join_blocks(blocks).first().text == "uno\ndos\n[margen: nota]"
    said = spark.createDataFrame([("0: skip — noise\n2: merge 1\nwhatever", 3)], "t string, n int").select(layout.parse_decisions(F.col("t"), F.col("n")).alias("d")).first().d
    assert [(x.action, x.detail) for x in said] == [("skip", ""), ("transcribe", ""), ("merge", "1")]


def test_train_documents(spark):
    sizes = {"a": 1, "b": 1, "c": 2, "d": 5, "e": 11}
    rows = spark.createDataFrame([(d, str(i)) for d, n in sizes.items() for i in range(n)], "doc_id string, page string")
    found = {r.doc_id: r.split for r in sampling.train_documents(rows).collect()}
    assert found == {"a": "train", "b": "train", "c": "train", "d": "validation", "e": "validation"}
    assert sampling.train_documents(rows.limit(0)).count() == 0


def test_vocabulary(spark):
    vocab = spark.createDataFrame([(w,) for w in "carta de venta vendo escriuano la".split()], "form string")
    texts = spark.createDataFrame([(1, "Carat deventa, vna xpo"), (2, None), (3, "")], "id int, t string")
    found = vocabulary.tokens_with_places(texts, "id", "t")
    assert [(r.original, r.start, r.end) for r in found.orderBy("place").collect()] == [("Carat", 0, 5), ("deventa", 6, 13), ("vna", 15, 18), ("xpo", 19, 22)]
    near = {(r.word, r.candidate, r.distance) for r in vocabulary.candidates(found, vocab, 2, 1).collect()}
    assert ("carat", "carta", 2) in near
    assert [tuple(r.parts) for r in vocabulary.compounds(found, vocab).collect()] == [("de", "venta")]
    fixed = spark.createDataFrame([(1, 0, 5, "Carta"), (1, 6, 13, "de venta")], "id int, start int, `end` int, replacement string")
    assert {r.id: r.text for r in vocabulary.corrected_texts(texts, fixed, "id", "t").collect()} == {1: "Carta de venta, vna xpo", 2: None, 3: ""}
    said = spark.createDataFrame([("1: carta\n x\n2 : KEEP ",)], "t string").select(vocabulary.parse_corrections(F.col("t")).alias("c")).first().c
    assert [tuple(x) for x in said] == [(1, "carta"), (2, "KEEP")]
    abbr = vocabulary.abbreviations(spark.createDataFrame([(1, "Q", "que/qual"), (2, "q", "Quien")], "id int, abbreviated string, expanded string"))
    assert [tuple(r) for r in abbr.collect()] == [("q", "quien")]


def test_abbreviations_of_split_lines(spark):
    df = spark.createDataFrame([("p", "eld\nic\nho Juan\n2\nreal"), ("q", None)], "page_id string, t string")
    rows = [(r.prefix, r.expansion, r.suffix, r.word) for r in vocabulary.abbreviation_instances(df, "page_id", "t").collect()]
    assert rows == [("eld", "ic", "ho", "eldicho")]
    assert df.select(vocabulary.base_word(F.lit("eldicho")).alias("b")).first().b == "dicho"


def test_corpus(spark):
    df = spark.createDataFrame([("[fir\nma: x] [Rubrica] dixo passar",), (None,)], "t string")
    assert {r.marker: r.n for r in corpus.marker_counts(df, "t").collect()} == {"[firma:]": 1, "[rúbrica]": 1}
    assert {r.feature for r in corpus.orthography(df, "t").collect()} >= {"x_for_j", "double_ss"}


def test_entities():
    assert matching.match([("Juan Pérez", "PER"), ("Toledo", "LOC")], [("Juan Peres", "PER"), ("Toledo", "PER")]) == 1
    assert matching.match([], [("a", "b")]) == 0


def test_quality(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    assert [(r.id, r.rule) for r in quality.violations(df, "id", {"given": F.col("v") != ""}).collect()] == [(2, "given")]
    assert [r.id for r in quality.not_done(df, df.where("id = 1"), ["id"]).collect()] == [2]


def test_stratified_documents_reaches_every_stratum(spark):
    rng = random.Random(1)
    rows = [(f"d{i}", rng.choice(["XV", "XVI"]), rng.choice(["procesal", "grifa", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, siglo string, letra string")
    found = sampling.stratified_documents(df)
    sizes = {r.stratum: r.n for r in sampling.strata(df).groupBy("stratum").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert {r.stratum: r.n for r in found.groupBy("stratum").agg(F.count("*").alias("n")).collect()} == {s: 1 + n // 6 for s, n in sizes.items()}


def test_registries(spark):
    from escriba.functions import text
    from escriba.operators import matching

    text.register_preprocessor("test_model", lambda t: F.regexp_replace(t, "^x+", ""))
    text.register_tier("T9_test", F.reverse)
    matching.register_pipeline("lengths", lambda picture: str(len(picture)))
    matching.register_pipeline("broken", lambda picture: picture[99])
    try:
        df = spark.createDataFrame([("a/test_model", "xxuno"), ("b", "xxuno")], "model string, t string")
        assert [r.t for r in df.select(text.preprocess(F.col("t"), F.col("model")).alias("t")).collect()] == ["uno", "xxuno"]
        gt = spark.createDataFrame([("codea", "critical", "p", "abc")], "subset string, edition string, page_id string, gt_text string")
        hyp = spark.createDataFrame([("m", "p", "abd")], "model string, page_id string, hyp_text string")
        assert evaluation.tier_metrics(gt, hyp).first()["T9_test"] == pytest.approx(1 / 3)
        images = spark.createDataFrame([("p", bytearray(b"abc"))], "path string, content binary")
        found = {r.pipeline: (r.text, r.error) for r in matching.transcriptions_by(images, ["lengths", "broken"]).collect()}
        assert found["lengths"] == ("3", None) and found["broken"][0] is None and found["broken"][1]
        for again in (lambda: text.register_tier("T9_test", F.reverse), lambda: matching.transcriptions_by(images, ["none"])):
            with pytest.raises(ValueError):
                again()
    finally:
        del text.PREPROCESSORS["test_model"], text.TIERS["T9_test"], matching.PIPELINES["lengths"], matching.PIPELINES["broken"]
