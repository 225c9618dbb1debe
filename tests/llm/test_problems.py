"""The problems' operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import random
import re
import unicodedata
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from escriba.llm import canonical, containers, leakage, lookalikes, proportions, queries, related_splits, residue, scans

DATA = "/root/testdata/sf0.001"


# --- 1 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def manifest(spark):
    rng = random.Random(3)
    rows = [(f"d{rng.randint(0, 400)}", rng.choice(["XV", "1480", "1530", "XVI", "s. XV", None, ""]), rng.choice(["procesal", "cortesana", None]), "clash") for _ in range(3000)]
    return spark.createDataFrame([*rows, (None, "XV", "procesal", "clash")], "doc_id string, siglo string, letra_normalized string, draw string")


@pytest.fixture(scope="module")
def targets(spark):
    rows = [("XV", "procesal", 100, 2), ("XVI", "procesal", 900, 1), ("XV", "grifa", 0, 3), ("XVI", "cortesana", 5000, 1)]
    return spark.createDataFrame(rows, "siglo string, letra_normalized string, target_permille int, min_docs int")


def test_proportions(spark, manifest, targets):
    def century(s):
        if s in ("XV", "XVI", "XVII"):
            return s
        return None if not s or not re.match(r"\d{4}", s) else "XV" if int(s[:4]) < 1500 else "XVI" if int(s[:4]) < 1600 else "XVII"

    rows = [(r.doc_id, century(r.siglo), r.letra_normalized) for r in manifest.collect() if r.doc_id is not None]
    n = len({r[0] for r in rows}) // 5
    want, have = {}, {}
    for t in targets.collect():
        cell = (t.siglo, t.letra_normalized)
        have[cell] = len({r[0] for r in rows if r[1:] == cell})
        want[cell] = max(t.min_docs, t.target_permille * n // 1000)
    report = {(r.siglo, r.letra_normalized): r for r in proportions.sample_report(manifest, targets).collect()}
    assert {c: (r.needed, r.available, r.deficit) for c, r in report.items()} == {c: (want[c], have[c], max(0, want[c] - have[c])) for c in want}
    sample = proportions.proportional_sample(manifest, targets).collect()
    assert len({r.doc_id for r in sample}) == len(sample)
    assert all(r.drawn <= r.needed and r.drawn + r.short == r.needed for r in report.values())
    assert report["XV", "procesal"].drawn == want["XV", "procesal"]
    again = proportions.proportional_sample(manifest.repartition(7), targets, slices=16).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in sample}  # the same draw, however rows and slices lie
    assert proportions.proportional_sample(manifest.limit(0), targets).count() == 0
    assert proportions.unmet_cells(manifest.limit(0), targets).count() == 4 - sum(1 for t in targets.collect() if t.min_docs == 0)


def test_a_cell_gets_what_another_can_do_without(spark):
    rows = [(f"d{i}", "XV", "procesal") for i in range(10)] + [(f"d{i}", "XV", "grifa") for i in range(11)]
    manifest = spark.createDataFrame(rows, "doc_id string, siglo string, letra_normalized string")
    targets = spark.createDataFrame([("XV", "procesal", 0, 5), ("XV", "grifa", 0, 5)], "siglo string, letra_normalized string, target_permille int, min_docs int")
    assert {(r.drawn, r.short, r.deficit) for r in proportions.sample_report(manifest, targets).collect()} == {(5, 0, 0)}
    every = spark.createDataFrame([("XV", "procesal", 0, 8), ("XV", "grifa", 0, 8)], targets.schema)
    report = proportions.sample_report(manifest, every).collect()
    assert sum(r.drawn for r in report) == 11 and all(r.deficit == 0 for r in report)


def test_quotas_meet_as_many_needs_as_a_matching():
    rng = random.Random(20)
    for _ in range(300):
        cells = "abcd"[: rng.randint(1, 4)]
        needs = {c: rng.randint(0, 4) for c in cells}
        strata = {}
        for _ in range(rng.randint(0, 4)):
            strata[tuple(sorted(rng.sample(cells, rng.randint(1, len(cells)))))] = rng.randint(1, 4)
        given = proportions.quotas(needs, strata)
        assert all(0 <= n for g in given.values() for n in g.values()) and all(sum(given[s].values()) <= n for s, n in strata.items())
        got = {c: sum(g.get(c, 0) for g in given.values()) for c in cells}
        assert all(got[c] <= needs[c] for c in cells)
        # by the theorem of deficient sets: what is met is the least, over sets of cells, of their supply and the needs of the others
        subsets = [set(x) for k in range(len(cells) + 1) for x in combinations(cells, k)]
        most = min(sum(n for s, n in strata.items() if set(s) & x) + sum(needs[c] for c in cells if c not in x) for x in subsets)
        assert sum(got.values()) == most


# --- 2 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("carta", "саrtа", True),  # Cyrillic
        ("señor", "señor", True),
        ("ｃａｒｔａ，", "carta,", True),
        ("a b", "a b", True),
        ("a​b⁠", "ab", True),
        ("ⅯⅭ vⅼ", "MC vl", True),
        ("é", "е́", True),  # an accent on a Cyrillic letter
        ("carta \nb", "carta\nb", True),
        ("fin­\nal", "fin-\nal", True),
        ("senor", "señor", False),
        ("l", "1", False),
        ("O", "0", False),
        ("rn", "m", False),
        ("a\nb", "a b", False),
        ("a b", "a  b", False),
        ("scriº", "scrio", False),
        ("Carta", "carta", False),
        ("ſu", "su", False),
    ],
)
def test_looks(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(lookalikes.skeleton(F.col("a")).alias("a"), lookalikes.skeleton(F.col("b")).alias("b")).first()
    assert (row.a == row.b) is same


def test_skeletons_in_the_jvm_and_in_python_agree(spark):
    make = lookalikes.Skeletons()
    rng = random.Random(2)
    alphabet = "ab ñéçº·–\n" + "оа́​" * 1
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lookalikes.skeleton(F.col("t")).alias("s")).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        assert row.s == make.of(text) == make.of(row.s), repr(text)


def test_look_pairs(spark):
    gt = spark.createDataFrame([(1, "p", "carta"), (2, "p", "саrta"), (3, "p", None), (4, "p", ""), (5, None, "carta"), (1, "p", "carta")], "gt_id int, page_id string, gt_text string")
    hyp = spark.createDataFrame([(10, "p", "cаrtа", 1), (11, "p", "carta", 1), (12, "q", "cаrta", 1), (13, "p", None, 1), (14, None, "cаrta", 1)], "hyp_id int, page_id string, hyp_text string, gt_id int")
    assert {tuple(r) for r in lookalikes.same_look_pairs(gt, hyp.drop("gt_id")).collect()} == {(1, 10), (2, 10), (2, 11)}
    assert lookalikes.same_look_pairs(gt.limit(0), hyp.drop("gt_id")).count() == 0


# --- 3 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def repair(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    return scans.trained(read("vocab"), read("gt_page"), read("gt_page"), "gt_text")


def test_repair(repair):
    page = "LIBRO DE CARTA — Torliño   12\nen la villa de Torliño a siete dias del mes de agosto, Juana\nentregaua el pleyto y los alguazi-\nles que fueron presentes. sepan quantos esta\ncaita vieren como yo Juana vezina de la vi1la —\nde buena moneda que pagaua la casa\n[firma: Juana]\n— 267 —"
    found, clean = repair.read(page)
    kinds = {(line, kind) for line, kind, _, _ in found}
    assert {(1, "furniture"), (8, "furniture"), (3, "hyphen"), (5, "misread")} <= kinds
    assert (5, "hyphen") not in kinds and not any(line in (2, 6, 7) for line, _ in kinds)
    assert "alguaziles" in clean and "villa" in clean and "267" not in clean and "LIBRO" not in clean


def test_repair_of_odd_texts(spark, repair):
    assert repair.read("") == ([], "")
    assert repair.read("\n\n  \n")[0] == []
    assert repair.read("---\nslug: x1\n---\n[Fol. 1 recto]\n(Cruz)\n831 mrs.")[0] == []
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "carta de venta " * 20_000, "x")], "id long, t string, text string")
    assert scans.repairs(df, "id", "t", repair).where("rec_id < 3").count() == 0
    assert scans.repaired(df, "id", "t", repair).count() == 1


def test_held_out_breaks_and_misreadings(repair):
    """Words of the list, spoilt and broken by other draws than those of the training."""
    rng = random.Random(99)
    forms = sorted(f for f in repair.words.forms if len(f) > 6 and f.isalpha())
    seen = right = broken = joined = kept = 0
    for word in rng.sample(forms, 300):
        read, meant = rng.choice(scans.CONFUSIONS[:12]).split(" ")
        if meant in word:
            spoilt = word.replace(meant, read, 1)
            if not repair.words.has(spoilt):
                seen += 1
                right += bool(repair.editor.meant(spoilt)[1])
        at = rng.randint(2, len(word) - 2)
        broken += 1
        joined += repair.joiner.joins(word[:at], "-", False, word[at:])
        kept += not repair.joiner.joins(word, "-", False, rng.choice(forms))
    assert right / seen > 0.9 and joined / broken > 0.9 and kept / broken > 0.9


# --- 4 -----------------------------------------------------------------------------------------------------------


def test_canonical_values(spark):
    reference = spark.createDataFrame([(1, "procesal", ["letra de proceso"]), (2, "procesal encadenada", []), (6, "cortesana/procesal", None), (9, "humanística", ["italiana"])], "letra_id int, letra string, aliases array<string>")
    wanted = {"PROCESAL": 1, "letra  de proceso.": 1, "encadenada procesal": 2, "procesal - cortesana": 6, "humanisitca": 9, "l. italiana (s. XVI)": 9, "proc. encadenada": 2, "pergamino": 0, "?": 0, "procesal": 1}
    rows = [(i, v) for i, v in enumerate([*wanted, None, " ", ""])]
    mapped = canonical.map_values(spark.createDataFrame(rows, "id int, v string"), "id", "v", reference)
    found = {r.value: (r.letra_id, r.how) for r in mapped.collect()}
    assert {v: x[0] for v, x in found.items()} == wanted
    assert found["procesal"][1] == "same" and found["letra  de proceso."][1] == "mention"
    assert {r.value for r in canonical.unmatched_values(mapped).collect()} == {"pergamino", "?"}
    assert canonical.map_values(spark.createDataFrame(rows, "id int, v string"), "id", "v", reference.limit(0)).where("letra_id > 0").count() == 0


def test_automaton_takes_the_longest_mentions():
    known = canonical.CanonicalList([(1, ["procesal"]), (2, ["procesal encadenada"])])
    assert [m[2] for m in known.mentions("letra procesal encadenada y procesal")] == [2, 1]
    assert canonical.edits("abcd", "acbd") == 1 and canonical.edits("", "ab") == 2
    known = canonical.CanonicalList([(1, ["procesal"]), (2, ["procesal encadenada"]), (3, ["cortesana", "de corte"]), (4, ["cortesana/procesal"])])
    wanted = {"cortesana muy deteriorada": 3, "la procesal del archivo": 1, "procesal encadenda": 2, "letra de corte y procesal": 4, "procesal de corte": 4, "papel": 0}
    assert {v: known.find(v)[0] for v in wanted} == wanted


def test_letters_lose_no_close_word(corpus_words):
    rng = random.Random(21)
    letters = canonical.Letters(corpus_words)
    for word in rng.sample(corpus_words, 60):
        at = rng.randint(0, len(word) - 2)
        typed = word[:at] + word[at + 1] + word[at] + rng.choice("zx") * rng.randint(0, 2) + word[at + 2 :]
        for least in (0.4, 0.6):
            assert {w for w in corpus_words if canonical.closeness(typed, w) >= least} <= set(letters.near(typed, least))


# --- 5 -----------------------------------------------------------------------------------------------------------


def test_identifier_keys(spark):
    same = [["CODEA-0007", "codea 7", "CODEA_00000007", "Codea-0007 ", "CODEA0007"], ["0227_1675-05-22", " 227 1675.05.22", "000227_16750522", "0227-1675-05-22"], ["0228_1675-05-22"], ["CODEA-0070"]]
    rows = [(i, v) for i, group in enumerate(same) for v in group]
    found = spark.createDataFrame(rows, "g int, v string").withColumn("k", related_splits.identifier_key(F.col("v"))).collect()
    assert len({(r.g, r.k) for r in found}) == len({r.k for r in found}) == len(same)
    assert spark.createDataFrame([("x",), ("",), (None,)], "v string").where(related_splits.identifier_key(F.col("v")).isNotNull()).count() == 0


def _components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for x in parent:
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {"chain": [(f"v{i:03}", f"v{i + 1:03}") for i in range(60)], "star": [("hub", f"v{i}") for i in range(80)], "random": [(f"v{rng.randint(0, 99)}", f"v{rng.randint(0, 99)}") for _ in range(70)]}[shape]
    found = {}
    for r in related_splits.components(spark.createDataFrame([*edges, *edges[:3]], "a string, b string")).collect():
        found.setdefault(r.component, set()).add(r.vertex)
    assert {frozenset(g) for g in found.values()} == _components([e for e in edges if e[0] != e[1]])


def test_related_pairs_and_splits(spark):
    rows = [("CODEA-1", "p1"), ("codea 01", "p2"), ("x", "p2"), ("y", None), (None, "p1"), ("", "p1"), *[(f"d{i}", f"q{i}") for i in range(200)]]
    df = spark.createDataFrame(rows, "doc_id string, page_id string").withColumn("weight", F.lit("clash"))
    group = ["", "CODEA-1", "codea 01", "x"]
    assert {tuple(r) for r in related_splits.related_pairs(df).collect()} == set(combinations(sorted(group), 2))
    targets = spark.createDataFrame([("train", 700), ("test", 200), ("validation", 100)], "split_name string, target_permille int")
    found = {r.doc_id: r.split_name for r in related_splits.assign_splits(df, targets).collect()}
    assert len(found) == 205 and len({found[d] for d in group}) == 1
    shares = {s: list(found.values()).count(s) / 205 for s in ("train", "test", "validation")}
    assert shares == pytest.approx({"train": 0.7, "test": 0.2, "validation": 0.1}, abs=0.05)
    assert related_splits.assign_splits(df.limit(0), targets).count() == 0 and related_splits.related_pairs(df.limit(0)).count() == 0


# --- 6 -----------------------------------------------------------------------------------------------------------


def test_bounds_and_packing():
    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        sizes = np.array([rng.randint(1, 10) for _ in range(rng.randint(0, 7))])
        where, count = containers.best_fit_decreasing(sizes, 10)
        assert all(sizes[where == b].sum() <= 10 for b in range(count))

        def least(items, bins):
            if not items:
                return len(bins)
            best = least(items[1:], [*bins, items[0]])
            for i, b in enumerate(bins):
                if b + items[0] <= 10:
                    best = min(best, least(items[1:], [*bins[:i], b + items[0], *bins[i + 1 :]]))
            return best

        assert containers.lower_bound(sizes, 10) <= least([int(s) for s in sizes], []) <= count
    assert containers.lower_bound(np.array([6, 6, 6]), 10) == 3


def test_pack_documents(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 150), 1) for i in range(500)] + [(7, "same", 1)] * 30 + [(900, "ñ" * 400, 1), (901, None, 1), (902, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy int")
    packed = containers.pack_documents(df, 200, partition_items=100).cache()
    loads = {r.container: r.t for r in packed.groupBy("container").agg(F.sum("tokens").alias("t")).collect()}
    assert max(loads.values()) <= 200 and sum(loads.values()) == sum(len(t.encode()) + 1 for _, t, _ in rows if t is not None)
    assert packed.count() == len(rows) - 1 + 4  # the long text in five pieces, the null one out
    assert [r.doc_id for r in containers.split_documents(packed).collect()] == [900]
    report = containers.packing_report(packed, 200).first()
    assert report.containers >= report.least_by_sum and report.unused < 0.1
    assert containers.pack_documents(df.limit(0), 200).count() == 0


# --- 7 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus_words():
    rng = random.Random(8)
    return ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(4, 9))) for _ in range(600)]


def test_leaks(spark, corpus_words):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(corpus_words) for _ in range(n))
    items = [(i, text(50)) for i in range(1, 6)]
    words = {i: t.split() for i, t in items}
    near = " ".join(words[4][10:34]).replace(words[4][20], "otra")
    docs = [
        (10, text(60) + " " + items[0][1].upper() + " " + text(30)),
        (11, text(20) + " " + " ".join(words[2][5:22]) + " " + text(20)),
        (12, text(20) + " " + " ".join(words[3][5:17]) + " " + text(20)),  # twelve words are no leak
        (13, text(40) + " " + near + " " + text(5)),
        (14, items[4][1].replace("a", "а")),  # Cyrillic
        (15, None),
        (16, ""),
        (17, text(3000)),
        (18, " ".join(words[2][5:12]) + " | " + " ".join(words[2][12:22]) + " [nota] " + " ".join(words[2][22:25])),
        (10, items[1][1]),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    passages = spark.createDataFrame([*items, (9, None), (8, "muy corto")], "item_id int, text string")
    found = {(r.item_id, r.doc_id) for r in leakage.leaked_passages(df, passages).collect()}
    assert found == {(1, 10), (2, 11), (4, 13), (5, 14), (2, 18), (2, 10)}
    assert leakage.leaked_passages(df, passages.limit(0)).count() == 0 and leakage.leaked_passages(df.limit(0), passages).count() == 0


def test_every_fingerprint_within_the_radius_is_found(corpus_words):
    import numpy as np

    rng = random.Random(10)
    index = leakage.Passages([(i, " ".join(rng.choice(corpus_words) for _ in range(40))) for i in range(30)])
    asked = np.unpackbits(index.prints.view(np.uint8).reshape(-1, 16), axis=1).astype(np.int32) * 2 - 1
    for row in asked:
        for bit in rng.sample(range(128), rng.randint(0, leakage.RADIUS + 4)):
            row[bit] *= -1
    a, b = index.near(asked)
    packed = np.packbits(asked > 0, axis=1).view(np.uint64).reshape(-1, 2)
    apart = np.bitwise_count(packed[:, None, :] ^ index.prints[None, :, :]).sum(axis=2)
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} == {(int(x), int(y)) for x, y in zip(*np.nonzero(apart <= leakage.RADIUS), strict=True)}


def test_a_text_longer_than_a_chunk(corpus_words):
    rng = random.Random(11)
    item = [rng.choice(corpus_words) for _ in range(40)]
    index = leakage.Passages([(1, " ".join(item))])
    long = [rng.choice(corpus_words) for _ in range(leakage.CHUNK - 20)]
    text = [leakage.word_key(w) for w in [*long, *item, *long]]
    places = index.candidates([["x"] * 30, text])[1, 1]
    assert leakage.verify([text], {(0, 1): places}, index)[0, 1][0] == 40


def test_short_pieces_with_changed_words(corpus_words):
    rng = random.Random(12)
    items = {i: [rng.choice(corpus_words) for _ in range(40)] for i in range(20)}
    formula = "sepan quantos esta carta vieren como yo diego morales vezino desta villa otorgo e conozco".split()
    for words in items.values():
        words += [*formula[:7], rng.choice(corpus_words), rng.choice(corpus_words), *formula[9:]]
    index = leakage.Passages([(i, " ".join(w)) for i, w in items.items()])
    items, formula = index.words, leakage.words_of(" ".join(formula))

    def found(item, piece):
        text = [rng.choice(corpus_words) + "zz" for _ in range(25)]
        text = [*text[:12], *piece, *text[12:]]
        places = index.candidates([text]).get((0, item))
        return places is not None and (0, item) in leakage.verify([text], {(0, item): places}, index)

    for item in items:
        for size, changed in ((15, (1, 13)), (15, (4, 8, 11)), (15, (1, 7, 13)), (17, (1, 5, 9, 15)), (20, (3, 7, 11, 15, 17))):
            piece = [w if k not in changed else "otrapalaura" for k, w in enumerate(items[item][4 : 4 + size])]
            assert found(item, piece), (item, size, changed)
        spelt = [w if k % 3 or len(w) < 5 else w[:2] + "w" + w[3:] for k, w in enumerate(items[item][4:19])]
        assert found(item, spelt)
        assert not found(item, items[item][4:17])
        assert not found(item, [*formula[:7], "alonso", "perez", *formula[9:]])


# --- 8 -----------------------------------------------------------------------------------------------------------

RESIDUE = [
    "Yten {{folio}} rogado", "en {% siglo %} la", "con <%= fecha %> y", "la ${NOTARIO} dicha", "el %(folio)s de", "por __importe__ y", "fue @@page_id@@ de", "a ##lugar## b", "y [[TITULO]] z",
    "la [INSERTAR notario] es", "es [fecha aquí] y", "y {resumen} z", "Lorem ipsum dolor sit amet", "Magna elit lorem tempor amet", "TBD TBD TBD", "asdf asdf qwer", "xxxx xxxxx xxx", "Texto de ejemplo.",
    "que Error 404 página no encontrada", "HTTP 503 Service Unavailable", "status=500 Internal Server Error", "SQLSTATE[08006]: no se pudo conectar", "Traceback (most recent call last): x", "[object Object] undefined undefined NaN",
    "Ative o JavaScript para ver o documento.", "Enable cookies to continue", "para ver esta transcripción permita JavaScript en su navegador", "Este sitio necesita guiones activos: active la opción.", "Su sеsión ha caducado",
]
GENUINE = [
    "La página 12 del libro no fue encontrada en el archivo, según la nota del copista.", "El error del escriuano en el folio 3 se corrigió al margen.", "El acceso al legajo estuvo denegado hasta el año de 1950.",
    "Falta el servidor de la capilla, que no está disponible en 1530.", "The scribe's script is enabled by wide ruling; cookies of wax remain on folio 3.", "dolor y muerte; ipsum corpus in terra positum",
    "yo fulano, vezino de tal lugar, otorgo a vos fulano tal poder", "sea notorio a quantos vieren como N. vende a N.", "en el dicho dia {3} fojas y media", "{h. 12r} traslado [tachado: la dicha] [roto] [nota]", "", "***",
]


def test_residue(spark):
    texts = [*RESIDUE, *GENUINE, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("local", F.lit(1)).withColumn("kind", F.lit(2))
    found = {r.doc_id for r in residue.residue(df.select("doc_id", "text", "local", "kind")).collect()}
    assert {texts[i] for i in found} == set(RESIDUE)
    assert residue.residue(df.limit(0)).count() == 0


def test_templates_are_judged_once(spark):
    words = ["uno", "dos", "tres", "cuatro"] * 20
    texts = [f"vendieron la viña de Lope {w} Error {n}: página no encontrada en {w} visor de la casa" for n, w in enumerate(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    model = residue.trained(df)
    rows = residue.templates(residue.mined(df, model), model).where("kind IS NOT NULL").collect()
    assert {r.kind for r in rows} == {"error"} and all("pagina no encontrada" in r.template and not r.template.startswith("vendieron") for r in rows)
    assert len(rows) < 4 and sum(r.documents for r in rows) == 80


def test_a_message_in_words_that_no_example_has_is_found_and_genuine_text_is_not():
    known, _ = residue.labelled()
    left_out = [m for m in known if {"gateway", "cargar", "forbidden"} & set(m[1])]
    model = residue.trained_on(GENUINE * 3, [m for m in known if m not in left_out])
    found = [" ".join(words) for _, words in left_out if model.verdict(words)]
    assert {"no se ha podido cargar la pagina", "error # gateway timeout"} <= set(found)
    assert not any(model.verdict(s) for text in GENUINE for s in residue.segments(text))


def test_trimming_and_templates_keep_the_verdict():
    rng = random.Random(4)
    model = residue.trained_on(GENUINE)
    known, genuine = residue.labelled()
    pool = [w for _, words in known for w in words] + [w for words in genuine for w in words]
    miner = residue.Miner(model)
    for _ in range(3000):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 25))]
        part = miner.trimmed(words)
        assert model.verdict(words) == (model.verdict(part) if part else None)
        if part:
            assert model.verdict(miner.tree.add(part)) == model.verdict(part)


# --- all ---------------------------------------------------------------------------------------------------------

COLUMNS = {"p1": ["siglo", "letra_normalized"], "p2": ["gt_id", "hyp_id"], "p3": ["rec_id", "line_no", "kind"], "p4": ["rec_id", "letra_id"], "p5": ["doc_a", "doc_b"], "p6": ["doc_id"], "p7": ["item_id", "doc_id"], "p8": ["doc_id"]}


@pytest.mark.parametrize("problem", sorted(COLUMNS))
def test_found(spark, problem):
    df = queries.queries()[f"{problem}_found"](spark, DATA)
    assert df.columns == COLUMNS[problem]
    rows = df.collect()
    assert len(set(rows)) == len(rows) and not any(v is None for r in rows for v in r)


def test_look_alike_pairs_against_brute_force(spark):
    make = lookalikes.Skeletons()
    gt = spark.read.parquet(f"{DATA}/gt_page.parquet").where("gt_text <> ''").collect()
    hyp = spark.read.parquet(f"{DATA}/hypothesis.parquet").where("hyp_text <> ''").collect()
    want = {(g.gt_id, h.hyp_id) for g in gt for h in hyp if g.page_id == h.page_id and g.gt_text != h.hyp_text and make.of(g.gt_text) == make.of(h.hyp_text)}
    assert {tuple(r) for r in queries.p2_found(spark, DATA).collect()} == want
    assert unicodedata.normalize("NFC", "é") == "é"
