"""Pair metrics: known values, invariants, and the bit vectors against the plain recurrence."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from escriba.functions import align, metrics

CASES = [
    # ref, hyp, cer, nls, boc
    ("a", "a", 0.0, 1.0, 0.0),
    ("a", "b", 1.0, 0.0, 2.0),
    ("Foo", "", 1.0, 0.0, 1.0),
    ("", "", 0.0, 1.0, 0.0),
    ("", "Foo", 1.0, 0.0, 1.0),
    ("Foo", "Food", 1 / 3, 0.75, 0.25),
    ("Fnord", "Food", 0.4, 0.6, 0.6),
    ("X", "X X Y Y", 6.0, 1 - 6 / 7, 6 / 7),
    ("kitten", "sitting", 0.5, 4 / 7, 5 / 7),
    ("lewenstein", "levenshtein", 0.2, 9 / 11, 3 / 11),
    ("aab", "abb", 1 / 3, 2 / 3, 2 / 3),
    ("aaaa", "bbbb", 1.0, 0.0, 2.0),
]


def test_known_values(spark):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "i int, r string, h string")
    r, h = F.col("r"), F.col("h")
    rows = df.select("i", metrics.cer(r, h).alias("cer"), metrics.nls(r, h).alias("nls"), metrics.boc(r, h).alias("boc")).orderBy("i").collect()
    for row, case in zip(rows, CASES, strict=True):
        assert (row.cer, row.nls, row.boc) == pytest.approx(case[2:]), case


def test_words_and_lines(spark):
    cases = [("X", "Y", 1.0), ("X Y X", "X Z", 2 / 3), ("X", "Y Z", 2.0), ("this is a test", "this a test", 0.25), ("  ", "hello", 1.0), ("X", "X X Y Y", 3.0), ("", "", 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, r string, h string")
    found = [x.w for x in df.select("i", metrics.wer(F.col("r"), F.col("h")).alias("w")).orderBy("i").collect()]
    assert found == pytest.approx([c[2] for c in cases])
    lines = [("hello\nworld", "hello\nWorld", 0.5), ("a\nb\nc", "a\nb", 1 / 3), ("a", "a\nb\nc", 2 / 3), ("", "hello", 1.0), ("", "", 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(lines)], "i int, r string, h string")
    found = [x.s for x in df.select("i", metrics.ser(F.col("r"), F.col("h")).alias("s")).orderBy("i").collect()]
    assert found == pytest.approx([c[2] for c in lines])


def test_tiers(spark):
    cases = [("Hello World", "helloworld!", (4 / 11, 3 / 11, 1 / 11, 0.0)), ("", "x", (1.0,) * 4), ("", "", (0.0,) * 4)]
    for ref, hyp, want in cases:
        df = spark.createDataFrame([(ref, hyp)], "r string, h string")
        row = df.select(*[v.alias(k) for k, v in metrics.tier_error_rates(F.col("r"), F.col("h")).items()]).first()
        assert tuple(row) == pytest.approx(want)


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "r string, h string")
    assert [x.c for x in df.select(align.operation_counts(F.col("r"), F.col("h")).substitutions.alias("c")).collect()] == [None, None]
    assert [x.c for x in df.select(align.edit_distance(F.col("r"), F.col("h")).alias("c")).collect()] == [None, None]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcñ 😀", max_size=14), st.text("abcñ 😀", max_size=14))
def test_alignment_against_the_recurrence(a, b):
    s, d, i, c = align.counts(a, b)
    want = plain_distance(a, b)
    assert s + d + i == want == align.distance(a, b)
    assert c + s + d == len(a) and c + s + i == len(b)
    ops = align.operations(a, b)
    assert "".join(b[x:y] if t != "delete" else "" for t, _, _, x, y in ops) == b
    assert all(y - x == m - k for t, x, y, k, m in ops if t == "replace")


def test_exact_counts():
    assert align.counts("kitten", "sitting") == (2, 0, 1, 4)
    assert align.counts("ab", "xyz") == (2, 0, 1, 0)
    assert align.counts("abcde", "ace") == (0, 2, 0, 3)
    assert align.counts("abc", "aXbYcZ") == (0, 0, 3, 3)


def test_score_and_feedback(spark):
    df = spark.createDataFrame([("abcde", "abcde"), ("abcd", "abxy"), ("abcd", "wxyz"), ("", "x")], "r string, h string")
    rows = df.select(metrics.score(F.col("r"), F.col("h")).alias("s")).withColumn("f", metrics.feedback(F.col("s"))).collect()
    assert [r.s for r in rows] == pytest.approx([1.0, 0.5, 0.0, 0.0])
    assert rows[0].f.startswith("CER 0%. Good") and rows[1].f.startswith("CER 50%. Moderate") and rows[2].f.startswith("CER 100%. High")


def test_distances_in_step_equal_those_one_by_one():
    rng = random.Random(30)
    refs, hyps = [], []
    for _ in range(700):
        a = [rng.choice("abcdeñ ") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 128, 200]))]
        b = list(a)
        for _ in range(rng.randint(0, 40)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(["x", "", "ab", "c"])
        if rng.random() < 0.2:
            b = [rng.choice("abcdeñ ") for _ in range(rng.randint(0, 150))]
        refs.append("".join(a))
        hyps.append("".join(b))
    numbers = lambda t: np.array([ord(c) for c in t], dtype=np.uint32)
    found = align.distances([numbers(r) for r in refs], [numbers(h) for h in hyps])
    assert found.tolist() == [align.distance(r, h) for r, h in zip(refs, hyps, strict=True)]
