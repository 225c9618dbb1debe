"""Pieces of DuckDB SQL that several oracles share. White space is spelled out, as its regular expressions know ASCII only."""

from __future__ import annotations

from escriba.operators.evaluation import EXCLUDED_PAGES

S = r"[\p{Z}\t-\r\x{1c}-\x{1f}\x{85}]"
S_BUT_LF = r"[\p{Z}\t\x{0b}-\r\x{1c}-\x{1f}\x{85}]"


def replace(text: str, *steps: tuple[str, str]) -> str:
    """Nested replacements of all matches."""
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return text


def strip(text: str) -> str:
    return replace(text, (rf"^{S}+", ""), (rf"{S}+$", ""))


def collapse(text: str) -> str:
    return strip(replace(text, (f"{S}+", " ")))


def markers(text: str, mode: str) -> str:
    """The marker rules of a mode."""
    kept = {"content": ("interlineado", "sobrescrito", "encabezamiento", "firma", "mano[^:]*"), "lenient": ("interlineado", "sobrescrito", "encabezamiento")}[mode]
    for name in ("firma", "tachado", "margen", "interlineado", "sobrescrito", "encabezamiento", "nota", "mano[^:]*"):
        text = replace(text, (rf"(?is)\[{name}{S}*:{S}*(.*?)\]", r"\1" if name in kept else ""))
    text = replace(
        text,
        (r"(?i)\[blanco\]", " " if mode == "content" else ""),
        (r"(?i)\[(?:signo|rúbrica|cruz|ilegible|roto)\]", ""),
        (r"\[([a-záéíóúñç]{1,5})\]", r"\1"),
        ("  +", " "),
        (" *\n *", "\n"),
    )
    return strip(text)


def t1(text: str) -> str:
    return strip(replace(f"translate(nfc_normalize({text}), chr(173), '')", ("\t", " "), (" {2,}", " ")))


def t2(text: str) -> str:
    return replace(t1(text), (S, ""))


def t3(text: str) -> str:
    return f"replace(lower({t2(text)}), 'ß', 'ss')"


def t4(text: str) -> str:
    return replace(t3(text), (r"[^\p{L}\p{N}\p{M}]", ""))


#: Letters beyond ASCII that word lists have, and control characters that stand for them, so that bytes count as letters do.
WIDE = "áéíóúñçüãõàèòïêôâ·ìùû"
NARROW = "||".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)])


#: Characters beside those that texts have, for which bytes count as letters do.
CODES = "(" + "||".join(f"chr({i})" for i in range(1, 127)) + ")"


def distance(a: str, b: str, by: str = "''") -> str:
    """Edit distance in characters: each different character of the two texts becomes one of a single byte."""
    if by == "''":
        own = f"array_to_string(list_distinct(string_split({a} || {b}, '')), '')"
        return f"levenshtein(translate({a}, {own}, substr({CODES}, 1, length({own}))), translate({b}, {own}, substr({CODES}, 1, length({own}))))"
    both = f"list_intersect({a}, {b})"  # items that one side alone has are alike to each other, as they agree with nothing
    coded = lambda x, lone: f"array_to_string(list_transform({x}, lambda w: chr(CAST(coalesce(nullif(list_position({both}, w), 0) + 2, {lone}) AS INT))), '')"
    return f"levenshtein({coded(a, 1)}, {coded(b, 2)})"


def narrow(text: str) -> str:
    return f"translate({text}, '{WIDE}', {NARROW})"


def evaluation_text(text: str, mode: str) -> str:
    return collapse(markers(strip(text), mode) if mode != "strict" else strip(text))


def pairs(mode: str = "content") -> str:
    """refs, hyps and pairs of a comparison."""
    excluded = ", ".join(f"'{p}'" for p in EXCLUDED_PAGES)
    return f"""
refs AS (SELECT DISTINCT subset, edition, page_id, {evaluation_text("gt_text", mode)} AS ref FROM gt_page
  WHERE gt_text IS NOT NULL AND page_id IS NOT NULL AND page_id NOT IN ({excluded}) AND ((subset = 'codea' AND edition IN ('paleographic', 'critical')) OR (subset = 'toledo' AND edition = 'editorial'))),
hyps AS (SELECT DISTINCT model, page_id, {evaluation_text("hyp_text", mode)} AS hyp FROM hypothesis
  WHERE hyp_text IS NOT NULL AND page_id IS NOT NULL AND model IS NOT NULL),
pairs AS (SELECT subset, edition, page_id, model, ref, hyp FROM refs JOIN hyps USING (page_id))"""


PAIRS = pairs()
SCORED = f"""{PAIRS},
scored AS (SELECT subset, edition, page_id, model, ref, hyp, {distance("ref", "hyp")} AS distance, length(ref) AS gt_chars, length(hyp) AS hyp_chars FROM pairs)"""

PAGES = """
firsts AS (SELECT page_id, min(man_id) AS man_id FROM manifest WHERE page_id IS NOT NULL GROUP BY page_id),
pages AS (SELECT m.page_id, dataset, siglo, letra_normalized, doc_id FROM manifest m JOIN firsts USING (man_id))"""


def reconstructed(text: str) -> str:
    """Running text of line-split ground truth."""
    x = strip("x")
    kept = f"list_filter(string_split({text}, chr(10)), lambda x: NOT regexp_matches({x}, '^\\{{h\\.\\s+[0-9]+[rv]\\}}$') AND NOT regexp_matches({x}, '^[0-9]+$') AND NOT regexp_matches({x}, '^[a-záéíóúçñ]{{1,10}}$'))"
    return collapse(f"regexp_replace(array_to_string({kept}, ' '), '\\[[^\\]]*\\]', ' ', 'g')")


def review_markers(text: str) -> str:
    """The marker rules of the review variant."""
    for name in ("tachado", "raspado", "sobre raspado", "sobrescrito", "interlineado", "firma", "margen", r"mano \d+", "encabezamiento", "título", r"lat\.", "nota"):
        kept = any(k in name for k in ("firma", "interlineado", "sobrescrito", "encabezamiento", "mano"))
        text = replace(text, (rf"(?is)\[{name}{S}*:{S}*(.*?)\]", r"\1" if kept else ""))
    return replace(
        text,
        (r"(?i)\[blanco\]", " "),
        (r"(?i)\[(?:rúbrica|cruz|signo|sello|crismón|roto|doblez|mancha|ilegible|quirógrafo)\]", ""),
        (r"\[([a-záéíóúñç]{1,5})\]", r"\1"),
    )


#: Per page and model the rounded mean rate; per two models the signed-rank test and its correction.
TESTS = f"""{SCORED},
page_rates AS (SELECT page_id, model, round(avg(CASE WHEN gt_chars = 0 THEN CASE WHEN hyp_chars > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE distance / gt_chars END), 6) AS v FROM scored GROUP BY page_id, model),
mates AS (SELECT a.model AS model_a, b.model AS model_b, a.v - b.v AS d FROM page_rates a JOIN page_rates b ON a.page_id = b.page_id AND a.model < b.model),
ranked AS (SELECT model_a, model_b, d, count(*) OVER w AS t, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (count(*) OVER w - 1) / 2 AS r FROM mates WHERE d <> 0 WINDOW w AS (PARTITION BY model_a, model_b, abs(d))),
summed AS (SELECT model_a, model_b, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, sum(t * t - 1) AS ties, max(t) AS most FROM ranked GROUP BY model_a, model_b),
normal AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM summed WHERE n >= 2 AND (n > 50 OR most > 1)),
approximate AS (SELECT model_a, model_b, n, w, CASE WHEN z > 9 THEN 0 ELSE 2 / sqrt(2 * pi()) * (10 - z) / 2000 / 3 * list_sum(list_transform(range(0, 2001),
  lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(0 - (z + k * (10 - z) / 2000) * (z + k * (10 - z) / 2000) / 2))) END AS p FROM normal),
few AS (SELECT *, CAST(n * (n + 1) / 2 + 1 AS BIGINT) AS size FROM summed WHERE n >= 2 AND n <= 50 AND most = 1),
counted AS (SELECT *, list_reduce(list_concat([list_transform(range(1, size + 1), lambda i: CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)], list_transform(range(1, n + 1), lambda r: [r::DOUBLE])),
  lambda acc, x: list_transform(range(1, len(acc) + 1), lambda i: acc[i] + CASE WHEN i > x[1] THEN acc[i - CAST(x[1] AS BIGINT)] ELSE 0.0::DOUBLE END)) AS ways FROM few),
exact AS (SELECT model_a, model_b, n, w, least(1.0::DOUBLE, 2 * list_sum(ways[1:CAST(floor(w) AS BIGINT) + 1]) / (2.0::DOUBLE ** n)) AS p FROM counted),
tested AS (SELECT k.model_a, k.model_b, coalesce(t.n, 0) AS n, coalesce(CAST(t.w AS DOUBLE), 0) AS statistic, round(coalesce(t.p, 1), 6) AS p_value
  FROM (SELECT DISTINCT model_a, model_b FROM mates) k LEFT JOIN (SELECT * FROM approximate UNION ALL SELECT * FROM exact) t USING (model_a, model_b)),
placed AS (SELECT *, row_number() OVER (ORDER BY p_value, model_a, model_b) AS k, count(*) OVER () AS m FROM tested),
corrected AS (SELECT model_a, model_b, n, statistic, p_value, least(max(p_value * (m - k + 1)) OVER (ORDER BY p_value, model_a, model_b ROWS UNBOUNDED PRECEDING), 1) AS p_adjusted FROM placed)"""
