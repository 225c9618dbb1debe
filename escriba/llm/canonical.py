"""Problem 4: freely typed values mapped to the entries of a canonical list.

A multi-pattern automaton over the canonical names and aliases finds mentions inside a value; the longest ones that do not
overlap win. The words they leave open decide only whether a longer entry is meant that holds the mentioned one. Values without a mention go to
a similarity of token sets that forgives misspelling, word order, abbreviation and misplaced spaces. Words that can't be close are told
apart by their letters alone, so that a long list needs few edit distances. Each batch maps its different values once; the list
is small and fixed, so it travels with the task, and rows are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least similarity of a value to the entry it is mapped to.
DEFAULT_THRESHOLD = 0.6
#: Words less close than this are not taken for each other.
LEAST_WORD = 0.4
#: A list beyond so many entries is refused: it would have to be shipped to every task.
LIST_LIMIT = 20_000
#: Distinct values that a worker remembers.
MEMORY = 100_000

# Words that say nothing about which entry is meant.
FILLER = "letra l escritura tipo clara sic s siglo xiv xv xvi xvii xviii de del la el con muy tambien posible probable aprox ca".split()


def plain(text: str) -> str:
    """Lower case without accents; anything but letters and digits is a space."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def edits(a: str, b: str) -> int:
    """Edit distance in which swapping neighbours counts once (restricted Damerau-Levenshtein)."""
    if a == b:
        return 0
    older: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        older, before = before, row
    return before[-1]


def closeness(a: str, b: str) -> float:
    """1 for equal words, 0 for unrelated ones."""
    return 1 - edits(a, b) / max(len(a), len(b), 1)


def word_match(typed: str, wanted: str) -> float:
    """Closeness of words; an abbreviation that starts the wanted word counts nearly whole."""
    if len(typed) >= 3 and len(typed) < len(wanted) and wanted.startswith(typed):
        return max(0.9, closeness(typed, wanted))
    return closeness(typed, wanted)


class Letters:
    """Words by their letters. The edit distance of two words is no less than the letters that one has and the other lacks."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.lengths = np.array([len(w) for w in words], dtype=np.int32)
        self.columns = {c: i for i, c in enumerate(sorted({c for w in words for c in w}))}
        self.bags = np.zeros((len(words), len(self.columns)), dtype=np.int16)
        for i, word in enumerate(words):
            for c in word:
                self.bags[i, self.columns[c]] += 1

    def near(self, word: str, least: float) -> list[str]:
        """The words whose closeness to this one may reach ``least``; all others can't."""
        bag = np.zeros(len(self.columns), dtype=np.int16)
        for c in word:
            if c in self.columns:
                bag[self.columns[c]] += 1
        shared = np.minimum(self.bags, bag).sum(axis=1)
        longer = np.maximum(self.lengths, len(word))
        return [self.words[i] for i in np.flatnonzero(longer - shared <= (1 - least) * longer + 1e-9)]


class CanonicalList:
    """Entries (id, names) with the automaton over all names."""

    def __init__(self, entries: list[tuple[int, list[str]]], threshold: float = DEFAULT_THRESHOLD) -> None:
        import ahocorasick

        self.threshold = threshold
        self.names: dict[str, int] = {}
        self.exact: dict[str, int] = {}
        self.first: dict[int, str] = {}
        for entry, names in entries:
            self.exact.setdefault(names[0], entry)
            self.first.setdefault(entry, next((plain(n) for n in names if plain(n)), ""))
            for name in names:
                if name and plain(name):
                    self.names.setdefault(plain(name), entry)
        self.ranks = {name: k for k, name in enumerate(self.names)}
        self.places: dict[str, list[str]] = {}
        self.glued: dict[str, list[str]] = {}
        for name in self.names:
            for word in set(name.split()):
                self.places.setdefault(word, []).append(name)
            self.glued.setdefault(name.replace(" ", ""), []).append(name)
        self.letters, self.glued_letters = Letters(list(self.places)), Letters(list(self.glued))
        self.automaton = ahocorasick.Automaton()
        for name, entry in self.names.items():
            self.automaton.add_word(f" {name} ", (len(name) + 2, name, entry))
        if self.names:
            self.automaton.make_automaton()
        self.find = lru_cache(MEMORY)(self._find)
        self.close_words = lru_cache(MEMORY)(self._close_words)

    def mentions(self, text: str) -> list[tuple[int, int, int]]:
        """Longest mentions (start, end, entry) of a plain text that do not overlap; of equally long ones the first."""
        padded = f" {text} "
        hits = sorted(
            ((end - length + 1, end + 1, entry) for end, (length, _, entry) in self.automaton.iter(padded)),
            key=lambda hit: (hit[0] - hit[1], hit[0]),
        )
        taken: list[tuple[int, int, int]] = []
        for start, end, entry in hits:
            if all(end - 1 <= a or start >= b - 1 for a, b, _ in taken):
                taken.append((start, end, entry))
        return sorted(taken)

    def _find(self, value: str) -> tuple[int, str, float]:
        """(entry or 0, how it was found, similarity)."""
        if value in self.exact:
            return self.exact[value], "same", 1.0
        text = plain(value)
        if not text or not self.names:
            return 0, "none", 0.0
        if text in self.names:
            return self.names[text], "mention", 1.0
        found = self.mentions(text)
        if not found:
            return self._similar(text, self._reachable(text))
        padded = f" {text} "
        _, start, _, entry = max((end - start, -start, end, entry) for start, end, entry in found)  # the longest, of equal ones the first
        for begin, end, other in reversed(found):  # aliases as the names they stand for
            padded = padded[: begin + 1] + self.first[other] + padded[end - 1 :]
        held = set(self.first[entry].split())
        if any(w not in held and w not in FILLER for w in padded.split()):
            best = self._similar(padded.strip(), [n for n in self.places[next(iter(held))] if held < set(n.split())])
            if best[0]:
                return best
        return entry, "mention", 1.0

    def _close_words(self, typed: str) -> dict[str, float]:
        """The words of the list that a typed one may stand for, with their closeness."""
        near = set(self.letters.near(typed, LEAST_WORD))
        if len(typed) >= 3:
            near.update(w for w in self.places if w.startswith(typed))
        return {w: score for w in near if (score := word_match(typed, w)) >= LEAST_WORD}

    def _reachable(self, text: str) -> list[str]:
        """The names that can reach the threshold: one of their words is so close to a typed one, or all of them without spaces."""
        names: dict[str, None] = {}
        for typed in text.split():
            for word, score in self.close_words(typed).items():
                if score >= self.threshold:
                    names.update(dict.fromkeys(self.places[word]))
        for joined in ("".join(text.split()), "".join(t for t in text.split() if t not in FILLER)):
            for one in self.glued_letters.near(joined, self.threshold):
                names.update(dict.fromkeys(self.glued[one]))
        return list(names)

    def _similar(self, text: str, names: list[str]) -> tuple[int, str, float]:
        """The most similar of the names; of equal ones the longer, then the first of the list."""
        typed = text.split()
        best = (0.0, 0, 0)
        for name in sorted(names, key=self._order):
            score = max(self._token_set(typed, name.split()), self._glued(typed, name))
            if (score, len(name)) > best[:2]:
                best = (score, len(name), self.names[name])
        if best[0] >= self.threshold:
            return best[2], "similar", round(best[0], 4)
        return 0, "none", round(best[0], 4)

    def _order(self, name: str) -> int:
        return self.ranks[name]

    def _token_set(self, typed: list[str], wanted: list[str]) -> float:
        """Share of letters of both token sets that are matched one to one, filler aside."""
        pairs = sorted(
            ((close.get(w, 0.0), i, j) for i, close in enumerate(map(self.close_words, typed)) for j, w in enumerate(wanted)), key=lambda p: (-p[0], p[1], p[2])
        )
        used_typed: set[int] = set()
        used_wanted: set[int] = set()
        matched = total = 0.0
        for score, i, j in pairs:
            if score >= LEAST_WORD and i not in used_typed and j not in used_wanted:
                used_typed.add(i)
                used_wanted.add(j)
                size = max(len(typed[i]), len(wanted[j]))
                matched += score * size
                total += size
        total += sum(len(w) for j, w in enumerate(wanted) if j not in used_wanted)
        total += sum(len(t) for i, t in enumerate(typed) if i not in used_typed and t not in FILLER and not t.isdigit())
        return matched / total if total else 0.0

    def _glued(self, typed: list[str], name: str) -> float:
        """Closeness without spaces, for words run together or broken at the wrong place."""
        wanted = name.replace(" ", "")
        words = [t for t in typed if t not in FILLER or t in name.split()]
        return closeness("".join(words), wanted)


def read_list(reference: DataFrame) -> list[tuple[int, list[str]]]:
    """Entries of the reference list; refuses a list beyond LIST_LIMIT."""
    rows = reference.select("letra_id", "letra", "aliases").orderBy("letra_id").limit(LIST_LIMIT + 1).collect()
    if len(rows) > LIST_LIMIT:
        raise ValueError(f"the canonical list has more than {LIST_LIMIT} entries")
    return [(r.letra_id, [r.letra, *(r.aliases or [])]) for r in rows if r.letra]


RESULT = T.StructType([T.StructField("letra_id", T.IntegerType()), T.StructField("how", T.StringType()), T.StructField("similarity", T.DoubleType())])


def canonical_entry(value: Column, entries: list[tuple[int, list[str]]], threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Struct (letra_id, how, similarity) of each value; letra_id is 0 where no entry is meant.

    Null and blank values give null. Ties go to the longer name, then to the earlier entry.
    """

    @F.pandas_udf(RESULT)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = CanonicalList(entries, threshold)
        for values in batches:
            codes, different = pd.factorize(values)  # null is -1
            found = [known.find(v) if v.strip() else (None, None, None) for v in different] + [(None, None, None)]
            table = pd.DataFrame(found, columns=["letra_id", "how", "similarity"]).astype({"letra_id": "Int32", "how": object, "similarity": "Float64"})
            yield table.iloc[codes].reset_index(drop=True)

    return match(value)


def map_values(rows: DataFrame, key: str, value: str, reference: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(rec_id, value, letra_id, how, similarity) of every row whose value is neither null nor blank."""
    entries = read_list(reference)
    rows = rows.select(F.col(key).alias("rec_id"), F.col(value).alias("value")).where("value IS NOT NULL")
    return rows.withColumn("found", canonical_entry(F.col("value"), entries, threshold)).select("rec_id", "value", "found.*").where("letra_id IS NOT NULL")


def unmatched_values(mapped: DataFrame) -> DataFrame:
    """Values without an entry and how often they occur."""
    return mapped.where("letra_id = 0").groupBy("value").agg(F.count("*").alias("n"))
