"""Problem 3: texts from scanned pages, repaired into continuous paragraphs.

Three averaged perceptrons of one kind work together. The character editor predicts keep, replace, delete and insert
operations inside words that the word list lacks; its line-join operation decides whether a line's last word goes on in the next
line of running text; the line model tells running headers and page numbers from text by their place on the page and
their shape. All are trained here, on a bounded sample of pages that exist in several editions and on clean lines of the
sample into which breaks, headers and page numbers are put.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escriba.llm.lookalikes import NOT_PLAIN, Skeletons
from escriba.llm.perceptron import AveragedPerceptron
from escriba.operators.pairs import busy

#: Pages with several editions from which the models learn, at most.
TRAIN_PAGES = 3000
#: Word forms that may be shipped to every task.
VOCABULARY_LIMIT = 2_000_000
#: Operations inside one word, at most, and one more where it holds signs that no word has; of words shorter than SHORT, one.
MOST_EDITS, SHORT = 2, 4
#: A word that the list lacks is a word all the same if it makes up this share of all texts, beyond doubt of so many standard deviations.
#: It is taken for misread, though, if one operation leads to a word that is so many times as frequent.
COMMON_SHARE, COMMON_DOUBT, MISREAD_RATIO = 3e-5, 3.0, 60

#: What the models are fitted on at most: operations learnt from the sample, clean lines for joining and for headers, pages for lines of text.
LEARNT_OPERATIONS, JOIN_LINES, HEADER_LINES, LINE_PAGES = 40, 6000, 3000, 2000
#: A page is taken for scanned if it shows any sign of it beyond letters read for one another in fewer words than this. Below it such
#: words can't be told from slips of the hand, which an edition keeps.
LEAST_MISREAD = 3

# What scanners read for a letter, as read and as meant.
CONFUSIONS = (
    "c e|e c|ii n|ii u|i' r|fi ñ|0 o|5 s|f s|@ a|a o|o a|1 l|1 i|f t|r t|z r|cl d|b d|li h|h b|rn m|u n|n u|q g|g q|6 ó|"
    "t l|l t|n m|vv w|rn in|iii m|m rn|8 b|9 g|$ s|( c|j i|í i|l i|i l|e o|o e|tl d|ni m|in m|nn m|lc k"
).split("|")
# Signs that break a word at a line's end.
MARKS = "-¬=~_⸗‐–—"
_CLOSING, _ENDS = ".,;:()[]{}¡!¿?\"«»|/", f"{MARKS} \t"
# Words of running headers, and how page numbers are set.
HEADERS = (
    "registro de {noun}|libro de {noun} — {place}|actas del concejo de {place}|protocolos de {place}, tomo {roman}|documentos de {place} ({year})|"
    "archivo de {place} · libro {roman}|{place}. {noun}|cartas de {noun}|cuaderno de {noun}|libro de {noun}|{place}, {year}|capítulo {roman}|título {roman}"
).split("|")
NUMBERS = "{n}|— {n} —|- {n} -|[{n}]|· {n} ·|pág. {n}|p. {n}|({n})|{n}.|– {n} –|{low}|fol. {n}".split("|")
#: Digits that are read as letters.
DIGIT_AS = {"0": "O", "1": "l", "2": "Z", "5": "S"}

_ODD, _LOOKS = re.compile(NOT_PLAIN.replace(r"\z", r"\Z")), Skeletons()
_TOKEN = re.compile(r"[^\s.,;:()\[\]{}¡!¿?\"«»|/]+")
_LAST, _HEAD = re.compile(r"[^\s.,;:()\[\]{}¡!¿?\"«»|/]*\Z"), re.compile(r"\s*([^\s.,;:()\[\]{}¡!¿?\"«»|/]+)")
_LETTER = re.compile(r"[^\W\d_]")
_NOT_IN_WORDS = re.compile(r"[\d@'$(]")
_FOLIO = re.compile(r"^\s*[\[(]\s*f(?:ol|olio|o)?\b\.?[^\])]*[\])]\s*$", re.I)
_MARK_LINE = re.compile(r"^\s*(?:[\[(][^\[\]()]*[\])]\s*)+$")
_NUMBER_LINE = re.compile(r"^\W*(?:p[áa]gs?\.?|p\.)?\W*(?=[\dlIZOSo]*\d|[lIZOS]+\W*$)[\dlIZOSo]{1,4}\W*$")
_ROMAN_LINE = re.compile(r"^\s*(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})\s*$")
_AMOUNT = re.compile(r"^\s*(?:[\d.,]+|[IVXLCDM]+)\s+\w+\.?\s*$")


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


# Spellings that are written for each other and are no misreading.
SPELLINGS = ((r"qu(?=[aeo])", "cu"), (r"q(?=u?[aeiouv])", "c"), (r"ç", "z"), (r"c(?=[eiy])", "z"), (r"[vb]", "u"), (r"y", "i"), (r"j", "x"), (r"m(?=[pu])", "n"), (r"ss", "s"), (r"ll(?=[bu])", "l"))
_SPELLINGS = [(re.compile(a), b) for a, b in SPELLINGS]


@lru_cache(500_000)
def spelling(word: str) -> str:
    """One form of a lower-case word for its old and modern spellings; accents are left out, a cedilla is a letter's own."""
    word = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn" or c == "\u0327")
    word = unicodedata.normalize("NFC", word)
    for pattern, by in _SPELLINGS:
        word = pattern.sub(by, word)
    return word


class Words:
    """The word list, its spellings, and which spellings count as the same word."""

    def __init__(self, forms: set[str]) -> None:
        self.forms = set(forms)
        self.keys = {spelling(f) for f in forms}
        self.sorted = sorted(self.forms)

    def add(self, forms: set[str]) -> None:
        """More words, such as the abbreviations of the sample."""
        self.forms |= forms
        self.keys |= {spelling(f) for f in forms}
        self.sorted = sorted(self.forms)

    def begins(self, start: str) -> bool:
        """Whether a listed word begins so."""
        at = bisect_left(self.sorted, start)
        return at < len(self.sorted) and self.sorted[at].startswith(start)

    def has(self, word: str) -> bool:
        return word in self.forms

    def spelled(self, word: str) -> bool:
        """Whether a word is another spelling of a listed one."""
        return spelling(word) in self.keys


def chunks(read: str, meant: str) -> list[tuple[str, str]]:
    """The parts in which two words differ, each as read and as meant."""
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, read, meant, autojunk=False).get_opcodes():
        if tag != "equal":
            out.append((read[a:b], meant[c:d]))
    return out


class Editor:
    """Predicts the operations that turn a word as read into the word that is meant."""

    def __init__(self, words: Words, operations: list[tuple[str, str]]) -> None:
        self.words = words
        self.operations = operations
        self.model = AveragedPerceptron()
        self.meant = lru_cache(300_000)(self._meant)
        self._by_letter: tuple[list[tuple[str, str]], dict[str, list[tuple[str, str]]]] | None = None

    def _one(self, word: str) -> Iterator[tuple[str, tuple[int, str, str]]]:
        for read, meant in self.operations:
            at = word.find(read)
            while at >= 0:
                yield word[:at] + meant + word[at + len(read) :], (at, read, meant)
                at = word.find(read, at + 1)

    def hypotheses(self, word: str) -> list[tuple[str, tuple[tuple[int, str, str], ...]]]:
        """The word as it is, and every listed word that the fewest operations lead to, MOST_EDITS at most.

        One operation may also lead to another spelling of a listed word. The editor goes through the word letter by letter, keeps, replaces, deletes
        or inserts, and stays on beginnings of listed words, so that no combination is left out.
        """
        out: list[tuple[str, tuple[tuple[int, str, str], ...]]] = [(word, ())]
        seen = {word}
        for new, edit in self._one(word):
            if new and new not in seen and (self.words.has(new) or self.words.spelled(new)):
                seen.add(new)
                out.append((new, (edit,)))
        most = 1 if len(word) < SHORT else MOST_EDITS + bool(_NOT_IN_WORDS.search(word))
        for depth in range(2, most + 1):
            if len(out) > 1:
                break
            for new, edits in self._written(word, depth):
                if new not in seen:
                    seen.add(new)
                    out.append((new, edits))
        return out

    def _written(self, word: str, depth: int) -> Iterator[tuple[str, tuple[tuple[int, str, str], ...]]]:
        """Listed words that exactly so many operations, from left to right, make of the word."""
        by_letter = self.by_letter
        open_: list[tuple[int, str, tuple[tuple[int, str, str], ...]]] = [(0, "", ())]
        while open_:
            at, start, edits = open_.pop()
            if at == len(word):
                if len(edits) == depth and self.words.has(start):
                    yield start, edits
                continue
            kept = start + word[at]
            if self.words.begins(kept):
                open_.append((at + 1, kept, edits))
            if len(edits) < depth:
                for read, meant in by_letter.get(word[at], ()):
                    if word.startswith(read, at) and self.words.begins(start + meant):
                        open_.append((at + len(read), start + meant, (*edits, (len(start), read, meant))))

    @property
    def by_letter(self) -> dict[str, list[tuple[str, str]]]:
        """The operations by the first letter that they read."""
        if self._by_letter is None or self._by_letter[0] is not self.operations:
            found: dict[str, list[tuple[str, str]]] = {}
            for read, meant in self.operations:
                found.setdefault(read[0], []).append((read, meant))
            self._by_letter = (self.operations, found)
        return self._by_letter[1]

    def features(self, word: str, new: str, edits: tuple[tuple[int, str, str], ...]) -> list[str]:
        if not edits:
            out = ["keep", f"keep word {word}", f"keep size {min(len(word), 6)}", f"keep end {word[-2:]}"]
            if self.words.spelled(word):
                out.append("keep spelled")
            if re.search(r"[\d@'$]", word):
                out += ["keep odd"] * 3
            return out
        out = [f"edits {len(edits)}", "listed" if self.words.has(new) else "spelled only", f"to size {min(len(new), 6)}"]
        for at, read, meant in edits:
            operation = "replace" if len(read) == len(meant) else "delete" if len(read) > len(meant) else "insert"
            before, behind = word[at - 1 : at] or "^", word[at + len(read) : at + len(read) + 1] or "$"
            out += [operation, f"{read}>{meant}", f"{before}|{read}>{meant}", f"{read}>{meant}|{behind}", f"{operation} at {'start' if at == 0 else 'in'}"]
            if spelling(word) == spelling(new):
                out.append("a spelling")
        return out

    def _meant(self, word: str) -> tuple[str, tuple[tuple[int, str, str], ...]]:
        """The word that is meant (lower case) and the operations that lead there; none if the word is kept."""
        if self.words.has(word):
            return word, ()
        found = self.hypotheses(word)
        return found[self.model.best([self.features(word, *h) for h in found])]

    def train(self, pairs: list[tuple[str, str]]) -> Editor:
        """Learn from (as read, as meant); other spellings of a word are meant as they are."""
        examples = []
        known: dict[str, tuple[list, list[list[str]]]] = {}
        for read, meant in pairs:
            if self.words.has(read):
                continue
            if spelling(read) == spelling(meant):
                meant = read
            if read not in known:
                found = self.hypotheses(read)
                known[read] = found, [self.features(read, *h) for h in found]
            found, features = known[read]
            right = [i for i, h in enumerate(found) if h[0] == meant]
            if right and len(found) > 1:
                examples.append((features, right[0]))
        self.model.fit(examples)
        return self


def tail(line: str) -> tuple[str, str, bool]:
    """(last word, break sign, whether a blank stands before the sign) of a line."""
    line = line.rstrip()
    body = line.rstrip(MARKS)
    sign = line[-1:] if len(body) < len(line) else ""
    bare = body.rstrip()
    last = bare[bare.rfind(" ") + 1 :]
    if not last.isalnum():
        last = _LAST.search(bare).group()
    return last, sign, bool(sign) and body != bare


def head(line: str) -> str:
    """First word of a line; empty if something else comes first."""
    found = _HEAD.match(line)
    return found.group(1) if found else ""


class Joiner:
    """Predicts the line-join operation."""

    def __init__(self, words: Words, editor: Editor) -> None:
        self.words, self.editor = words, editor
        self.model = AveragedPerceptron()

    def _state(self, word: str, repair: bool = False) -> str:
        low = word.lower()
        if self.words.has(low):
            return "listed"
        if self.words.spelled(low):
            return "spelled"
        if repair and len(low) >= 4 and self.editor.model.weights and self.editor.meant(low)[1]:
            return "repairable"
        return "unknown"

    def features(self, a: str, sign: str, spaced: bool, b: str) -> list[str]:
        first, second, both = self._state(a), self._state(b), self._state(a + b, repair=True)
        mark = "spaced" if spaced else "mark" if sign else "none"
        capital = b[:1].isupper()
        out = [mark, f"both {both}", f"{mark} both {both}", f"{mark} {first} {second} {both}", f"{first} {second} {both}", f"{mark} capital {capital}", f"capital {capital} {both}"]
        out += [f"{mark} short {min(len(a), 3)} {both}", f"{mark} second {second} short {min(len(b), 3)}"]
        return out

    def joins(self, a: str, sign: str, spaced: bool, b: str) -> bool:
        if b[:1].isupper() and not a.isupper():  # a broken word goes on in the case that it began in
            return False
        if not sign and (self._state(a + b) == "unknown" or self._state(a) != "unknown" and self._state(b) != "unknown"):
            return False
        if not a or not b or not _LETTER.search(a[-1:]) or not _LETTER.search(b[:1]) or not (sign or (len(a) + len(b) > 3)):
            return False
        return self.model.score(self.features(a, sign, spaced, b)) > 0

    def train(self, lines: list[list[str]], rng: random.Random) -> Joiner:
        """Learn from clean lines into which breaks are put, and dashes after whole words."""
        examples = []
        nothing: list[str] = []
        for words in lines:
            for word, follower in zip(words, words[1:], strict=False):
                kind = rng.random()
                sign = rng.choice(MARKS)
                if kind < 0.35 and len(word) >= 4:
                    at = rng.randint(1 if kind < 0.02 else 2, len(word) - 2)
                    examples.append(([nothing, self.features(word[:at], sign if kind < 0.3 else "", False, word[at:])], 1))
                elif kind < 0.5:
                    examples.append(([nothing, self.features(word, sign, kind > 0.42, follower)], 0))
                else:
                    examples.append(([nothing, self.features(word, "", False, follower)], 0))
        self.model.fit(examples)
        return self


class LineModel:
    """Tells running headers and page numbers from running text."""

    def __init__(self, words: Words) -> None:
        self.words = words
        self.model = AveragedPerceptron()
        self.counts = lru_cache(300_000)(self._counts)

    def texty(self, line: str) -> int:
        """How many lower-case listed words of two letters or more a line has."""
        return sum(map(self.counts, _TOKEN.findall(line)))

    def _counts(self, word: str) -> bool:
        return len(word) > 1 and word.islower() and (self.words.has(word) or self.words.spelled(word))

    def features(self, line: str, above: int, below: int, alone: bool, wide: bool = False) -> list[str]:
        """``above`` and ``below``: lines of text between this one and the page's edge."""
        bare = line.strip()
        tokens = bare.split()
        single = sum(len(t) == 1 for t in tokens)
        packed = re.sub(r"(?<=\w) (?=\w\b)", "", bare) if single > len(tokens) / 2 else bare
        letters = [c for c in bare if c.isalpha()]
        upper = sum(c.isupper() for c in letters) / max(1, len(letters))
        edge = "edge" if min(above, below) == 0 else "near" if min(above, below) == 1 else "inside"
        shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[\dlIZOS]+(?=\W|$)", "9", bare))[:12]
        out = [edge, f"top {min(above, 2)}", f"bottom {min(below, 2)}", f"alone {alone}", f"texty {min(self.texty(line), 3)}", f"words {min(len(tokens), 8)}"]
        out += [f"upper {int(upper * 4)}", f"upper {int(upper * 4)} {edge}", f"shape {shape}", f"shape {shape} {edge}", f"texty {min(self.texty(line), 3)} {edge}"]
        out += [f"indent {line[:1] == ' '}", f"gap {'   ' in bare}", f"end {bare[-1:] if not bare[-1:].isalnum() else 'w'}", f"comma {',' in bare}"]
        out += [f"lower start {bare[:1].islower()}", f"single {single * 2 > len(tokens) and len(tokens) > 4}"]
        if _NUMBER_LINE.match(bare):
            out += ["number", f"number {edge}"]
        if _ROMAN_LINE.match(bare):
            out += ["roman", f"roman {edge}"]
        if re.search(r"   ?\s*[\dlIZOS]{1,4}$|^[\dlIZOS]{1,4}\s{3,}", line.rstrip()):
            out += ["numbered", f"numbered {edge}"]
        low = "^" + re.sub(r"\W+", " ", packed.lower())[:28]
        out += [f"3 {low[i : i + 4]}" for i in range(0, min(len(low), 16) - 3)]
        return out

    def is_furniture(self, line: str, above: int, below: int, alone: bool) -> bool:
        return self.model.score(self.features(line, above, below, alone)) > 0


class Repair:
    """The three models and the reading of whole texts with them."""

    def __init__(self, forms: set[str]) -> None:
        self.words = Words(forms)
        self.editor = Editor(self.words, [tuple(c.split(" ")) for c in CONFUSIONS])
        self.joiner = Joiner(self.words, self.editor)
        self.lines = LineModel(self.words)
        self.kept = lru_cache(300_000)(self._kept)

    # reading ------------------------------------------------------------------------------------------------

    def roles(self, lines: list[str]) -> list[str]:
        """What each line is: front, blank, folio, mark, furniture or text."""
        out = [""] * len(lines)
        filled = [i for i, line in enumerate(lines) if line.strip()]
        for i in filled[:3]:
            if lines[i].strip() == "---":
                end = next((j for j in filled if j > i and lines[j].strip() == "---"), None)
                if end is not None:
                    for j in range(i, end + 1):
                        out[j] = "front"
                break
        for i, line in enumerate(lines):
            if out[i]:
                continue
            if not line.strip():
                out[i] = "blank"
            elif line.lstrip()[0] not in "[(":
                pass
            elif _FOLIO.match(line):
                out[i] = "folio"
            elif _MARK_LINE.match(line) and not _NUMBER_LINE.match(line):
                out[i] = "mark"
        shown = [self.lines.texty(line) for line in lines]
        open_lines = [i for i, role in enumerate(out) if not role]
        for i in open_lines:
            if _AMOUNT.match(lines[i]) and not _NUMBER_LINE.match(lines[i]):
                out[i] = "mark"
        open_lines = [i for i in open_lines if not out[i]]
        texty = [not role and n >= 2 for role, n in zip(out, shown, strict=True)]
        judged: dict[int, tuple[int, int, bool]] = {}
        for again in (False, True):  # what is furniture at first is an edge of the page the second time
            above, below = self._distances(out, texty), self._distances(out[::-1], texty[::-1])[::-1]
            for i in open_lines:
                if out[i] == "furniture":
                    continue
                if shown[i] >= 4 and "   " not in lines[i].strip():
                    out[i] = "text"
                    continue
                alone = (i == 0 or out[i - 1] in ("blank", "folio", "front")) and (i + 1 == len(lines) or not lines[i + 1].strip() or bool(_FOLIO.match(lines[i + 1])))
                place = (above[i], below[i], alone)
                if judged.get(i) != place:
                    judged[i] = place
                    out[i] = "furniture" if self.lines.is_furniture(lines[i], *place) else "text"
            if not again:
                if "furniture" not in out:
                    break
                texty = [role == "text" and n >= 2 for role, n in zip(out, shown, strict=True)]
        return out

    @staticmethod
    def _distances(roles: list[str], texty: list[bool]) -> list[int]:
        """Lines of text between each line and the last edge of a page before it."""
        out, count = [], 0
        for role, text in zip(roles, texty, strict=True):
            if role in ("folio", "front", "furniture"):
                count = 0
            out.append(count)
            count += text
        return out

    def read(self, text: str, whole: bool = True) -> tuple[list[tuple[int, str, str, str]], str]:
        """(line number, kind, as read, as meant) of every repair, and the text in paragraphs, if the whole is wanted."""
        odd = bool(_ODD.search(text))
        raw = text.split("\n")
        lines = [_LOOKS.of(x) if odd and _ODD.search(x) else x for x in raw]
        roles = self.roles(lines)
        found: list[tuple[int, str, str, str]] = []
        running = [i for i, role in enumerate(roles) if role == "text"]
        joined: dict[int, int] = {}
        for i, j in zip(running, running[1:], strict=False):
            if lines[i].rstrip()[-1:] in _CLOSING:  # no word is broken here
                continue
            a, sign, spaced = tail(lines[i])
            b = head(lines[j])
            if a and b and (sign or not (self.words.has(a.lower()) and self.words.has(b.lower()))) and self.joiner.joins(a, sign, spaced, b):
                joined[i] = j
                found.append((i + 1, "hyphen", f"{a}{sign}", a + b))
        begins = {j: i for i, j in joined.items()}
        fixed: dict[int, str] = {}
        for i in running:
            fixed[i] = self._line(i, lines, joined, begins, found)
        for i, role in enumerate(roles):
            if role == "furniture":
                found.append((i + 1, "furniture", lines[i].strip(), ""))
        if len(found) < LEAST_MISREAD and not any(kind != "misread" or self._sign_of_scanning(read) for _, kind, read, _ in found):
            found, fixed = [], {i: lines[i] for i in running}
        return sorted(found), self._paragraphs(roles, lines, fixed, joined) if whole else ""

    def _sign_of_scanning(self, word: str) -> bool:
        """Whether a misread word has more than letters read for letters: other signs, or one letter read as two or two as one."""
        return any(not (len(read) == len(meant) == 1 and read.isalpha()) for _, read, meant in self.editor.meant(word.lower())[1])

    def _line(self, i: int, lines: list[str], joined: dict[int, int], begins: dict[int, int], found: list) -> str:
        """The line with its misread words repaired; reports each."""
        line = lines[i]
        if i not in joined and i not in begins and all(map(self.kept, _TOKEN.findall(line.rstrip(_ENDS)))):
            return line
        out, last = [], 0
        tokens = list(_TOKEN.finditer(line))
        for k, m in enumerate(tokens):
            word, start, end = m.group(), m.start(), m.end()
            before = behind = ""
            if k == 0 and i in begins:
                before = tail(lines[begins[i]])[0]
            if k == len(tokens) - 1 and i in joined:
                word = tail(line)[0]
                end = start + len(word)
                behind = head(lines[joined[i]])
            elif k == len(tokens) - 1:
                word = word.rstrip(MARKS)
                end = start + len(word)
            whole = before + word + behind
            if len(word) < 1 or not _LETTER.search(whole):
                continue
            low = whole.lower()
            meant, edits = self.editor.meant(low) if len(low) == len(whole) else (low, ())
            mine = [e for e in self._places(edits) if len(before) <= e < len(before) + len(word)]
            if edits and mine:
                found.append((i + 1, "misread", whole, meant))
                if not before and not behind:
                    out += [line[last:start], meant.capitalize() if whole[:1].isupper() or not whole[:1].isalpha() and False else meant]
                    last = end
        return "".join(out) + line[last:]

    def _kept(self, word: str) -> bool:
        """Whether a word by itself is no misread one."""
        low = word.lower()
        return not _LETTER.search(word) or len(low) != len(word) or not self.editor.meant(low)[1]

    @staticmethod
    def _places(edits: tuple[tuple[int, str, str], ...]) -> list[int]:
        """Where in the word as read each operation stands."""
        out, shift = [], 0
        for at, read, meant in edits:
            out.append(at - shift)
            shift += len(meant) - len(read)
        return out

    def _paragraphs(self, roles: list[str], lines: list[str], fixed: dict[int, str], joined: dict[int, int]) -> str:
        paragraphs: list[str] = []
        current = ""
        glue = False
        gap = False
        for i, role in enumerate(roles):
            if role == "blank":
                gap = True
            elif role in ("folio", "mark"):
                if role == "mark":
                    current = f"{current} {lines[i].strip()}".strip() if not glue else current
            elif role == "text":
                line = fixed[i].strip()
                if glue:
                    word = head(line)
                    rest = line[len(word) :]
                    whole = current + word
                    last = whole.split(" ")[-1]
                    meant, edits = self.editor.meant(last.lower())
                    if edits:
                        whole = whole[: len(whole) - len(last)] + (meant.capitalize() if last[:1].isupper() else meant)
                    current = whole + rest
                elif gap and current.rstrip().endswith((".", "]", ":")):
                    paragraphs.append(current)
                    current = line
                else:
                    current = f"{current} {line}".strip()
                gap = False
                glue = i in joined
                a, sign, _ = tail(line)
                if glue:
                    current = re.sub(rf"\s*[{re.escape(MARKS)}]+$", "", current)
                elif sign:
                    current = re.sub(rf"\s*[{re.escape(MARKS)}]+$", "", current)
        if current:
            paragraphs.append(current)
        return "\n\n".join(paragraphs)

    # learning ------------------------------------------------------------------------------------------------

    def train(self, pages: list[list[str]], frequent: dict[str, int], seed: int = 3) -> Repair:
        """Learn from pages, each a list of its editions, and from the frequent words of all texts and how often these have them."""
        rng = random.Random(seed)
        self.words.add(self._common(frequent))
        pairs, clean = self._pairs(pages)
        pairs += self._spoilt(rng, 4000)
        counted = Counter(c for read, meant in pairs if spelling(read) != spelling(meant) for c in chunks(read, meant))
        known = {tuple(c.split(" ")) for c in CONFUSIONS}
        learnt = [c for c, n in sorted(counted.items(), key=lambda x: (-x[1], x[0])) if n >= 5 and c[0] and c not in known and len(c[0]) <= 3 and len(c[1]) <= 2]
        self.editor.operations = [*self.editor.operations, *learnt[:LEARNT_OPERATIONS]]
        self.editor.train(pairs)
        self.editor.meant.cache_clear()
        self.joiner.train(self._with_misread(clean[:JOIN_LINES], pairs, rng), rng)
        self._train_lines(pages, clean, rng)
        self.editor.meant.cache_clear()
        self.kept.cache_clear()
        self.lines.counts.cache_clear()
        return self

    @staticmethod
    def _with_misread(lines: list[list[str]], pairs: list[tuple[str, str]], rng: random.Random) -> list[list[str]]:
        """The lines with some words put as they are misread."""
        spoilt: dict[str, list[str]] = {}
        for read, meant in pairs:
            if read != meant:
                spoilt.setdefault(meant, []).append(read)
        return [[rng.choice(spoilt[w.lower()]) if rng.random() < 0.15 and w.lower() in spoilt else w for w in line] for line in lines]

    def _common(self, counted: dict[str, int]) -> set[str]:
        """Words that the list lacks but the texts have often: abbreviations and names of marks."""
        return {
            word
            for word, n in counted.items()
            if len(word) > 1 and word.isalpha() and not self.words.has(word) and all(counted.get(new, 0) < MISREAD_RATIO * n for new, _ in self.editor._one(word))
        }

    def _tokens(self, text: str) -> list[str]:
        words: list[str] = []
        lines = [_LOOKS.of(x) if _ODD.search(x) else x for x in text.split("\n") if x.strip()]
        for line in lines:
            words += [w.rstrip(MARKS) for w in _TOKEN.findall(line)]
        return [w for w in words if w]

    def _pairs(self, pages: list[list[str]]) -> tuple[list[tuple[str, str]], list[list[str]]]:
        """(as read, as meant) of words that editions of a page have at the same place, and clean lines."""
        pairs: list[tuple[str, str]] = []
        clean: list[list[str]] = []
        for editions in pages:
            texts = [t for t in editions if t]
            for text in texts[:2]:
                for line in text.split("\n"):
                    words = _TOKEN.findall(line)
                    if len(words) > 3 and all(self.words.has(w.lower()) for w in words):
                        clean.append(words)
            for a, b in zip(texts, texts[1:], strict=False):
                left, right = [w.lower() for w in self._tokens(a)], [w.lower() for w in self._tokens(b)]
                for tag, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
                    if tag == "equal":
                        pairs += [(w, w) for w in left[i:j] if not self.words.has(w)]
                    elif tag == "replace" and j - i == m - k:
                        for x, y in zip(left[i:j], right[k:m], strict=True):
                            if self.words.has(y) and not self.words.has(x):
                                pairs.append((x, y))
                            elif self.words.has(x) and not self.words.has(y):
                                pairs.append((y, x))
        near = [(x, y) for x, y in pairs if x == y or SequenceMatcher(None, x, y, autojunk=False).ratio() > 0.5]
        return near, clean

    def _spoilt(self, rng: random.Random, n: int) -> list[tuple[str, str]]:
        """Listed words spoilt by one confusion."""
        forms = sorted(f for f in self.words.forms if len(f) > 3)
        out = []
        for _ in range(n if forms else 0):
            word = rng.choice(forms)
            read, meant = rng.choice(CONFUSIONS[:30]).split(" ")
            places = [i for i in range(len(word)) if word.startswith(meant, i)]
            if places:
                at = rng.choice(places)
                new = word[:at] + read + word[at + len(meant) :]
                if not self.words.has(new):
                    out.append((new, word))
        return out

    def _header(self, rng: random.Random, words: list[str]) -> str:
        noun = rng.choice(words).lower() if words else "testigo"
        text = rng.choice(HEADERS).format(noun=noun, place=rng.choice(words).capitalize() if words else "Villa", roman=_roman(rng.randint(1, 30)).upper(), year=rng.randint(1440, 1690))
        case = rng.random()
        text = text.upper() if case < 0.3 else text.lower() if case < 0.36 else text[:1].upper() + text[1:]
        if rng.random() < 0.2:
            text = " ".join(text.replace(" ", "  "))
        if rng.random() < 0.25:
            read, meant = rng.choice(CONFUSIONS[:25]).split(" ")
            text = text.replace(meant, read, 1) if rng.random() < 0.5 else text.replace("O", "0").replace("I", "1")
        number = rng.random()
        n = str(rng.randint(1, 300))
        return f"{n}   {text}" if number < 0.25 else f"{text}   {n}" if number < 0.5 else f"  {text}" if number < 0.75 else text

    def _train_lines(self, pages: list[list[str]], clean: list[list[str]], rng: random.Random) -> None:
        nothing: list[str] = []
        examples = []
        words = [w for line in clean[:HEADER_LINES] for w in line if len(w) > 4] or ["testigo", "villa"]
        texts = []
        for editions in pages[:LINE_PAGES]:
            for text in editions[:1]:
                lines = [_LOOKS.of(x) if _ODD.search(x) else x for x in (text or "").split("\n")]
                texts.append(" ".join(x.strip().rstrip(MARKS) for x in lines if self.lines.texty(x) >= 3).split())
        places = [(0, 9), (9, 0), (5, 5), (5, 5), (1, 8), (8, 1)]
        for source in texts:
            if len(source) < 12:
                continue
            for size in (rng.randint(1, 3), rng.randint(2, 5), rng.randint(4, 7), rng.randint(7, 11)):
                at = rng.randint(0, len(source) - size)
                line = " ".join(source[at : at + size])
                if any(c.islower() for c in line):
                    examples.append(([nothing, self.lines.features(line, *rng.choice(places), rng.random() < 0.1)], 0))
            last = " ".join(source[-rng.randint(1, 3) :])  # the end of a page's text is no furniture, short as it may be
            examples.append(([nothing, self.lines.features(last if last[-1:] == "." or rng.random() < 0.3 else f"{last}.", 9, 0, False)], 0))
            if rng.random() < 0.4:
                signed = f"{rng.choice(['Pasó ante mí', 'ante mí', '[firma:', '[rúbrica]'])} {rng.choice(words).capitalize()} {rng.choice(words).capitalize()}"
                examples.append(([nothing, self.lines.features(signed, 9, 0, rng.random() < 0.5)], 0))
            top = rng.random()
            place = (0, 9) if top < 0.6 else (9, 0) if top < 0.8 else (5, 5)
            examples.append(([nothing, self.lines.features(self._header(rng, words), *place, rng.random() < 0.4)], 1))
            n = rng.randint(1, 320)
            digits = str(n)
            if rng.random() < 0.2:
                digits = "".join(DIGIT_AS.get(c, c) for c in digits)
            number = rng.choice(NUMBERS).format(n=digits, low=_roman(n))
            place = rng.choice([(9, 0), (9, 0), (0, 9), (5, 5)])
            examples.append(([nothing, self.lines.features(number, *place, rng.random() < 0.5)], 1))
        self.lines.model.fit(examples)


def read_vocabulary(vocabulary: DataFrame, column: str = "form") -> set[str]:
    """The word list; refuses one beyond VOCABULARY_LIMIT."""
    rows = vocabulary.where(F.col(column).isNotNull()).select(column).distinct().limit(VOCABULARY_LIMIT + 1).collect()
    if len(rows) > VOCABULARY_LIMIT:
        raise ValueError(f"the word list has more than {VOCABULARY_LIMIT} forms")
    return {r[0].lower() for r in rows}


def training_pages(pages: DataFrame, text: str = "gt_text", page: str = "page_id", limit: int = TRAIN_PAGES) -> list[list[str]]:
    """Editions of up to ``limit`` pages that have several, drawn by a hash of the page; a page gives four texts at most."""
    rows = pages.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(page).isNotNull()).select(F.col(page).alias("page"), F.col(text).alias("text"))
    several = rows.groupBy("page").agg(F.count("*").alias("n"), F.min(F.xxhash64("page")).alias("draw")).where("n > 1")
    drawn = several.orderBy("draw", "page").limit(limit).select("page")
    kept = rows.join(F.broadcast(drawn), "page").groupBy("page").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.min_by("text", F.xxhash64("text")).alias("c"))
    return [sorted({r.a, r.b, r.c}) for r in kept.orderBy("page").collect()]


def frequent_words(texts: DataFrame, text: str) -> dict[str, int]:
    """How often all texts have the words that make up COMMON_SHARE of them beyond doubt; 1 / COMMON_SHARE words at most.

    The first and last word of a line are left out, as they may be parts of a broken one.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter[str] = Counter()
            for t in batch[text]:
                for line in (_LOOKS.of(t) if _ODD.search(t) else t).split("\n"):
                    found.update(_TOKEN.findall(line)[1:-1])
            yield pd.DataFrame({"word": [w.lower() for w in found], "n": list(found.values())}).astype({"word": object, "n": "int64"})

    words = busy(texts.where(F.col(text).isNotNull()).select(text)).mapInPandas(count, "word string, n bigint")
    counted = words.groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    sure = F.col("n") - COMMON_DOUBT * F.sqrt("n") >= COMMON_SHARE * F.col("total")
    return {r.word: r.n for r in counted.crossJoin(F.broadcast(total)).where(sure).select("word", "n").collect()}  # total has one row


def trained(vocabulary: DataFrame, pages: DataFrame, texts: DataFrame, text: str, limit: int = TRAIN_PAGES) -> Repair:
    """The models, fitted on a bounded sample of pages; frequent words are counted over all texts."""
    return Repair(read_vocabulary(vocabulary)).train(training_pages(pages, limit=limit), frequent_words(texts, text))


class _Shipped:
    """What the workers need of the models."""

    def __init__(self, repair: Repair) -> None:
        self.forms = repair.words.forms
        self.operations = repair.editor.operations
        self.models = (repair.editor.model.weights, repair.joiner.model.weights, repair.lines.model.weights)

    def restore(self) -> Repair:
        out = Repair(self.forms)
        out.editor.operations = self.operations
        out.editor.model.weights, out.joiner.model.weights, out.lines.model.weights = self.models
        return out


def _read_all(texts: DataFrame, key: str, text: str, repair: Repair, whole: bool) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast(_Shipped(repair))  # a word list and weights of bounded size

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value.restore()
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text], strict=True):
                found, clean = model.read(t, whole)
                if whole:
                    out.append((k, clean, len(found)))
                else:
                    out += [(k, *f) for f in found]
            columns = ["rec_id", "text", "repairs"] if whole else ["rec_id", "line_no", "kind", "as_read", "as_meant"]
            yield pd.DataFrame(out, columns=columns)

    rows = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text)
    schema = "rec_id bigint, text string, repairs int" if whole else "rec_id bigint, line_no int, kind string, as_read string, as_meant string"
    return busy(rows).mapInPandas(work, schema)


def repairs(texts: DataFrame, key: str, text: str, repair: Repair) -> DataFrame:
    """(rec_id, line_no, kind, as_read, as_meant): what was repaired where; lines count from 1. Null and empty texts give nothing."""
    return _read_all(texts, key, text, repair, whole=False)


def repaired(texts: DataFrame, key: str, text: str, repair: Repair) -> DataFrame:
    """(rec_id, text, repairs): the continuous text in paragraphs, and how many repairs it took."""
    return _read_all(texts, key, text, repair, whole=True)
