"""Problem 7: evaluation passages that occur, whole or in part, in a training corpus.

Each passage gives windows of words at a fixed stride, each document a window at every word. Windows have 128-bit SimHash
fingerprints; a multi-index over blocks finds every pair within the radius (pigeonhole: of BLOCKS blocks at least one
differs in no more than RADIUS // BLOCKS bits). Fingerprints lose short pieces with several changed words, so places where three
words in sequence are alike, and enough around them, are candidates as well. Candidates are then checked exactly: the words
are aligned and the aligned piece must be long enough, close enough word by word, and close enough by its weighted shingles or
by what its agreeing words say beyond a formula.

The passages are a held-out set; they are taken in blocks of bounded size, whose index travels with the task, and documents are
read once per block, in place. Only found pairs are shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escriba.llm.lookalikes import NOT_PLAIN, Skeletons
from escriba.operators.pairs import busy

#: Words of a window, and words from one window of a passage to the next: any run of WINDOW + STRIDE - 1 words of a passage holds one.
WINDOW, STRIDE = 13, 3
#: Words of a passage, in one piece, that make a leak.
LEAST_WORDS = 15
BITS, BLOCKS = 128, 7
#: Fingerprints that differ in no more bits are candidates.
RADIUS = 20
#: Shares of an aligned piece: of words that agree, and of the weight of its shingles (words and pairs of words) that agree.
LEAST_AGREEMENT, LEAST_SIMILARITY = 0.75, 0.58
#: Words of the passages that are searched for in one go; their index takes some 2 KB a word. More passages take more goes.
BLOCK_WORDS = 200_000
#: Words whose windows are handled at once, and pieces that are aligned at once.
CHUNK, ALIGNED = 4_000, 256
#: Words that a worker remembers what it found out about.
MEMORY = 500_000
#: What a word that doesn't agree costs in the alignment; one that does gains 1.
PENALTY = 1.5
#: Words in sequence that every piece shares: of LEAST_WORDS with LEAST_AGREEMENT of them alike, some three in sequence are. Around
#: them, with words shifted by at most DRIFT, LEAST_NEAR of LEAST_WORDS must be alike before the piece is aligned.
SEED, DRIFT, LEAST_NEAR = 3, 2, 9
#: What the agreeing words of a piece must say, less what the changed ones would have said, in nats: formulas that differ in their
#: names stay below. Or its shingles reach LEAST_SIMILARITY.
LEAST_SAID = 18.0
#: Of what a word says, the share that one a letter apart says.
VARIANT = 0.75
#: Occurrences that a word's plain frequency counts for when its neighbours are asked.
BACKOFF = 2.0
#: What a changed word at the end of a piece costs, in nats.
CHANGE_COST = 3.0
#: Around a seed, either nearly all words agree or those that do say so much, before the piece is aligned.
NEARLY_ALL, LEAST_SAID_NEAR = 14, 6.0

_ODD, _LOOKS = re.compile(NOT_PLAIN.replace(r"\z", r"\Z")), Skeletons()
_MARKS = re.compile(r"\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-¬=~_⸗‐]+[ \t]*\n?[ \t]*(?:[|/]+ *)?(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
# Old and modern spellings that are written for each other.
SPELLINGS = (
    (r"qu(?=[aou])", "cu"), (r"q", "c"), (r"k", "c"), (r"ç", "z"), (r"c(?=[eiy])", "z"), (r"h", ""), (r"ph", "f"),
    (r"[vb]", "u"), (r"[yj]", "i"), (r"x", "i"), (r"(.)\1+", r"\1"), (r"m(?=[pu])", "n"), (r"^sz", "z"), (r"^s(?=[tp])", "es"),
)
# Abbreviations of the transcriptions.
ABBREVIATIONS = {"q": "que", "d": "de", "dho": "dicho", "dha": "dicha", "dhos": "dichos", "dhas": "dichas", "nro": "nuestro", "nra": "nuestra", "vmd": "merced", "xpo": "cristo", "sr": "señor"}
_SPELLINGS = [(re.compile(a), b) for a, b in SPELLINGS]
_KEYS: dict[str, str] = {}


def word_key(word: str) -> str:
    """One form of a lower-case word for all its spellings."""
    key = _KEYS.get(word)
    if key is None:
        key = ABBREVIATIONS.get(word, word)
        key = "".join(c for c in unicodedata.normalize("NFD", key) if unicodedata.category(c) != "Mn" or c == "̧")
        key = unicodedata.normalize("NFC", key)
        for pattern, by in _SPELLINGS:
            key = pattern.sub(by, key)
        key = key or word
        if len(_KEYS) > MEMORY:
            _KEYS.clear()
        _KEYS[word] = key
    return key


#: Stands between texts that do not follow each other; agrees with nothing.
GAP = "\0"


def words_of(text: str) -> list[str]:
    """Word keys of a text: marks of the transcription left out, broken words joined, look-alike characters unified.

    What is in a mark of LEAST_WORDS words or more comes after the text, apart from it.
    """
    if _ODD.search(text):
        text = _LOOKS.of(text)
    inside: list[str] = []
    if "[" in text or "{" in text or "<" in text:
        inside = [m for m in _MARKS.findall(text) if m.count(" ") + m.count("\n") + 1 >= LEAST_WORDS]
        text = _MARKS.sub(" ", text)
    text = _BROKEN.sub("", text)
    words = [word_key(w) for w in _WORD.findall(text.lower())]
    for mark in inside:
        words += [GAP, *words_of(mark[1:-1])]
    return words


def _vectors(words: list[str]) -> np.ndarray:
    """One row of +1 and -1 per word, from its hash."""
    raw = b"".join(xxhash.xxh3_128_digest(w) for w in words)
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(len(words), 16), axis=1)
    return bits.astype(np.int8) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def _running(rows: np.ndarray, kind: type) -> np.ndarray:
    """Sums of every LEAST_WORDS numbers in sequence of each row."""
    sums = np.cumsum(np.pad(rows, ((0, 0), (1, 0))), axis=1, dtype=kind)
    return sums[:, LEAST_WORDS:] - sums[:, :-LEAST_WORDS]


#: Bits of each block of a fingerprint.
BLOCK_BITS = [BITS // BLOCKS + (b < BITS % BLOCKS) for b in range(BLOCKS)]


def _blocks(packed: np.ndarray) -> list[np.ndarray]:
    """The blocks of packed fingerprints as numbers."""
    bits = np.unpackbits(packed, axis=1)
    out, at = [], 0
    for size in BLOCK_BITS:
        out.append(bits[:, at : at + size] @ (1 << np.arange(size, dtype=np.int64)))
        at += size
    return out


class Passages:
    """Index of the passages: fingerprints of their windows in a multi-index, their words, and the weights of shingles."""

    def __init__(self, rows: list[tuple[int, str]], window: int = WINDOW, stride: int = STRIDE, radius: int = RADIUS) -> None:
        self.window, self.radius = window, radius
        self.words: dict[int, list[str]] = {}
        self._matches: dict[int, ItemWords] = {}
        self._alike: dict[str, tuple[int, ...]] = {}
        owner: list[int] = []
        start: list[int] = []
        prints: list[np.ndarray] = []
        for item, text in rows:
            words = words_of(text)
            if len(words) < window:
                continue
            self.words[item] = words
            sums = self._sums(words)
            places = sorted({*range(0, len(words) - window + 1, stride), len(words) - window})
            prints.append(_pack(sums[places]))
            owner += [item] * len(places)
            start += places
        self.owner, self.start = np.array(owner, dtype=np.int64), np.array(start, dtype=np.int64)
        packed = np.concatenate(prints) if prints else np.zeros((0, 16), dtype=np.uint8)
        self.prints = packed.view(np.uint64).reshape(-1, 2)
        self.tables = []
        most = radius // BLOCKS
        for b, (values, bits) in enumerate(zip(_blocks(packed), BLOCK_BITS, strict=True)):
            flips = [sum(1 << i for i in group) for size in range(most + 1) for group in combinations(range(bits), size)]
            near = (values[:, None] ^ np.array(flips, dtype=np.int64)[None, :]).ravel()
            ids = np.repeat(np.arange(len(values), dtype=np.int32), len(flips))
            order = np.argsort(near, kind="stable")
            bounds = np.searchsorted(near[order], np.arange((1 << bits) + 1)).astype(np.int32)
            self.tables.append((bounds, ids[order]))
        counts = Counter(s for words in self.words.values() for s in set(self._shingles(words)))
        total = max(1, len(self.words))
        self.weights = {s: math.log(1 + total / n) for s, n in counts.items()}
        self.unseen = math.log(1 + total)
        self.ids = {w: i for i, w in enumerate(sorted({w for words in self.words.values() for w in words}), 1)}
        self._index_runs()

    def _index_runs(self) -> None:
        """The passages one after another as word ids, zeros between them, and the places of every SEED words in sequence."""
        apart = [0] * (2 * LEAST_WORDS + DRIFT)
        line, self.begins = list(apart), {}
        for item, words in self.words.items():
            self.begins[item] = len(line)
            line += [*(self.ids[w] for w in words), *apart]
        self.line = np.array(line, dtype=np.int32)
        self.line_items = np.array(list(self.begins), dtype=np.int64)
        self.line_begins = np.array(list(self.begins.values()), dtype=np.int64)
        self.window_places = np.array([self.begins[int(o)] + int(at) for o, at in zip(self.owner, self.start, strict=True)], dtype=np.int64)
        self.known_words = ItemWords(list(self.ids))
        self.many = len(self.ids) + 1
        if self.many**SEED >= 1 << 63:
            raise ValueError("the passages hold too many different words")
        runs = np.lib.stride_tricks.sliding_window_view(self.line, SEED)
        places = np.flatnonzero((runs > 0).all(axis=1))
        keys = self._run_keys(runs[places])
        order = np.argsort(keys, kind="stable")
        self.runs, self.run_places = keys[order], places[order]
        pairs, singles = Counter(p for words in self.words.values() for p in zip(words, words[1:], strict=False)), Counter(w for words in self.words.values() for w in words)
        total = max(1, sum(singles.values()))
        self.alone = {w: -math.log(n / total) for w, n in singles.items()}
        # the place itself is left out of what foretells its word, else every rare word would be foretold by its neighbour
        foretold = lambda n, of, w: -math.log((n - 1 + BACKOFF * singles[w] / total) / (singles[of] - 1 + BACKOFF))
        #: How much a word says where it stands: little if the word before or after it foretells it, as in a formula.
        self.told = {p: foretold(n, p[0], p[1]) for p, n in pairs.items()}, {p: foretold(n, p[1], p[0]) for p, n in pairs.items()}
        self.line_rarity = np.zeros(len(self.line), dtype=np.float32)
        for item, begin in self.begins.items():
            self.line_rarity[begin : begin + len(self.words[item])] = self.rarity(self.words[item])

    def _run_keys(self, runs: np.ndarray) -> np.ndarray:
        keys = np.zeros(len(runs), dtype=np.int64)
        for k in range(SEED):
            keys = keys * self.many + runs[:, k]
        return keys

    def rarity(self, words: list[str]) -> list[float]:
        """What each word of a passage says, beyond what its neighbours foretell."""
        after, before = self.told
        out = []
        for j, w in enumerate(words):
            said = [self.alone[w]]
            if j:
                said.append(after[words[j - 1], w])
            if j + 1 < len(words):
                said.append(before[w, words[j + 1]])
            out.append(min(said))
        return out

    def alike(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the passages' words that each of the words is alike, one after another; how many each has)."""
        known = self._alike
        if len(known) > MEMORY:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = tuple(n + 1 for n in sorted(self.known_words.of(w)))
        found = [known[w] for w in words]
        return np.fromiter(chain.from_iterable(found), dtype=np.int64), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    @staticmethod
    def layers(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same as one row per first, second and further number; -1 where a word has no more."""
        out = np.full((max(1, int(counts.max(initial=1))), len(counts)), -1, dtype=np.int32)
        out[np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts), np.repeat(np.arange(len(counts)), counts)] = flat
        return out

    def runs_shared(self, flat: np.ndarray, counts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, place in the line of passages) where SEED words in sequence are alike.

        index has the number of each word of the text among those that alike() was given.
        """
        first = np.cumsum(counts) - counts
        per_place = counts[index]
        size = len(index) - SEED + 1
        many = np.ones(max(0, size), dtype=np.int64)
        for k in range(SEED):
            many *= per_place[k : k + size]
        at = np.repeat(np.arange(len(many)), many)
        rest = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        keys = np.zeros(len(at), dtype=np.int64)
        for k in range(SEED):
            own = per_place[at + k]
            keys = keys * self.many + flat[first[index[at + k]] + rest % np.maximum(own, 1)]
            rest //= np.maximum(own, 1)
        low = np.searchsorted(self.runs, keys, "left")
        found = np.searchsorted(self.runs, keys, "right") - low
        begin = np.repeat(low - (np.cumsum(found) - found), found)
        a, b = np.repeat(at, found), self.run_places[begin + np.arange(int(found.sum()))]
        return a, b

    def enough(self, a: np.ndarray, b: np.ndarray, layers: np.ndarray) -> np.ndarray:
        """Whether enough of the words around place a of the text and place b of the passages are alike to align them."""
        reach = np.arange(1 - LEAST_WORDS, LEAST_WORDS + SEED - 1)
        good = np.zeros(len(a), dtype=bool)
        padded = np.pad(layers, ((0, 0), (0, 1)), constant_values=-1)
        dense = [v for v in range(len(layers)) if not v or (layers[v] > 0).mean() > 0.2]
        rare = np.any([padded[v] > 0 for v in range(len(layers)) if v not in dense], axis=0) if len(dense) < len(layers) else np.zeros(padded.shape[1], dtype=bool)
        for start in range(0, len(a), CHUNK):
            part = slice(start, start + CHUNK)
            there = a[part][:, None] + reach
            inside = (there >= 0) & (there < layers.shape[1])
            there = np.where(inside, there, layers.shape[1])  # one place more, where nothing is
            own = [padded[v][there] for v in dense]
            cells = np.flatnonzero(rare[there])
            deep = [padded[v][there.ravel()[cells]] for v in range(len(padded)) if v not in dense]
            held = np.zeros(there.shape, dtype=bool)
            agreeing = []
            for shift in range(-DRIFT, DRIFT + 1):
                other = self.line[b[part][:, None] + reach + shift]
                agrees = own[0] == other
                for values in own[1:]:
                    agrees |= values == other
                if len(cells):
                    beside = other.ravel()[cells]
                    agrees.ravel()[cells] |= np.logical_or.reduce([values == beside for values in deep])
                held |= agrees
                agreeing.append(agrees)
            near = _running(held, np.int8)
            some = np.flatnonzero((near >= LEAST_NEAR).any(axis=1))  # only of these it matters what the words say
            told = np.zeros((len(some), len(reach)), dtype=np.float32)
            for shift, agrees in enumerate(agreeing, -DRIFT):
                np.maximum(told, agrees[some] * self.line_rarity[b[part][some, None] + reach + shift], out=told)
            told -= np.where(held[some], 0, self.line_rarity[b[part][some, None] + reach])
            good[start + some] = ((near[some] >= NEARLY_ALL) | (near[some] >= LEAST_NEAR) & (_running(told, np.float32) >= LEAST_SAID_NEAR)).any(axis=1)
        return good

    def matches(self, item: int) -> ItemWords:
        """The passage as the alignment wants it."""
        if item not in self._matches:
            self._matches[item] = ItemWords(self.words[item], self.rarity(self.words[item]), [self.alone[w] for w in self.words[item]])
        return self._matches[item]

    def _sums(self, words: list[str]) -> np.ndarray:
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        rows = _vectors(list(known))[[known[w] for w in words]]
        running = np.zeros((len(words) + 1, BITS), dtype=np.int32)
        np.cumsum(rows, axis=0, out=running[1:])
        return running[self.window :] - running[: -self.window]

    @staticmethod
    def _shingles(words: list[str]) -> list[str]:
        return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]

    def similarity(self, a: list[str], b: list[str]) -> float:
        """Weighted Jaccard similarity of the shingles of two pieces; rare shingles weigh more."""
        left, right = Counter(self._shingles(a)), Counter(self._shingles(b))
        both = either = 0.0
        for s in left.keys() | right.keys():
            weight = self.weights.get(s, self.unseen)
            both += weight * min(left[s], right[s])
            either += weight * max(left[s], right[s])
        return both / either if either else 0.0

    def near(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, passage window) of every pair within the radius."""
        packed = _pack(sums)
        wide = packed.view(np.uint64).reshape(-1, 2)
        left, right = np.ascontiguousarray(wide[:, 0]), np.ascontiguousarray(wide[:, 1])
        own_left, own_right = np.ascontiguousarray(self.prints[:, 0]), np.ascontiguousarray(self.prints[:, 1])
        found_a, found_b = [], []
        for values, (bounds, ids) in zip(_blocks(packed), self.tables, strict=True):
            low = bounds[values]
            count = bounds[values + 1] - low
            total = int(count.sum())
            if not total:
                continue
            at = np.repeat(np.arange(len(count), dtype=np.int32), count)
            first = np.repeat((low - (np.cumsum(count) - count)).astype(np.int32), count)
            other = ids[first + np.arange(total, dtype=np.int32)]
            apart = np.bitwise_count(left[at] ^ own_left[other])
            some = np.flatnonzero(apart <= self.radius)  # one half tells nearly all pairs apart
            at, other, apart = at[some], other[some], apart[some].astype(np.int16)
            apart += np.bitwise_count(right[at] ^ own_right[other])
            hit = apart <= self.radius
            found_a.append(at[hit])
            found_b.append(other[hit])
        if not found_a:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pairs = np.unique(np.concatenate(found_a).astype(np.int64) << 32 | np.concatenate(found_b))
        return pairs >> 32, pairs & 0xFFFFFFFF

    def candidates(self, texts: list[list[str]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(text, item) -> places (word of the text, word of the item) of windows within the radius."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        if not len(self.owner):
            return found
        batch: list[int] = []
        size = 0
        for i, words in enumerate(texts):
            if len(words) >= self.window:
                batch.append(i)
                size += len(words)
            if size >= CHUNK or (i == len(texts) - 1 and batch):
                self._candidates(batch, texts, found)
                batch, size = [], 0
        return found

    def _candidates(self, batch: list[int], texts: list[list[str]], found: dict) -> None:
        known: dict[str, int] = {}
        rows = [known.setdefault(w, len(known)) for i in batch for w in texts[i]]
        vectors = _vectors(list(known))
        index = np.array(rows)
        words = list(known)
        lengths = np.array([len(texts[i]) for i in batch])
        ends = np.cumsum(lengths)
        overlap = 2 * LEAST_WORDS
        for begin in range(0, len(index), CHUNK):  # one very long text is taken in overlapping parts
            low, high = max(0, begin - overlap), min(len(index), begin + CHUNK + overlap)
            if high - low < self.window:
                break
            here, place = np.unique(index[low:high], return_inverse=True)
            running = np.zeros((high - low + 1, BITS), dtype=np.int32)
            np.cumsum(vectors[index[low:high]], axis=0, out=running[1:])
            a, w = self.near(running[self.window :] - running[: -self.window])
            flat, counts = self.alike([words[k] for k in here])
            c, d = self.runs_shared(flat, counts, place)
            pairs = np.unique(np.concatenate([a << 32 | self.window_places[w], c << 32 | d]))
            pairs = pairs[~np.isin(pairs, pairs + ((1 << 32) + 1))]  # of hits that follow each other only the first
            a, b = pairs >> 32, pairs & 0xFFFFFFFF
            good = self.enough(a, b, self.layers(flat, counts)[:, place])
            a, b = a[good] + low, b[good]
            t, o = np.searchsorted(ends, a, "right"), np.searchsorted(self.line_begins, b, "right") - 1
            for p, text, item, q in zip(a, t, o, b, strict=True):
                found[batch[int(text)], int(self.line_items[item])].append((int(p - ends[text] + lengths[text]), int(q - self.line_begins[item])))

    def align_many(self, pieces: list[tuple[list[str], int]]) -> list[tuple[int, int, int, int, int]]:
        """Best local alignment (text start, text end, item start, item end, words that agree) of each text with its item."""
        out: list[tuple[int, int, int, int, int]] = [(0, 0, 0, 0, 0)] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k][0]))  # texts of about one length at a time
        for begin in range(0, len(order), ALIGNED):
            some = order[begin : begin + ALIGNED]
            for k, found in zip(some, self._align([pieces[k] for k in some]), strict=True):
                out[k] = found
        return out

    def _align(self, pieces: list[tuple[list[str], int]]) -> list[tuple[int, int, int, int, int]]:
        high, wide, many = max(len(t) for t, _ in pieces), max(len(self.words[i]) for _, i in pieces), len(pieces)
        agrees = np.zeros((high, many, wide), dtype=bool)
        for k, (text, item) in enumerate(pieces):
            own = self.layers(*self.alike(text))
            at = self.begins[item]
            agrees[: len(text), k, : len(self.words[item])] = (own[:, :, None] == self.line[at : at + len(self.words[item])]).any(axis=0)
        scores = np.zeros((high + 1, many, wide + 1), dtype=np.float32)
        slope = np.arange(wide, dtype=np.float32) * PENALTY
        for i in range(high):
            row = scores[i, :, :-1] + np.where(agrees[i], np.float32(1), np.float32(-PENALTY))
            np.maximum(row, scores[i, :, 1:] - np.float32(PENALTY), out=row)
            np.maximum(row, 0, out=row)
            scores[i + 1, :, 1:] = np.maximum.accumulate(row + slope, axis=1) - slope
        flat = scores.transpose(1, 0, 2).reshape(many, -1).argmax(axis=1)
        i, j = flat // (wide + 1), flat % (wide + 1)
        last_i, last_j, hits, rows = i.copy(), j.copy(), np.zeros(many, dtype=np.int64), np.arange(many)
        while (open_ := scores[i, rows, j] > 0).any():  # back to where each begins, all in step
            now, beside = scores[i, rows, j], scores[i - 1, rows, j - 1]
            same = open_ & agrees[i - 1, rows, j - 1] & (now == beside + 1)
            across = same | open_ & ~agrees[i - 1, rows, j - 1] & (now == beside - PENALTY)
            up = open_ & ~across & (now == scores[i - 1, rows, j] - PENALTY)
            hits += same
            i, j = i - (across | up), j - (across | open_ & ~up & ~across)
        return [tuple(int(x) for x in one) for one in zip(i, last_i, j, last_j, hits, strict=True)]


def _alike(a: str, b: str) -> bool:
    """Words that agree, or differ in one letter."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def _shortened(word: str) -> list[str]:
    """The word, and with each of its letters left out; words that differ in one letter share one of these."""
    return [word, *(word[:k] + word[k + 1 :] for k in range(len(word)))] if len(word) >= 4 else [word]


class ItemWords:
    """Places in a passage of the words that agree with a given one, and what each of its words says, where it stands and alone."""

    def __init__(self, item: list[str], rarity: list[float] | None = None, alone: list[float] | None = None) -> None:
        self.item = item
        self.rarity, self.alone = rarity or [1.0] * len(item), alone or [1.0] * len(item)
        self.places: dict[str, list[int]] = defaultdict(list)
        for j, word in enumerate(item):
            for form in set(_shortened(word)):
                self.places[form].append(j)
        self.known: dict[str, frozenset[int]] = {}

    def of(self, word: str) -> frozenset[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            near = {j for form in _shortened(word) for j in self.places.get(form, ())}
            found = self.known[word] = frozenset(j for j in near if _alike(word, self.item[j]))
        return found


def extended(text: list[str], item: ItemWords, piece: tuple[int, int, int, int, int]) -> tuple[int, int, int, int, int]:
    """The piece that was aligned, whose ends are taken on past changed words, to a word that agrees.

    What the agreeing words of such an end say must outweigh its changed words, and the whole must keep to LEAST_AGREEMENT.
    """
    a, b, c, d, agree = piece
    for step in (-1, 1):
        i, j = (a - 1, c - 1) if step < 0 else (b, d)
        size, further, gain, best = max(d - c, b - a), 0, 0.0, (0, 0)
        for n in range(1, LEAST_WORDS + 1):
            if not (0 <= i < len(text) and 0 <= j < len(item.item)):
                break
            if j in item.of(text[i]):
                further, gain = further + 1, gain + item.alone[j]
                if gain > 0 and agree + further >= LEAST_AGREEMENT * (size + n):
                    best = (n, further)
            else:
                gain -= CHANGE_COST
            i, j = i + step, j + step
        n, further = best
        agree += further
        a, b, c, d = (a - n, b, c - n, d) if step < 0 else (a, b + n, c, d + n)
    return a, b, c, d, agree


def said(text: list[str], item: ItemWords, begin: int, end: int) -> float:
    """What the words of item[begin:end] that agree with the text, in order, say, less what the others would have said."""
    best = [0.0] * (end - begin + 1)
    for word in text:
        agree, before, beside = item.of(word), 0.0, 0.0
        for k in range(1, end - begin + 1):
            above = best[k]
            j = begin + k - 1
            value = before + item.rarity[j] * (1.0 if word == item.item[j] else VARIANT) if j in agree else 0.0
            beside = best[k] = max(above, beside, value)
            before = above
    return 2 * best[-1] - sum(item.rarity[begin:end])


def _as_item(text: list[str], item: ItemWords, begin: int, end: int) -> list[str]:
    """The text with words one letter apart from a word of item[begin:end] written as there."""
    own = set(item.item[begin:end])
    out = []
    for i, word in enumerate(text):
        near = () if word in own else [j for j in item.of(word) if begin <= j < end]
        out.append(item.item[min(near, key=lambda j: (abs(j - begin - i), j))] if near else word)
    return out


def verify(texts: list[list[str]], places: dict[tuple[int, int], list[tuple[int, int]]], passages: Passages, slack: int = 25) -> dict[tuple[int, int], tuple[int, float]]:
    """(text, item) -> (words of the item in the piece, similarity) where the text holds the item, or enough of it in one piece."""
    best: dict[tuple[int, int], tuple[int, float]] = {}
    work: list[tuple[int, int, int, int]] = []
    for (t, item), found in places.items():
        done: list[tuple[int, int]] = []
        for at, start in sorted(found):
            if not any(a <= at and at + SEED <= b for a, b in done):
                done.append((max(0, at - start - slack), min(len(texts[t]), at - start + len(passages.words[item]) + slack)))
        work += [(t, item, *part) for part in done]
    while work:
        needed = [min(LEAST_WORDS, len(passages.words[item])) for _, item, _, _ in work]
        work = [w for w, n in zip(work, needed, strict=True) if w[3] - w[2] >= n and any(w[2] <= p and p + SEED <= w[3] for p, _ in places[w[0], w[1]])]
        rest: list[tuple[int, int, int, int]] = []
        for (t, item, low, high), core in zip(work, passages.align_many([(texts[t][low:high], item) for t, item, low, high in work]), strict=True):
            if core[4] < SEED:
                continue
            part, own = texts[t][low:high], passages.matches(item)
            for a, b, c, d, agree in dict.fromkeys((extended(part, own, core), core)):
                span = d - c
                if span < min(LEAST_WORDS, len(own.item)) or agree < LEAST_AGREEMENT * max(span, b - a):
                    continue
                close = passages.similarity(_as_item(part[a:b], own, c, d), own.item[c:d])
                if close >= LEAST_SIMILARITY or said(part[a:b], own, c, d) >= LEAST_SAID:
                    if span > best.get((t, item), (0, 0.0))[0]:
                        best[t, item] = (span, close)
                    break
            else:  # the best piece is none: another may stand beside it
                rest += [(t, item, low, low + core[0]), (t, item, low + core[1], high)]
        work = rest
    return best


def read_passages(passages: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The passages with text in blocks of about BLOCK_WORDS words, in the order of their ids; one block at a time is read."""
    rows = passages.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    block: list[tuple[int, str]] = []
    size = 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        block.append((r.item, r.text))
        size += r.text.count(" ") + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_passages(documents: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, doc_id, words, similarity): documents that hold a passage whole, or LEAST_WORDS of its words in one piece.

    Null and empty texts hold none; passages shorter than a window are looked for in no document. Documents that repeat are
    found each. Whole texts are read, however long; extra columns are ignored.
    """
    kind = dict(documents.dtypes)[key]
    schema = f"item_id bigint, {key} {kind}, words int, similarity double"
    with_text = busy(documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text))
    out = None
    for block in read_passages(passages):
        shared = documents.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_WORDS

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Passages(shared.value)
            for batch in batches:
                keys = list(batch[key])
                same: dict[str, list[int]] = {}  # copies are searched once
                for i, t in enumerate(batch[text]):
                    same.setdefault(t, []).append(i)
                texts, places = [words_of(t) for t in same], list(same.values())
                found = verify(texts, index.candidates(texts), index)
                rows = [(item, keys[i], words, close) for (k, item), (words, close) in found.items() for i in places[k]]
                yield pd.DataFrame(rows, columns=["item_id", key, "words", "similarity"])

        one = with_text.mapInPandas(search, schema)
        out = one if out is None else out.unionByName(one)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out
