"""Problem 8: template residue, filler, error messages and notices about scripts or cookies.

A perceptron is fitted on labelled examples, spliced into sentences of the corpus at hand, and on sentences of the corpus
itself. It gives words and pairs of words weights, and a text is a message where a run of words weighs enough. Sentences are trimmed to the part
that can weigh anything, so that a message inside a sentence comes out like one that stands alone. These parts go through a prefix tree of fixed
depth: by number of tokens, then by the first tokens, then by similarity to the templates of the leaf. Each batch mines its own, the templates
of all batches are merged by the same tree, each merged template is judged once, and its verdict goes back to the documents.
Unfilled fields inside ordinary text are found separately, in the JVM.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escriba.llm.examples import GENUINE, MESSAGES
from escriba.llm.lookalikes import NOT_PLAIN, Skeletons
from escriba.llm.shared import cut
from escriba.operators.pairs import busy

#: Tokens that lead from the root of the prefix tree to a leaf, after the number of tokens.
TREE_DEPTH = 3
#: Share of equal tokens at which a segment joins a template.
DEFAULT_SIMILARITY = 0.5
#: Documents whose sentences the model learns ordinary text from, at most; drawn by a hash of the text.
TRAIN_DOCUMENTS = 1000
#: Parts into which the templates of a leaf are split before they are merged as a whole.
SALTS = 32
#: Score above zero that messages must keep in training, and below zero that ordinary text must.
MARGIN, ORDINARY_MARGIN = 1.0, 0.8
#: Score from which a run is a message, between what the two margins ask for.
THRESHOLD = 0.25
#: Times that each message is spliced into ordinary sentences, and how many salads of filler words are made.
SPLICES, SALADS = 3, 40

# Notations of an unfilled field; a field name is an identifier.
_NAME = r"\p{L}[\p{L}\p{N}_.\-]*"
SLOTS = (
    r"\{\{\s*" + _NAME + r"\s*\}\}",
    r"\{%-?\s*" + _NAME + r"[^{}%]*%\}",
    r"<%[=\-]?\s*" + _NAME + r"[^<>%]*%>",
    r"\$\{\s*" + _NAME + r"\s*\}",
    r"(?<![\w{])\{" + r"\p{L}[\p{L}\p{N}_]+" + r"\}(?!\})",
    r"%\(" + _NAME + r"\)[sdfr]",
    r"##\s*" + _NAME + r"\s*##",
    r"@@\s*" + _NAME + r"\s*@@",
    r"\[\[\s*" + _NAME + r"\s*\]\]",
    r"(?<![\w_])__\p{L}\w*?__(?![\w_])",
    r"(?iu)\[\s*(?:insertar|inserte|insert|inserir|inserir aqui|completar|rellenar|fill in|enter)\s+[^\[\]:]+\]",
    r"(?iu)\[\s*[\p{L}_][\p{L}\p{N}_ ]*?\s(?:aquí|aqui|here|aquí va)\s*\]",
    r"(?iu)<\s*(?:insertar|insert|inserir)\s+[^<>]+>",
)

_SPLIT = re.compile(r"(?<=[.!?…])\s+|[\n\r]+|</?\w+[^<>]*>|\*{2,}")
_ODD, _LOOKS = re.compile(NOT_PLAIN.replace(r"\z", r"\Z")), Skeletons()
_TOKEN = re.compile(r"[^\W_]+")
_CODE = re.compile(r"(?=[0-9a-f]*[0-9])[0-9a-f]+\Z")
_ACCENTS = re.compile("[̀-ͯ]+")
KINDS = ("notice", "error", "filler")


def flat(text: str) -> str:
    """Lower case, without accents, look-alike characters unified."""
    if not text.isascii():
        if _ODD.search(text):
            text = _LOOKS.of(text)
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    return text.lower()


def _token(word: str) -> str:
    if word.isalpha():
        return "=" if len(word) > 2 and word.count(word[0]) == len(word) else word
    return "#" if _CODE.match(word) else word


def tokens(part: str) -> list[str]:
    """Words of a flat text; numbers and codes are '#', runs of one letter '='."""
    return [_token(w) for w in _TOKEN.findall(part)]


def segments(text: str) -> Iterator[list[str]]:
    """The different sentences and lines of a text as tokens."""
    seen = set()
    for part in _SPLIT.split(flat(text)):
        if part and part not in seen:
            seen.add(part)
            found = tokens(part)
            if found:
                yield found


class MessageModel:
    """Weights of words and of pairs of neighbours per kind of residue; the run of words that weighs most decides.

    Learning: where a labelled message weighs less than the margin, its features gain; where the heaviest run of an ordinary
    text weighs more than the negative margin, its features lose. Weights are averaged over all steps.
    """

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {k: {} for k in KINDS}
        self.bias = dict.fromkeys(KINDS, -MARGIN)

    def best_run(self, words: list[str], kind: str) -> tuple[float, int, int]:
        """(score, start, end) of the heaviest run of words."""
        weights, base = self.weights[kind], self.bias[kind]
        best, run, begin = (base, 0, 0), 0.0, 0
        before = ""
        for i, word in enumerate(words):
            single = weights.get(word, 0.0)
            if run + (pair := weights.get(f"{before} {word}", 0.0)) > 0:
                run += single + pair
            else:
                run, begin = single, i
            if run + base > best[0]:
                best = (run + base, begin, i + 1)
            before = word
        return best

    def run_score(self, words: list[str], kind: str) -> float:
        weights = self.weights[kind]
        return self.bias[kind] + sum(weights.get(f, 0.0) for f in self.features(words))

    @staticmethod
    def features(words: list[str]) -> list[str]:
        return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]

    def verdict(self, words: list[str]) -> str | None:
        """The kind of the heaviest run, or None where no run weighs enough."""
        score, kind = max((self.best_run(words, k)[0], k) for k in KINDS)
        return kind if score > THRESHOLD else None

    def fit(self, messages: list[tuple[str, list[str]]], ordinary: list[list[str]], contexts: list[list[str]], rounds: int = 20, seed: int = 8) -> MessageModel:
        """Learn from labelled messages, alone and spliced into contexts, and from ordinary text."""
        rng = random.Random(seed)
        examples: list[tuple[str, list[str], list[str]]] = []
        for kind, words in messages:
            examples.append((kind, words, words))
            for _ in range(SPLICES if contexts else 0):
                around = rng.choice(contexts)
                at = rng.randint(0, len(around))
                examples.append((kind, words, around[:at] + words + around[at:]))
        examples += [("", [], words) for words in ordinary]
        sums = {k: {} for k in KINDS}
        bias_sums = dict.fromkeys(KINDS, 0.0)
        step = 0

        def move(kind: str, features: list[str], by: float) -> None:
            weights, total = self.weights[kind], sums[kind]
            for f in features:
                weights[f] = weights.get(f, 0.0) + by
                total[f] = total.get(f, 0.0) + by * step
            self.bias[kind] += by / 4
            bias_sums[kind] += by / 4 * step

        for _ in range(rounds):
            rng.shuffle(examples)
            wrong = 0
            for kind, words, whole in examples:
                step += 1
                if kind and self.run_score(words, kind) < MARGIN:
                    wrong += 1
                    move(kind, self.features(words), 2 / (len(words) + 2))
                for other in KINDS:
                    if other == kind:
                        continue
                    score, begin, end = self.best_run(whole, other)
                    if end > begin and score > -ORDINARY_MARGIN and (not kind or score > self.run_score(words, kind) - MARGIN):
                        wrong += 1
                        move(other, self.features(whole[begin:end]), -2 / (end - begin + 2))
            if not wrong:
                break
        step = max(1, step)
        for kind in KINDS:
            averaged = {f: w - sums[kind][f] / step for f, w in self.weights[kind].items()}
            self.weights[kind] = {f: w for f, w in averaged.items() if abs(w) > 0.02}
            self.bias[kind] -= bias_sums[kind] / step
        return self

    def gains(self) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
        """What a word, and a word after another, adds to a run at most, whatever the kind; only what adds something."""
        singles: dict[str, float] = {}
        pairs: dict[str, dict[str, float]] = {}
        for weights in self.weights.values():
            for f, v in weights.items():
                if v > 0:
                    a, _, b = f.partition(" ")
                    into, key = (pairs.setdefault(b, {}), a) if b else (singles, a)
                    into[key] = max(v, into.get(key, 0.0))
        return singles, pairs

    def weighed(self) -> set[str]:
        """Words that have any weight, alone or in a pair."""
        return {w for weights in self.weights.values() for f in weights for w in f.split(" ")}


def labelled() -> tuple[list[tuple[str, list[str]]], list[list[str]]]:
    """The labelled examples as tokens: messages by kind, and genuine text that speaks of such things.

    Messages that begin with a code come with and without it, and under each of the words that announce one; the longest filler also in other orders.
    """
    examples = [(k, tokens(flat(x))) for k, lines in MESSAGES.items() for x in lines]
    heads = [[], ["#"], *sorted({(w[0], "#") for k, w in examples if k == "error" and w[1:2] == ["#"] and len(w) > 3})]
    varied = []
    for kind, words in examples:
        if kind == "error" and "#" in words[:2] and len(rest := words[words.index("#") + 1 :]) > 1:
            varied += [(kind, [*head, *rest]) for head in heads]
    rng = random.Random(6)
    longest = max((w for k, w in examples if k == "filler"), key=len)
    varied += [("filler", rng.sample(longest, rng.randint(6, len(longest)))) for _ in range(SALADS)]
    different = dict.fromkeys((k, tuple(w)) for k, w in examples + varied)
    return [(k, list(w)) for k, w in different], [tokens(flat(x)) for x in GENUINE]


def trained_on(texts: list[str], messages: list[tuple[str, list[str]]] | None = None) -> MessageModel:
    """The model, fitted on the labelled examples and on ordinary sentences of the texts.

    A sentence of the corpus counts as ordinary unless a first model, fitted without the corpus, finds a message in it.
    """
    known, genuine = labelled()
    known = messages or known
    first = MessageModel().fit(known, genuine, [])
    ordinary = []
    for text in texts:
        ordinary += [s for s in segments(text) if first.verdict(s) is None]
    return MessageModel().fit(known, genuine * 4 + ordinary, ordinary or genuine)


def trained(documents: DataFrame, text: str = "text", limit: int = TRAIN_DOCUMENTS) -> MessageModel:
    """The model, fitted with the ordinary text of up to ``limit`` documents, drawn by a hash of the text."""
    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(text).alias("text"))
    drawn = rows.withColumn("draw", F.xxhash64("text")).orderBy("draw", "text").limit(limit).collect()
    return trained_on([r.text for r in drawn])


class PrefixTree:
    """Templates of token sequences; '*' in a template stands for any token. Tokens that the model gives a weight stay as they
    are, hence a template and all that it holds weigh the same."""

    def __init__(self, weighed: set[str], similarity: float = DEFAULT_SIMILARITY, depth: int = TREE_DEPTH) -> None:
        self.weighed, self.similarity, self.depth = weighed, similarity, depth
        self.leaves: dict[tuple[str, ...], dict[tuple[str, ...], list[list[str]]]] = {}

    def leaf(self, words: list[str]) -> tuple[str, ...]:
        return (str(len(words)), *words[: self.depth])

    def add(self, words: list[str]) -> list[str]:
        """The template that the tokens belong to, generalised to hold them."""
        weighed = self.weighed
        fixed = tuple(w if w in weighed else "*" for w in words)
        group = self.leaves.setdefault(self.leaf(words), {}).setdefault(fixed, [])
        best, at = 0, None
        for template in group:
            same = sum(a == b for a, b in zip(template, words, strict=True))
            if same > best:
                best, at = same, template
        if at is None or best < self.similarity * len(words):
            group.append(list(words))
            return group[-1]
        if best < len(words):
            for i, (a, b) in enumerate(zip(at, words, strict=True)):
                if a != b:
                    at[i] = "*"
        return at


class Miner:
    """Trims the sentences of texts to what can weigh anything and mines them for templates."""

    def __init__(self, model: MessageModel, similarity: float = DEFAULT_SIMILARITY) -> None:
        self.singles, self.pairs = model.gains()
        self.least = THRESHOLD - max(model.bias.values())
        self.tree = PrefixTree(model.weighed(), similarity)

    def trimmed(self, words: list[str]) -> list[str]:
        """From the first to the last token that adds weight, beyond which no heaviest run reaches; nothing if all that add weight
        together can't make a message."""
        singles, pairs = self.singles, self.pairs
        begin, end, weight, before = -1, 0, 0.0, ""
        for i, word in enumerate(words):
            gain, first = singles.get(word, 0.0), i
            after = pairs.get(word)
            if after is not None and before in after:
                gain, first = gain + after[before], i - 1
            if gain:
                weight += gain
                end = i + 1
                if begin < 0:
                    begin = first
            before = word
        return words[begin:end] if weight > self.least else []

    def add(self, text: str) -> list[list[str]]:
        out = []
        for words in segments(text):
            part = self.trimmed(words)
            if part:
                out.append(self.tree.add(part))
        return out


def _number(template: str) -> int:
    return xxhash.xxh3_64_intdigest(template) - (1 << 63)


def unresolved_slots(text: Column) -> Column:
    """True where a text holds an unfilled field of a software template."""
    signs = F.lit(False)
    for sign in ("{", "<", "%(", "##", "@@", "[", "__"):  # cheap to look for, and every notation has one
        signs = signs | F.contains(text, F.lit(sign))
    return F.coalesce(signs & text.rlike("|".join(f"(?:{s})" for s in SLOTS)), F.lit(False))


def mined(documents: DataFrame, model: MessageModel, key: str = "doc_id", text: str = "text", similarity: float = DEFAULT_SIMILARITY) -> DataFrame:
    """(key, found, leaf, template): per document the numbers of its templates; and per batch its templates, where the key is null
    and found has the documents of the template and its number.

    Written to the shared folder once, since both kinds of rows are read.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # weights of a bounded sample

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        for batch in batches:
            miner = Miner(known, similarity)
            held = [(k, miner.add(t)) for k, t in zip(batch[key], batch[text], strict=True)]
            names = {id(t): " ".join(t) for _, found in held for t in found}  # after the whole batch, so that all of it has one form
            rows = [(k, sorted({_number(names[id(t)]) for t in found}), None, None) for k, found in held if found]
            counted: dict[str, int] = {}
            for _, found in held:
                for name in {names[id(t)] for t in found}:
                    counted[name] = counted.get(name, 0) + 1
            rows += [(None, [n, _number(name)], " ".join(miner.tree.leaf(name.split(" "))), name) for name, n in counted.items()]
            out = pd.DataFrame(rows, columns=[key, "found", "leaf", "template"])
            out[key] = out[key].astype(object)
            yield out

    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text)
    kind = dict(rows.dtypes)[key]
    return cut(busy(rows).mapInPandas(mine, f"{key} {kind}, found array<bigint>, leaf string, template string"))


def templates(parts: DataFrame, model: MessageModel, key: str = "doc_id", similarity: float = DEFAULT_SIMILARITY) -> DataFrame:
    """(local, template, kind, documents): the batches' templates merged leaf by leaf, each merged template judged once.

    Equal templates are counted first; then each leaf is merged in SALTS parts, then as a whole, so that no task sees all
    templates of a leaf that fills the corpus.
    """
    shipped = parts.sparkSession.sparkContext.broadcast(model)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by part; a part's templates, frequent ones first, go through a tree of their own."""
        weighed = shipped.value.weighed()
        part, tree, held = None, PrefixTree(weighed, similarity), []

        def merged() -> list[tuple]:
            joined: dict[int, tuple[list[str], list[int], list[int]]] = {}
            for template, local, documents in held:
                one = joined.setdefault(id(template), (template, [], [0]))
                one[1].extend(local)
                one[2][0] += documents
            return [(part[0], " ".join(t), sorted(set(local)), n[0]) for t, local, n in joined.values()]

        for batch in batches:
            out = []
            for leaf, salt, template, local, documents in zip(batch["leaf"], batch["salt"], batch["template"], batch["local"], batch["documents"], strict=True):
                if part != (leaf, salt):
                    out += merged()
                    part, tree, held = (leaf, salt), PrefixTree(weighed, similarity), []
                held.append((tree.add(template.split(" ")), local, int(documents)))
            yield pd.DataFrame(out, columns=["leaf", "template", "local", "documents"])
        yield pd.DataFrame(merged(), columns=["leaf", "template", "local", "documents"])

    def merged_by(rows: DataFrame, salt: Column) -> DataFrame:
        rows = rows.withColumn("salt", salt).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", F.desc("documents"), "template")
        return rows.mapInPandas(merge, "leaf string, template string, local array<bigint>, documents bigint")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(kind=[shipped.value.verdict(t.split(" ")) for t in batch["template"]])[["local", "template", "kind", "documents"]].astype({"kind": object})

    found = F.col("found")
    counted = parts.where("template IS NOT NULL").groupBy("leaf", "template").agg(F.sum(found[0]).alias("documents"), F.array(F.min(found[1])).alias("local"))
    whole = merged_by(merged_by(counted, F.pmod(F.xxhash64("template"), F.lit(SALTS))), F.lit(0).cast("long"))
    return whole.mapInPandas(judge, "local array<bigint>, template string, kind string, documents bigint")


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind): documents with an unfilled field ("slot"), filler, an error message or a notice, one row per kind.

    Null and empty texts are never found. Repeated rows are cases of their own; extra columns are ignored. Whole texts are read.
    """
    model = trained(documents, text)
    parts = mined(documents, model, key, text)
    verdicts = templates(parts, model, key).where("kind IS NOT NULL").select(F.explode("local").alias("number"), "kind").distinct()
    held = parts.where(F.col(key).isNotNull()).select(key, F.explode("found").alias("number"))
    slots = documents.where(unresolved_slots(F.col(text))).select(key, F.lit("slot").alias("kind"))
    return held.join(verdicts, "number").select(key, "kind").unionByName(slots).distinct()
