"""Problem 2: one form for texts that look the same though their characters differ.

The form is a skeleton: decompose, replace every character by its prototype, decompose again. Skeletons come out
composed (NFC), so a text of plain characters is its own skeleton and never leaves the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that print like a Latin letter, and that letter below it.
CYRILLIC = "АВЕЅІЈКМНОРСТУХԌԚԜҮаеѕіјорсухһԁԛԝҽӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXGQWYaesijopcyxhdqwel"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳορνι"
GREEK_AS = "ABEZHIKMNOPTYXCjopvi"
ARMENIAN = "ՍՕԼօհոսցԁյ"
ARMENIAN_AS = "UOLohnugdj"
LATIN = "ɡɑıȷᴄᴏᴜᴠᴡᴢℊℯℴ"
LATIN_AS = "gaijcouvwzgeo"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏆᏒᏔᏙᏚᏞᏟᏢᏦ"
CHEROKEE_AS = "DRTAJEWMHGZTRWVSLCPK"
SIGNS = "\u2010\u2011\u2043\ua78f\u2027\u30fb\u2219\u22c5\u02b9\u02bc\u201a"
SIGNS_AS = "---\u00b7\u00b7\u00b7\u00b7\u00b7'',"
#: Characters that print as nothing at all.
UNSEEN = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)
#: Spaces of any width count as a space; so do the no-break ones.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Decompositions of these kinds change how a character is stored, not what a reader sees.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")
#: Of <compat>, these print otherwise than what they decompose to.
OTHER_LOOK = "ſ…‥"

#: What makes a text other than its own skeleton: a character beyond these, or a blank at a line's end.
NOT_PLAIN = r"[^\n -~¡«»¿–—ªº·¬ÁÉÍÓÚÜÑÇÀÈÒÏÂÊÔÃÕáéíóúüñçàèòïâêôãõ]| (?=\n)| \z"


def prototypes() -> dict[str, str]:
    """The look-alike table: fixed letters, unseen characters, spaces."""
    found: dict[str, str] = {}
    for chars, latin in (
        (CYRILLIC, CYRILLIC_AS),
        (GREEK, GREEK_AS),
        (ARMENIAN, ARMENIAN_AS),
        (LATIN, LATIN_AS),
        (CHEROKEE, CHEROKEE_AS),
        (SIGNS, SIGNS_AS),
    ):
        if len(chars) != len(latin):
            raise ValueError(f"{chars} has {len(chars)} characters, {latin} {len(latin)}")
        found.update(zip(chars, latin, strict=True))
    found.update(dict.fromkeys(UNSEEN, ""))
    found.update(dict.fromkeys(SPACES, " "))
    return found


class Skeletons:
    """Skeletons of texts; the table fills itself as characters come up."""

    def __init__(self) -> None:
        self.fixed = prototypes()
        self.table: dict[int, str] = {}

    def _learn(self, code: int) -> str:
        char = chr(code)
        out = self.fixed.get(char)
        if out is None:
            rule = unicodedata.decomposition(char)
            out = char
            if rule.startswith(SAME_LOOK) and char not in OTHER_LOOK:
                out = unicodedata.normalize("NFKD", char)
                out = "".join(self.fixed.get(x, x) for x in out)
            elif rule and not rule.startswith("<"):
                out = unicodedata.normalize("NFD", char)
            elif "VARIATION SELECTOR" in unicodedata.name(char, ""):
                out = ""
        self.table[code] = out
        return out

    def of(self, text: str) -> str:
        text = re.sub("\u00ad+(?=[ \t\r]*(?:\n|$))", "-", text.replace("\r\n", "\n"))
        text = unicodedata.normalize("NFD", text)
        table = self.table
        for char in set(text):
            if ord(char) not in table:
                self._learn(ord(char))
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(table)))
        return re.sub(r" +(?=\n|$)", "", text)


@F.pandas_udf(T.StringType())
def _skeleton(texts: pd.Series) -> pd.Series:
    make = Skeletons()
    return texts.map(make.of, na_action="ignore")


def skeleton(text: Column) -> Column:
    """One form of a text: equal for texts that look alike, different for those that do not.

    Null stays null, the empty text stays empty. Blanks at a line's end are not seen and go; an unseen hyphen at a line's end
    is seen there and stays as a hyphen. Only texts with other than plain characters are sent to Python.
    """
    odd = text.rlike(NOT_PLAIN)
    return F.when(odd, _skeleton(F.when(odd, text))).otherwise(text)


def fingerprint(*columns: Column | str) -> tuple[Column, Column]:
    """128 bits of a value as two numbers; chance equality is out of reach for any corpus."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns, F.lit(0))


def same_look_classes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Per row its class of equal skeletons: (key, class_hi, class_lo, changed); rows with null or empty text have none."""
    rows = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text)
    rows = rows.withColumn("skeleton", skeleton(F.col(text)))
    high, low = fingerprint("skeleton")
    return rows.select(key, high.alias("class_hi"), low.alias("class_lo"), (F.col("skeleton") != F.col(text)).alias("changed"))


def _keyed(rows: DataFrame, key: str, text: str) -> DataFrame:
    rows = rows.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col("page_id").isNotNull())
    rows = rows.select(F.col(key), F.col("page_id"), F.col(text).alias("text"))
    rows = rows.withColumn("skeleton", skeleton(F.col("text")))
    high, low = fingerprint("page_id", "skeleton")
    own, other = fingerprint("text")
    return rows.select(key, high.alias("hi"), low.alias("lo"), own.alias(f"{key}_own"), other.alias(f"{key}_other"))


def same_look_pairs(gt: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Pairs (gt_id, hyp_id) on one page whose texts differ although their skeletons are equal.

    Only 128-bit fingerprints are shuffled. A page that holds a third of all rows spreads over as many keys as it has different
    skeletons, and the skew join of adaptive execution splits a single hot one. Null and empty texts and null pages give no pair.
    """
    a, b = _keyed(gt, "gt_id", "gt_text"), _keyed(hypotheses, "hyp_id", "hyp_text")
    differ = (F.col("gt_id_own") != F.col("hyp_id_own")) | (F.col("gt_id_other") != F.col("hyp_id_other"))
    return a.join(b, ["hi", "lo"]).where(differ).select("gt_id", "hyp_id").distinct()
