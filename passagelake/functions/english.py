"""English analysis of text: stop words out, words stemmed by the public Porter2 rules."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual English stop words (fixed values).
STOP_WORDS = frozenset("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the
and but if or because as until while of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same
so than too very s t can will just don should now
""".split())

#: Words with stems of their own, and words that stay (fixed values).
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())

#: Suffixes and what takes their place, the longest first where one ends in another (fixed values).
STEP_2 = [
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    special = re.match("gener|commun|arsen", word)
    if special:
        r1 = special.end()
    else:
        found = _REGION.search(word)
        r1 = found.end() if found else len(word)
    found = _REGION.search(word, r1)
    return r1, found.end() if found else len(word)


def _past_and_present(word: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    for suffix in ("ingly", "edly", "ing", "ed"):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if not _VOWEL.search(base):
                return word
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if base.endswith(_DOUBLE):
                return base[:-1]
            return base + "e" if r1 >= len(base) and _SHORT_END.search(base) else base
    return word


def _replaced(word: str, pairs: list[tuple[str, str]], r1: int) -> str | None:
    """The word with its longest listed suffix replaced if that is in R1; None if no suffix is there."""
    for suffix, new in pairs:
        if word.endswith(suffix):
            return word[: -len(suffix)] + new if len(word) - len(suffix) >= r1 else word
    return None


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in INVARIANT:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word
    word = _past_and_present(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    new = _replaced(word, STEP_2, r1)
    if new is not None:
        word = new
    elif word.endswith("ogi") and word.endswith("logi") and len(word) - 3 >= r1:
        word = word[:-1]
    elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple("cdeghkmnrt"):
        word = word[:-2]

    new = _replaced(word, STEP_3, r1)
    if new is not None:
        word = new
    elif word.endswith("ative") and len(word) - 5 >= r2:
        word = word[:-5]

    for suffix in STEP_4:
        if word.endswith(suffix):
            word = word[: -len(suffix)] if len(word) - len(suffix) >= r2 else word
            break
    else:
        if word.endswith(("sion", "tion")) and len(word) - 3 >= r2:
            word = word[:-3]

    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def english(words: Column) -> Column:
    """An array of terms without stop words, stemmed; positions of stop words are dropped."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if r is None else [stem(w) for w in r if w not in STOP_WORDS] for r in rows])

    return run(words)
