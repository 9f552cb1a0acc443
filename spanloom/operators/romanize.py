"""Romanisation by a longest-match rewriting automaton, built from Unicode letter names.

A letter's name says its sound: ``ARABIC LETTER BEH``, ``HIRAGANA LETTER KA``.
Rules turn names into Latin letters, a short table for each alphabet whose
names aren't spelt as they sound.  Sequences have rules too (a syllable and a
small vowel, a doubled consonant, a digraph), so at each place the longest rule
wins.  Letters of any script without rules are left out, as are marks.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The sounds of letter names that aren't spelt as they sound, by script.
SOUNDS: dict[str, dict[str, str]] = {
    "ARABIC": {
        "HAMZA": "'", "ALEF": "a", "BEH": "b", "TEH MARBUTA": "h", "TEH": "t", "THEH": "th", "JEEM": "j", "HAH": "h", "KHAH": "kh", "DAL": "d", "THAL": "th", "REH": "r", "ZAIN": "z", "SEEN": "s", "SHEEN": "sh", "SAD": "s", "DAD": "d",
        "TAH": "t", "ZAH": "z", "AIN": "'", "GHAIN": "gh", "FEH": "f", "QAF": "q", "KAF": "k", "KEHEH": "k", "LAM": "l", "MEEM": "m", "NOON": "n", "HEH": "h", "WAW": "w", "ALEF MAKSURA": "a", "YEH": "y", "FARSI YEH": "y", "PEH": "p",
        "TCHEH": "ch", "JEH": "zh", "GAF": "g", "VEH": "v",
    },
    "CYRILLIC": {
        "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "IE": "e", "IO": "yo", "ZHE": "zh", "ZE": "z", "SHORT I": "y", "KA": "k", "EL": "l", "EM": "m", "EN": "n", "PE": "p", "ER": "r", "ES": "s", "TE": "t", "EF": "f", "HA": "kh", "TSE": "ts",
        "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "HARD SIGN": "", "YERU": "y", "SOFT SIGN": "", "UKRAINIAN IE": "ye", "BYELORUSSIAN-UKRAINIAN I": "i", "YI": "yi",
    },
    "GREEK": {"THETA": "th", "PHI": "ph", "CHI": "ch", "PSI": "ps", "FINAL SIGMA": "s"},
    "HEBREW": {"ALEF": "'", "TSADI": "ts", "FINAL TSADI": "ts", "SHIN": "sh", "AYIN": "'", "HET": "ch", "FINAL KAF": "k", "FINAL MEM": "m", "FINAL NUN": "n", "FINAL PE": "p", "TAV": "t"},
    "LATIN": {"SHARP S": "ss", "ETH": "d", "THORN": "th", "DOTLESS I": "i", "KRA": "q", "ENG": "ng"},
}
#: Pairs of letters with a sound of their own.
DIGRAPHS = {"ου": "ou", "αυ": "au", "ευ": "eu", "μπ": "b", "ντ": "d", "γκ": "g", "γγ": "ng"}
#: Scripts whose letters stand for syllables that their names spell.
SYLLABLES = ("HIRAGANA", "KATAKANA")
RANGES = ((0xC0, 0x250), (0x370, 0x530), (0x5D0, 0x5EB), (0x620, 0x6D4), (0x1E00, 0x2000), (0x3041, 0x30FB))


def sound(letter: str) -> str | None:
    """The Latin letters that a letter's name says; null if there is no rule."""
    found = re.fullmatch(r"(\w+)(?: SMALL| CAPITAL)? (?:LETTER|LIGATURE)(?: SMALL)? (.+)", unicodedata.name(letter, ""))
    if not found:
        return None
    script, name = found[1], re.sub(r" WITH .*| (?:ISOLATED|INITIAL|MEDIAL|FINAL) FORM", "", found[2])
    known = SOUNDS.get(script, {})
    if name in known:
        return known[name]
    if script in SYLLABLES:
        return name.lower() if name.isalpha() else None
    if script == "LATIN":
        return name.lower() if len(name) < 3 else None
    if script in ("GREEK", "HEBREW"):
        return name[0].lower()
    return name.lower() if script == "CYRILLIC" and name.isalpha() and len(name) < 3 else None


def rules() -> dict[str, str]:
    """All rewriting rules, longest keys included."""
    out = {c: s for a, b in RANGES for c in map(chr, range(a, b)) if (s := sound(c)) is not None}
    for first in range(0x3041, 0x30FB):
        # a syllable in i takes a small ya, yu or yo; a small tu doubles what comes after it
        base = out.get(chr(first), "")
        shift = 0x60 if first >= 0x30A1 else 0
        if len(base) > 1 and base.endswith("i"):
            for small, vowel in ((0x3083, "ya"), (0x3085, "yu"), (0x3087, "yo")):
                out[chr(first) + chr(small + shift)] = base[:-1] + vowel
        if base and base[0] not in "aiueon":
            out[chr(0x3063 + shift) + chr(first)] = base[0] + base
    return out | DIGRAPHS


class Romanizer:
    """The automaton: states are the prefixes of rules, by letter."""

    def __init__(self, table: dict[str, str] | None = None):
        self.start: dict = {}
        for key, value in (rules() if table is None else table).items():
            state = self.start
            for c in key:
                state = state.setdefault(c, {})
            state[""] = value
        self.known: dict[str, str] = {}

    def _word(self, word: str) -> str:
        text, out, at = unicodedata.normalize("NFC", word.lower()), [], 0
        while at < len(text):
            state, end, value = self.start, at + 1, text[at] if text[at].isascii() else self._syllable(text[at])
            k = at
            while k < len(text) and (state := state.get(text[k])) is not None:
                k += 1
                if "" in state:
                    end, value = k, state[""]
            out.append(value)
            at = end
        return "".join(out)

    @staticmethod
    def _syllable(c: str) -> str:
        """A Hangul syllable by its name; other letters by their base letter, if that is Latin."""
        name = unicodedata.name(c, "")
        if name.startswith("HANGUL SYLLABLE "):
            return name.rpartition(" ")[2].lower()
        return "".join(x for x in unicodedata.normalize("NFKD", c).lower() if x.isascii())

    def __call__(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self._word(word)
        return self.known[word]


def roman_tokens(text: str, romanizer: Romanizer | None = None) -> list[str]:
    """Each word's letters a to z and apostrophes, after romanisation."""
    r = romanizer or shared()
    return [re.sub("[^a-z']", "", r(w)) for w in text.split()]


_shared: list[Romanizer] = []


def shared() -> Romanizer:
    if not _shared:
        _shared.append(Romanizer())
    return _shared[0]


@F.pandas_udf(StringType())
def romanized(text: pd.Series) -> pd.Series:
    """The tokens of :func:`roman_tokens`, joined by blanks; words without letters are empty tokens."""
    return text.map(lambda t: None if t is None else " ".join(roman_tokens(t)))
