"""What a text shows at a glance, worked out once and asked by the gates of all rules.

Rules are patterns, and a pattern has to be tried at every character. Whether a text can match at all is mostly a question of which words it has: so its
distinct words are taken once, in lower case, cut to their first letters (stems), and a rule asks whether one of the stems that its matches begin with is there.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a stem.
STEM = 4


@dataclass(frozen=True)
class Clues:
    text: str  # name of the column
    digit: Column
    words: Column
    stems: Column

    def any_of(self, stems: str) -> Column:
        """Whether the text has a word that begins with one of the ``stems``, or is one that is shorter than a stem."""
        return F.arrays_overlap(self.stems, F.array(*(F.lit(s) for s in stems.split())))

    def has_word(self, words: set[str]) -> Column:
        if len(words) <= 100:
            return F.arrays_overlap(self.words, F.array(*(F.lit(w) for w in sorted(words))))
        return F.exists(self.words, WordTable(words).has)

    def begins(self, prefixes: str) -> Column:
        """Whether the text has a word that begins with one of the ``prefixes``, for those that letters may follow without a break."""
        return F.exists(self.stems, lambda s: reduce(lambda a, b: a | b, (s.startswith(p) for p in prefixes.split())))


def folded(text: Column) -> Column:
    """Lower case; letters that patterns take for i or s without regard to case become those, and ß is ss."""
    lower = F.lower(text)
    odd = F.contains(text, F.lit("ſ")) | F.contains(text, F.lit("ı")) | F.contains(text, F.lit("İ"))
    plain = F.when(odd, F.translate(F.replace(lower, F.lit("i̇"), F.lit("i")), "ſı", "si")).otherwise(lower)
    return F.replace(plain, F.lit("ß"), F.lit("ss"))


def words_of(text: Column) -> Column:
    """Distinct runs of a to z in the folded text; other letters part words, so each label or name begins a word by its first plain letter."""
    return F.array_distinct(F.split(folded(text), "[^a-z]+"))


def first_words(phrases) -> set[str] | None:
    """The word of each phrase that :func:`words_of` would see first; None if one has no plain letter at all."""
    out = {next(iter(re.findall("[a-z]+", p.lower().replace("ß", "ss"))), None) for p in phrases}
    return None if None in out else out


def stems_of(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


class WordTable:
    """A set of words that expressions look up: one string in the plan, not a literal for each word.

    The words stand in buckets by their CRC-32, about one in each, so a look-up compares with one or two words however many there are.
    """

    def __init__(self, words) -> None:
        kept = sorted({w for w in words if w and not {"\n", "\t"} & set(w)})
        self.size = 1 << max(len(kept) - 1, 1).bit_length()
        buckets = [""] * self.size
        for w in kept:
            at = zlib.crc32(w.encode()) % self.size
            buckets[at] += w + "\n"
        self.text = "\t".join("\n" + b for b in buckets) if kept else None

    def has(self, word: Column) -> Column:
        if self.text is None:
            return F.lit(False)
        # splitting a constant is done once, when the plan is made
        bucket = F.get(F.split(F.lit(self.text), "\t"), (F.crc32(word.cast("binary")) % self.size).cast("int"))
        return F.coalesce(F.contains(bucket, F.concat(F.lit("\n"), word, F.lit("\n"))), F.lit(False))
