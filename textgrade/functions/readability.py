"""Readability formulas over per-document means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textgrade.fixed_values import AUTO_READ_INDEX, COLEMAN_LIAU, FLESCH_EASE, FLESCH_KINCAID


def flesch_ease(words_per_sentence: Column, syllables_per_token: Column) -> Column:
    base, per_word, per_syllable = FLESCH_EASE
    return F.lit(base) - words_per_sentence * per_word - syllables_per_token * per_syllable


def flesch_kincaid_grade(words_per_sentence: Column, syllables_per_token: Column) -> Column:
    per_word, per_syllable, base = FLESCH_KINCAID
    return words_per_sentence * per_word + syllables_per_token * per_syllable - base


def auto_read_index(words_per_sentence: Column, chars_per_word: Column) -> Column:
    per_word, per_char, base = AUTO_READ_INDEX
    return words_per_sentence * per_word + chars_per_word * per_char - base


def coleman_liau_index(words_per_sentence: Column, chars_per_word: Column) -> Column:
    per_char, per_sentence, base = COLEMAN_LIAU
    sentences_per_word = F.try_divide(F.lit(1.0), words_per_sentence)
    return chars_per_word * per_char * 100 - sentences_per_word * per_sentence * 100 - base
