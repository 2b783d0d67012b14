"""String columns: normalising, splitting, character counts, syllables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textgrade.fixed_values import PAGE_BREAK, SENTENCE_PATTERN, SYLLABIC_M_WORDS, TOKEN_PATTERN, VOWELS

_LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
# One match per syllable: an opening eu or au, ou, eu as in neuro, a vowel, a run of r or l with no
# vowel on either side, and the syllabic m of the few listed words.
_NUCLEUS = "|".join(
    (
        "^eu",
        "^au",
        "(?<=n)eu(?=r++o)",
        "ou",
        f"[{VOWELS}]",
        f"(?<![{VOWELS}r])r++(?![{VOWELS}])",
        f"(?<![{VOWELS}l])l++(?![{VOWELS}])",
        f"(?<=^(?:{'|'.join(word[:-1] for word in SYLLABIC_M_WORDS)}))m++$",
    )
)


def normalized(text: Column) -> Column:
    """No-break space to space, soft hyphen removed."""
    return F.translate(text, "\u00a0\u00ad", " ")


def split_units(text: Column, delimiter: str = PAGE_BREAK) -> Column:
    """Pieces between delimiters, empty ones kept."""
    return F.split(text, "\\Q" + delimiter + "\\E")


def split_lines(text: Column) -> Column:
    """Lines with their line ends, as reading a file line by line gives them."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def is_punctuation(token: Column) -> Column:
    """No letter and no digit in the token."""
    return ~token.rlike(_LETTER_OR_DIGIT)


def syllables(word: Column) -> Column:
    """Syllable count of a Czech word; punctuation has none. Repeated r, l, m count as one."""
    return F.regexp_count(F.lower(word), F.lit(_NUCLEUS))
