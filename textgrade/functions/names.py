"""Columns derived from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textgrade.fixed_values import CLASS_MARKERS, PUBLISHER, THIRD_CORPUS_TITLE


def _field(name: Column, at: int) -> Column:
    return F.get(F.split(name, "_"), F.lit(at))


def _is_book(name: Column) -> Column:
    """``id_publisher_level_title…``: an id of digits and at least three fields more."""
    return name.rlike(r"^[0-9]+_[^_]*_[^_]*_")


def _is_third(name: Column) -> Column:
    """An id of digits and what follows, without the fields of a book."""
    return name.rlike(r"^[0-9]+_") & ~_is_book(name)


def title(name: Column) -> Column:
    """``level_title`` of a book, one shared title for the third corpus, NULL for other names."""
    book = F.concat_ws("_", _field(name, 2), _field(name, 3))
    return F.when(_is_book(name), book).when(_is_third(name), F.lit(THIRD_CORPUS_TITLE))


def bare_title(name: Column, strict: bool = False) -> Column:
    """Title without the level; with ``strict`` a name of neither corpus raises."""
    col = F.when(_is_book(name), _field(name, 3)).when(_is_third(name), F.lit(THIRD_CORPUS_TITLE))
    if strict:
        message = F.concat(F.coalesce(name, F.lit("NULL")), F.lit(": name of neither corpus"))
        col = col.otherwise(F.raise_error(message))
    return col


def _marker_position(name: Column) -> Column:
    """1-based position of the first level marker found, 1 when there is none."""
    col = F.lit(1)
    for marker in reversed(CLASS_MARKERS):
        col = F.when(F.instr(name, marker) > 0, F.instr(name, marker)).otherwise(col)
    return col


def trailing_level(file_name: Column) -> Column:
    """Level in ``some-title-a1-a2.txt``: from the marker to the extension."""
    at = _marker_position(file_name)
    return F.substring(file_name, at, F.greatest(F.length(file_name) - 4 - at + 1, F.lit(0)))


def leading_title(file_name: Column) -> Column:
    """Title in ``some-title-a1-a2.txt``: all before the separator in front of the marker.

    Without a marker the slice ends one character before the end, as slicing with -1 does.
    """
    at = _marker_position(file_name)
    return F.when(at > 1, F.substring(file_name, F.lit(1), at - 2)).otherwise(
        F.substring(file_name, F.lit(1), F.greatest(F.length(file_name) - 1, F.lit(0)))
    )


def class_of(name: Column) -> Column:
    """Class by marker in the name, NULL when no marker occurs."""
    col = F.lit(None).cast("int")
    for label, marker in reversed(list(enumerate(CLASS_MARKERS))):
        col = F.when(F.contains(name, F.lit(marker)), F.lit(label)).otherwise(col)
    return col


def level_part(file_name: Column) -> Column:
    """First ``_`` part of a book file name."""
    return F.split_part(file_name, F.lit("_"), F.lit(1))


def title_part(file_name: Column) -> Column:
    """Second ``_`` part of a book file name; the extension is removed before splitting."""
    return F.split_part(F.regexp_replace(file_name, r"\.txt$", ""), F.lit("_"), F.lit(2))


def padded(number: Column, width: int) -> Column:
    """Zero-padded number that is never cut."""
    return F.format_string(f"%0{width}d", number)


def chapter_name(global_id: Column, level: Column, book: Column, chapter: Column, publisher: str = PUBLISHER) -> Column:
    """``0007_<publisher>_<level>_<title>_003.txt``."""
    stem = F.concat_ws("_", padded(global_id, 4), F.lit(publisher), level, book, padded(chapter, 3))
    return F.concat(stem, F.lit(".txt"))
