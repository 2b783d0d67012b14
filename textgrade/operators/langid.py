"""Language identification with character n-gram profiles (after Cavnar & Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textgrade.functions.text import split_units
from textgrade.operators.ingest import reassembled, units

GRAM_SIZES = (3,)
PROFILE_SIZE = 1000
FLOOR = 1e-6  # share assumed for a gram missing from a profile
_NOT_LETTERS = r"[^\p{L}]+"
_POINT_BITS = 21  # of a code point
_CHUNK = 2_000_000  # code points that are looked up together
SCALE = 1_000_000  # weights are whole millionths, so that sums do not depend on their order


def letters_only(text: Column) -> Column:
    """Lower-cased words between single spaces, NULL when there is no letter."""
    cleaned = F.trim(F.regexp_replace(F.lower(text), _NOT_LETTERS, " "))
    return F.when(cleaned != "", F.concat(F.lit(" "), cleaned, F.lit(" ")))


def grams(text: Column, sizes: Sequence[int] = GRAM_SIZES) -> Column:
    """All overlapping character n-grams of a text, as one array.

    A look-ahead matches at every character without consuming it, so one linear regex pass per size
    yields the grams; it does not begin in the middle of a surrogate pair.
    """
    return F.concat(*[F.regexp_extract_all(text, F.lit(rf"(?=([^\uDC00-\uDFFF].{{{n - 1}}}))"), F.lit(1)) for n in sizes])


def gram_rows(df: DataFrame, text: str, keep: Sequence[str], sizes: Sequence[int] = GRAM_SIZES) -> DataFrame:
    cleaned = df.select(*keep, letters_only(F.col(text)).alias("_letters"))
    return cleaned.select(*keep, F.explode(grams(F.col("_letters"), sizes)).alias("gram"))


def language_profiles(
    labelled: DataFrame, lang: str = "lang", text: str = "text", top: int = PROFILE_SIZE, sizes: Sequence[int] = GRAM_SIZES
) -> DataFrame:
    """The ``top`` commonest grams per language with the weight of their share: ``lang, gram, n, weight``."""
    counts = gram_rows(labelled, text, [lang], sizes).groupBy(lang, "gram").agg(F.count("*").alias("n"))
    # partial sums and limits per task: no language, however large, is gathered in one place
    totals = counts.groupBy(lang).agg(F.sum("n").alias("_total"))
    w = Window.partitionBy(lang).orderBy(F.desc("n"), "gram")
    best = counts.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= top)
    share = F.col("n").cast("double") / F.col("_total").cast("double")
    weight = F.floor(F.log(share / FLOOR) * SCALE + 0.5).cast("long")
    return best.join(totals, lang).select(lang, "gram", "n", weight.alias("weight"))


class GramTable:
    """Exact lookup of many grams at once: every prefix length has one sorted array of codes.

    A code is the number of the prefix one shorter and the next code point, so a gram of any length is
    found by as many binary searches as it has code points, and no two grams share a code.
    """

    def __init__(self, grams: Sequence[str], weights: np.ndarray):
        self.weights = weights
        self.levels: dict[int, list[np.ndarray]] = {}
        self.rows: dict[int, np.ndarray] = {}
        lengths = np.array([len(g) for g in grams], dtype=np.int64)
        for n in sorted(set(lengths.tolist()) - {0}):
            at = np.flatnonzero(lengths == n)
            points = _code_points("".join(grams[i] for i in at)).reshape(len(at), n)
            levels, state = [], points[:, 0]
            for j in range(n):
                state = state if j == 0 else state << _POINT_BITS | points[:, j]
                codes, state = np.unique(state, return_inverse=True)
                levels.append(codes)
            order = np.empty(len(levels[-1]), dtype=np.int64)
            order[state] = at
            self.levels[n], self.rows[n] = levels, order

    def hits(self, points: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units and rows of the table of all known grams; ``unit`` numbers the text of each code point."""
        units, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n, levels in self.levels.items():
            at = np.flatnonzero(unit[: len(unit) - n + 1] == unit[n - 1 :]) if len(unit) >= n else np.empty(0, np.int64)
            state = np.zeros(len(at), dtype=np.int64)
            for j, codes in enumerate(levels):
                code = state << _POINT_BITS | points[at + j]
                state = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                known = codes[state] == code
                at, state = at[known], state[known]
            units.append(unit[at])
            rows.append(self.rows[n][state])
        return np.concatenate(units), np.concatenate(rows)

    def sums(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Known grams of each text, and the sum of their weights per column; whole millionths add up exactly."""
        count, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), self.weights.shape[1]))
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        part = np.cumsum(lengths) // _CHUNK
        for chosen in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
            points = _code_points("".join(texts[i] for i in chosen))
            units, rows = self.hits(points, np.repeat(np.arange(len(chosen)), lengths[chosen]))
            count[chosen] = np.bincount(units, minlength=len(chosen))
            for c in range(total.shape[1]):
                total[chosen, c] = np.bincount(units, self.weights[rows, c], len(chosen))
        return count, total


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def detect(units_df: DataFrame, profiles: DataFrame, languages: Sequence[str], keys: Sequence[str], text: str) -> DataFrame:
    """Best language per row: ``keys, lang_pred, score``; rows without a known gram (or text) are left out.

    The score is the sum of the weights of all grams; the first language by name wins a tie. The profiles
    (profile size x languages rows) go to the tasks with the scorer, so rows stay where they are: no row
    per gram, no join, no shuffle. Grams are as long as those of the profiles.
    """
    names = sorted(languages)
    wide = profiles.where(F.col("lang").isin(names)).groupBy("gram").agg(
        *[F.coalesce(F.sum(F.when(F.col("lang") == l, F.col("weight"))), F.lit(0)).alias(f"w{i}") for i, l in enumerate(names)]
    ).toPandas()
    table = GramTable(wide["gram"].tolist(), wide[[f"w{i}" for i in range(len(names))]].to_numpy(np.float64))

    # not deterministic, so that the filter below does not score every row a second time
    @F.pandas_udf("lang string, score long")
    def best(cleaned: pd.Series) -> pd.DataFrame:
        count, total = table.sums(cleaned.fillna("").tolist())
        first, known = total.argmax(axis=1), count > 0
        lang = np.where(known, np.array(names, dtype=object)[first], None)
        score = pd.array(total[np.arange(len(total)), first].astype(np.int64), dtype="Int64")
        score[~known] = pd.NA
        return pd.DataFrame({"lang": lang, "score": score})

    scored = units_df.select(*keys, best.asNondeterministic()(letters_only(F.col(text))).alias("_best"))
    found = scored.where(F.col("_best.lang").isNotNull())
    return found.select(*keys, F.col("_best.lang").alias("lang_pred"), F.col("_best.score").alias("score"))


def keep_language(
    df: DataFrame, profiles: DataFrame, languages: Sequence[str], target: str, key: str, pieces: Column | None = None
) -> DataFrame:
    """Only the pages (or lines) in the ``target`` language, put together again per document."""
    split = units(df, split_units(F.col("text")) if pieces is None else pieces, [key])
    found = detect(split, profiles, languages, [key, "unit_id", "unit"], "unit")
    return reassembled(found.where(F.col("lang_pred") == target), key, "unit_id", "unit")
