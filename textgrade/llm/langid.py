"""Language ID by a linear-chain conditional random field over the words of a text.

Every word has features: its character n-grams, with marks for begin and end so that they hold its
affixes too, and its place in lexicons of words that are typical of one language. Weights of features
and transitions between the languages of neighbouring words are learned from labelled documents; to
learn when languages change, training sequences are put together from passages of several of them.
Forward-backward gives each word of a text, code-switched or not, its probabilities; the language of the
text is the one with the greatest share of letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import bound_batches, give_back, worker_cache

UNKNOWN = "und"
SAMPLE = 3000  # labelled passages that a model is fitted on, at most
PASSAGE = 40  # words of such a passage
NGRAMS = (1, 2, 3, 4)
SPACE = 1 << 17  # hashed n-gram features
ROUNDS, RATE, DECAY = 60, 0.15, 1e-3  # of the fit
TYPICAL, SEEN = 0.9, 3  # share of a language in a word of its lexicon, and how often it must be seen
CACHE = 250_000  # chunks kept by a worker, and those of one batch
GROUP = 1 << 18  # characters whose chunks are looked up together


def held_out(id_col: str = "doc_id") -> Column:
    """Documents no model learns from: one in five by checksum of the id, and those without id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def letters(chunk: str) -> str:
    low = chunk.lower()
    if low == chunk:
        low = chunk  # one string in memory
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def ngram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, end to end, and where each word's begin."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    stop = ends[owner]
    found, owners = [], []
    total = np.zeros(len(points), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        at = np.arange(len(points)) + n
        total[: len(points) - n + 1] = total[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)  # fixed value: odd multiplier
        if n in NGRAMS:
            keep = at <= stop
            h = total[keep]
            found.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(47))  # fixed value: odd multiplier
            owners.append(owner[keep])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return np.concatenate(found)[order].astype(np.int64) % SPACE, np.r_[0, np.cumsum(counts)[:-1]]


@dataclass
class Model:
    """What is learned: languages, weights of n-grams and lexicons, transitions."""

    langs: list[str]
    ngrams: np.ndarray
    lexicon: dict[str, int]
    listed: np.ndarray
    change: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of every language for each word; 0 where a word is empty."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        at, starts = ngram_features(words)
        out = np.add.reduceat(self.ngrams[at], starts, axis=0)
        place = np.fromiter((self.lexicon.get(w, len(self.langs)) for w in words), np.int64, len(words))
        out += np.r_[self.listed, np.zeros((1, len(self.langs)), np.float32)][place]
        out[np.fromiter(map(len, words), np.int64, len(words)) == 0] = 0
        return out


def marginals(scores: np.ndarray, sizes: np.ndarray, change: np.ndarray, count: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences laid end to end, ``sizes`` being their lengths.

    Gives the probabilities of each label at each place and, with ``count``, the expected transitions.
    """
    n_labels = len(change)
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), side="left")  # sequences longer than t
    local = scores - scores.max(axis=1, keepdims=True) if len(scores) else scores.copy()
    del scores
    np.exp(local, out=local)
    move = np.exp(change - change.max())
    ahead = np.empty_like(local)
    state = np.full((len(length), n_labels), 1 / n_labels, local.dtype)
    for t in range(longest):
        k = alive[t]
        at = begin[:k] + t
        state = (state[:k] if t == 0 else state[:k] @ move) * local[at]
        state /= state.sum(axis=1, keepdims=True)
        ahead[at] = state
    out = ahead  # a place is read for the last time when it is written
    moves = np.zeros((n_labels, n_labels))
    back = np.ones((len(length), n_labels), local.dtype)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        both = ahead[at] * back[:k]
        out[at] = both / both.sum(axis=1, keepdims=True)
        if t:
            seen = back[:k] * local[at]
            back[:k] = seen @ move.T
            if count:
                before = ahead[at - 1]
                norm = (before * back[:k]).sum(axis=1, keepdims=True)
                moves += (before / norm).T @ seen * move
            back[:k] /= back[:k].sum(axis=1, keepdims=True)
    return out, moves


def fit(passages: list[tuple[str, list[str]]]) -> Model:
    """Fit a model to passages, each a language and words in order."""
    langs = sorted({lang for lang, _ in passages})
    number = {lang: i for i, lang in enumerate(langs)}
    passages = [(number[lang], [w for w in map(letters, words) if w]) for lang, words in passages]
    passages = [p for p in passages if p[1]]
    vocabulary: dict[str, int] = {}
    seen: dict[int, np.ndarray] = {}
    for lang, words in passages:
        for w in words:
            at = vocabulary.setdefault(w, len(vocabulary))
            seen.setdefault(at, np.zeros(len(langs)))[lang] += 1
    lexicon = {w: int(seen[i].argmax()) for w, i in vocabulary.items() if seen[i].sum() >= SEEN and seen[i].max() >= TYPICAL * seen[i].sum()}
    # sequences: passages one after the other in a random order, four to a sequence
    rng = np.random.default_rng(1)
    tokens, labels, sizes = [], [], []
    order = rng.permutation(len(passages))
    for at in range(0, len(order), 4):
        size = 0
        for i in order[at : at + 4]:
            lang, words = passages[i]
            tokens += [vocabulary[w] for w in words]
            labels += [lang] * len(words)
            size += len(words)
        sizes.append(size)
    tokens, labels, sizes = np.array(tokens, np.int64), np.array(labels, np.int64), np.array(sizes, np.int64)
    n = len(langs)
    model = Model(langs, np.zeros((SPACE, n), np.float32), lexicon, np.zeros((n, n), np.float32), np.zeros((n, n), np.float32))
    if not len(tokens):
        return model
    words = list(vocabulary)
    at, starts = ngram_features(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.r_[starts, len(at)]))
    place = np.array([lexicon.get(w, n) for w in words])
    truth = np.zeros((len(words), n))
    np.add.at(truth, (tokens, labels), 1)
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(sizes) - sizes] = True
    true_moves = np.zeros((n, n))
    inner = np.flatnonzero(~first)
    np.add.at(true_moves, (labels[inner - 1], labels[inner]), 1)
    parts = [model.ngrams, model.listed, model.change]
    mean, square = [np.zeros(p.shape) for p in parts], [np.zeros(p.shape) for p in parts]
    for step in range(1, ROUNDS + 1):
        expected, moves = marginals(model.emissions(words)[tokens].astype(np.float64), sizes, model.change, count=True)
        gap = truth.copy()
        for k in range(n):
            gap[:, k] -= np.bincount(tokens, expected[:, k], len(words))
        grams = np.stack([np.bincount(at, gap[owner, k], SPACE) for k in range(n)], axis=1)
        lists = np.stack([np.bincount(place, gap[:, k], n + 1)[:n] for k in range(n)], axis=1)
        for i, (part, slope) in enumerate(zip(parts, (grams, lists, true_moves - moves))):
            slope = slope / len(sizes) - DECAY * part
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope**2
            part += (RATE * mean[i] / (1 - 0.9**step) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the documents with a language that are not held out.

    At most ``sample`` passages of ``PASSAGE`` words are looked at, as many of each language and one of
    a document; which ones depends on a hash of the id alone. Without such documents it knows no language.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([])
    quota = max(1, sample // len(counts))
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * quota / n + 20 / n))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    start = F.pmod(F.xxhash64(F.lit("start"), "id"), F.greatest(F.size("words") - PASSAGE, F.lit(1))).cast("int")
    picked = own.withColumn("draw", draw).filter(F.col("draw") < F.element_at(chance, F.col("lang"))).withColumn("words", words)
    rows = picked.select("lang", "draw", F.slice("words", start + 1, PASSAGE).alias("words")).collect()
    left = dict.fromkeys(counts, quota)
    passages = []
    for r in sorted(rows, key=lambda r: r["draw"]):
        if left[r["lang"]]:
            left[r["lang"]] -= 1
            passages.append((r["lang"], r["words"]))
    return fit(passages)


class Reader:
    """Reads texts with a model; keeps the scores of the words it has met.

    It keeps what comes first, and so what is common; once there is enough of it, what a batch adds is
    dropped after that batch. When that has been twice as much, the texts have changed and it starts anew.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.scores = np.zeros((1 << 16, len(self.model.langs)), np.float32)
        self.weights = np.zeros(1 << 16, np.float32)
        self.missed = 0

    def _learn(self, chunks: set[str]) -> None:
        plain = {c: letters(c) for c in chunks}
        new = sorted({w for w in plain.values()} - self.words.keys())
        used = len(self.words)
        while used + len(new) > len(self.scores):
            self.scores, self.weights = np.r_[self.scores, self.scores], np.r_[self.weights, self.weights]
        self.scores[used : used + len(new)] = self.model.emissions(new)
        self.weights[used : used + len(new)] = np.fromiter(map(len, new), np.float32, len(new))
        self.words.update(zip(new, range(used, used + len(new))))
        self.chunks.update((c, self.words[w]) for c, w in plain.items())

    def _look_up(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of each text; only chunks not met before are held as strings, those of a few texts at once."""
        found, open_ = [], []
        for text in texts:
            chunks = text.split()
            at = np.fromiter(map(self.chunks.get, chunks, repeat(-1)), np.int32, len(chunks))
            missing = np.flatnonzero(at < 0)
            if len(missing):
                open_.append((at, missing, [chunks[i] for i in missing.tolist()]))
            found.append(at)
        if open_:
            self._learn({c for _, _, chunks in open_ for c in chunks})
        for at, missing, chunks in open_:
            at[missing] = list(map(self.chunks.__getitem__, chunks))
        return found

    def read(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        if self.missed > 2 * CACHE:
            self.clear()
        kept = (len(self.chunks), len(self.words)) if len(self.chunks) >= CACHE else None
        found = [at for group in _groups(texts, GROUP) for at in self._look_up(group)]
        if kept:
            self.missed += len(self.chunks) - kept[0]
            for held, n in zip((self.chunks, self.words), kept):
                for _ in range(len(held) - n):
                    held.popitem()  # the last that came; their scores stand until the next batch
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = np.concatenate(found) if found else np.zeros(0, np.int32)
        weights = self.weights[at]
        owner = np.repeat(np.arange(len(texts)), sizes)
        total = np.bincount(owner, weights, len(texts))
        if not self.model.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        chances, _ = marginals(self.scores[at], sizes, self.model.change)
        share = np.stack([np.bincount(owner, weights * chances[:, k], len(texts)) for k in range(len(self.model.langs))], axis=1)
        best = share.argmax(axis=1)
        score = np.divide(share[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0)
        langs = [self.model.langs[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
        return langs, np.clip(score, 0, 1).tolist()


def _groups(texts: list[str], most: int) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > most:
            yield group
            group, size = [], 0
    yield group


def _read(reader: Reader, texts: list[str]) -> Iterator[tuple[list[str], list[float]]]:
    yield from map(reader.read, _groups(texts, 4 << 20))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``score`` is the share of letters in words of ``lang_pred``, by their probabilities. A text that is
    null or has no letter is ``und`` with score 0, and so is every text under a model without languages.
    Of languages with equal shares the first by name wins. Only the text is looked at.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_cache("languages", int)  # what another operator has left goes
        reader = Reader(shared.value)
        for texts in batches:
            langs, scores = [], []
            for a, b in _read(reader, [t or "" for t in texts.to_pylist()]):
                langs += a
                scores += b
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        del reader  # idle workers keep nothing
        give_back()

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = F.arrow_udf(predict, "lang_pred string, score double")(F.col(text_col))
    return docs.select(*[F.col(f"`{c}`") for c in own], found.alias("__found")).select(
        *[F.col(f"`{c}`") for c in own], F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score")
    )
