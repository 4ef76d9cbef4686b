"""Toxicity by compression distance: a Zstandard dictionary of ordinary text against one of toxic text.

The ordinary dictionary holds the commonest words of ordinary training texts; the toxic
one holds the same and, nearest to its end, the segments that toxic texts have far more
often. Both compress every window of a text; how many bytes the toxic dictionary saves
is the window's distance. A window is a word between spaces, in two bytes a character so
that a match counts more than its sequence costs. The shares of windows beyond each of a
few thresholds are weighed by a logistic regression fitted on the training texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free_name, text_or_empty

#: Labelled rows that the dictionaries and weights are fitted on at most, toxic and ordinary: those of least hash.
MOST_TOXIC, MOST_ORDINARY = 1_500, 3_000
#: Words of the ordinary dictionary; segment lengths in characters.
ORDINARY_WORDS, SEGMENT = 600, range(5, 11)
#: A toxic segment has so many toxic contexts, so many times the share of ordinary ones, and so large a G statistic.
LEAST_CONTEXTS, LEAST_RATIO, LEAST_G = 6, 3.0, 30.0
#: Bytes saved by a window that count, one feature each; ridge of the regression; words whose distance a task remembers.
THRESHOLDS, RIDGE, REMEMBERED = (3, 4, 5, 6, 8), 1.0, 200_000
#: Predict toxic from this score on.
LEAST_SCORE = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _segments(word: str) -> set[str]:
    """Beginnings of a word with the space before it, and the whole word with both spaces."""
    w = f" {word}"
    return {*(w[:k] for k in SEGMENT if k <= len(w)), f"{w} "}


class Vocabulary(dict):
    """Words to numbers from 1, in the order they are met. 0 stands for no word."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n

    def numbers(self, text: str) -> np.ndarray:
        return np.array([self[w] for w in words_of(text)], np.int64)


def _contexts(texts: list[np.ndarray], words: int) -> tuple[np.ndarray, int]:
    """In how many distinct contexts (a word between its neighbours) each word is, and how many there are; words: one more than the largest number.

    Copies and near copies repeat their contexts, so they count once; a word that is used again and again counts each time.
    """
    none = np.zeros(1, np.int64)
    flat = np.concatenate([none, *(x for t in texts for x in (t, none))])
    before, here, after = flat[:-2], flat[1:-1], flat[2:]
    real = here > 0
    pair = np.unique(before[real] * words + here[real], return_inverse=True)[1]
    first = np.unique(pair * words + after[real], return_index=True)[1]
    return np.bincount(here[real][first], minlength=words), len(first)


def _by_segment(counts: np.ndarray, vocabulary: Vocabulary, wanted: set[str] | None = None) -> Counter:
    found = Counter()
    for word, n in vocabulary.items():
        if count := int(counts[n]):
            for s in _segments(word) if wanted is None else _segments(word) & wanted:
                found[s] += count
    return found


def toxic_segments(toxic: list[np.ndarray], ordinary: list[np.ndarray], vocabulary: Vocabulary) -> list[str]:
    """What toxic texts have far more often than ordinary ones, strongest first; of nested ones the longest strong one."""
    (a, n), (b, m) = (_contexts(part, len(vocabulary) + 1) for part in (toxic, ordinary))
    a = _by_segment(a, vocabulary)
    wanted = {s for s, x in a.items() if x >= LEAST_CONTEXTS}
    b = _by_segment(b, vocabulary, wanted)
    strength: dict[str, float] = {}
    for s in wanted:
        x, y = a[s], b[s]
        share = (x + y) / (n + m)
        g = 2 * (x * math.log(x / (n * share)) + (y * math.log(y / (m * share)) if y else 0))
        if x / n >= LEAST_RATIO * (y + 0.5) / max(1, m) and g >= LEAST_G:
            strength[s] = g
    stems = defaultdict(list)
    for s in strength:
        stems[s[: SEGMENT.start]].append(s)
    best = [(max(map(strength.get, group)), group) for group in stems.values()]
    return [max((s for s in group if strength[s] >= 0.8 * top), key=lambda s: (len(s), s)) for top, group in sorted(best, key=lambda x: (-x[0], x[1]))]


class Distance(dict):
    """Window text to the bytes that the toxic dictionary saves, remembering a bounded number of windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.compress = [self._compressor(x).compress for x in (ordinary, toxic)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, window_log=16, chain_log=14, hash_log=14, search_log=6, min_match=5, target_length=64,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        kind.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=kind, compression_params=params)

    def __missing__(self, window: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        x = f" {window} ".encode("utf-16-le", "surrogatepass")
        self[window] = d = len(self.compress[0](x)) - len(self.compress[1](x))
        return d

    def features(self, words: list[str]) -> np.ndarray:
        """Per mille-like shares of windows beyond each threshold, clipped: 1 is one window in fifty."""
        return shares(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))


def shares(saved: np.ndarray) -> np.ndarray:
    return np.array([min(4.0, 50.0 * int((saved >= t).sum()) / (len(saved) + 1)) for t in THRESHOLDS])


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([RIDGE] * (len(w) - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Two dictionaries and the weights of the window shares; scores 0 if there was nothing to learn from."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        vocabulary = Vocabulary()
        texts = [[vocabulary.numbers(t) for t in part] for part in (toxic, ordinary)]
        segments = toxic_segments(*texts, vocabulary) if all(texts) else []
        counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *texts[1]]), minlength=len(vocabulary) + 1)
        common = sorted((w for w, n in vocabulary.items() if counts[n]), key=lambda w: (-counts[vocabulary[w]], w))[: ORDINARY_WORDS * 2]
        common = [w for w in common if not any(f" {w} ".startswith(s) for s in segments)][:ORDINARY_WORDS]
        both = " " + " ".join(reversed(common)) + " "
        self.contents = [x.encode("utf-16-le", "surrogatepass") for x in (both, both + " ".join(reversed(segments)))]
        self.weights = None
        if segments:
            distance = self.distance()
            saved = np.array([0, *(distance[w] for w in vocabulary)])
            x = np.array([shares(saved[t]) for part in texts for t in part])
            self.weights = _regression(x, np.repeat([1.0, 0.0], [len(toxic), len(ordinary)]))

    @classmethod
    def of(cls, contents: tuple[bytes, bytes], weights: list[float] | None) -> Model:
        made = cls([], [])
        made.contents, made.weights = [bytes(c) for c in contents], None if weights is None else np.array(weights)
        return made

    def distance(self) -> Distance:
        return Distance(*self.contents)

    def score(self, text: str, distance: Distance) -> float:
        if self.weights is None:
            return 0.0
        z = float(distance.features(words_of(text)) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: str):
    """Whether the checksum of the id as text leaves 1 modulo 3: never learnt from. A null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out, in one task. Of several labels of an id the largest counts."""
    named = labels.select(labels[doc_id].cast("long").alias("__id"), labels[label].cast("int").alias("__label")).dropna()
    chosen = named.where(~held_out("__id")).groupBy("__id").agg(F.max("__label").alias("__label"))
    sample = [chosen.where(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(most) for value, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY))]
    rows = docs.select(docs[doc_id].cast("long").alias("__id"), text_or_empty(docs, text).alias("__text")).join(F.broadcast(sample[0].unionByName(sample[1])), "__id")
    # repeated rows of an id may be more than the ids: bounded again
    one = rows.groupBy("__id", "__label").agg(F.max("__text").alias("__text")).repartition(1).sortWithinPartitions("__id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, list[str]] = {1: [], 0: []}
        for batch in batches:
            for value, t in zip(batch.column("__label").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                texts[value].append(t)
        made = Model(texts[1], texts[0])
        weights = None if made.weights is None else made.weights.tolist()
        yield pa.record_batch([pa.array([c], pa.binary()) for c in made.contents] + [pa.array([weights], pa.list_(pa.float64()))], ["ordinary", "toxic", "weights"])

    told = one.mapInArrow(learn, "ordinary binary, toxic binary, weights array<double>").collect()  # one row, of two small dictionaries
    return Model.of((told[0][0], told[0][1]), told[0][2]) if told else Model([], [])


def score_texts(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the column ``score`` (0 to 1) added, or replaced. Null and empty texts score as texts without windows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        distance = model.distance()
        for batch in batches:
            scores = [model.score(t.as_py() or "", distance) for t in batch.column(inner)]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, score])

    kept = [c for c in docs.columns if c.lower() != score.lower()]
    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{score}` double"])
    inner = text if text in kept else "__text"
    return docs.select(*kept, *([] if text in kept else [F.col(text).alias(inner)])).mapInArrow(run, ddl)


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that score LEAST_SCORE or more; all columns and all other rows as they are."""
    model = fit(docs, labels, doc_id, text)
    name = free_name(docs.columns, "__score")
    scored = score_texts(docs, model, text, name)
    return scored.where(F.col(name) < LEAST_SCORE).select(*(f"`{c}`" for c in docs.columns))
