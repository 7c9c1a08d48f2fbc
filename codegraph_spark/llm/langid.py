"""Language ID by string kernels (operator 9).

A text is the set of its 1- to 3-grams of letters (lower case; all else is one space). The kernel of two texts is the number
of n-grams in both, over the root of the product of their numbers. A bounded sample of landmarks spans the Nyström feature
space, one-versus-rest kernel ridge regression is fitted there on a bounded sample of labelled rows, and whole texts are
scored a batch at a time: presence matrix x landmark matrix x projection x weights. Every letter of every script is its own
symbol, and every language in the sample can be predicted.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import arrow_map

#: Bounds of the labelled sample on the driver: rows of a language (about), rows of all languages (about), characters of a row.
TRAIN_PER_LANGUAGE, TRAIN_ROWS, TRAIN_CHARS = 300, 20_000, 5_000
#: Landmarks; with more languages than that one for each, up to the second number.
LANDMARKS, MOST_LANDMARKS, RIDGE = 160, 2_000, 1e-3
_LETTER = regex.compile(r"\p{L}")
_BITS, _TWO, _ONE = np.uint64(21), np.uint64(1 << 63), np.uint64(3 << 62)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code point -> itself for letters, 0 for all else."""
    points = np.arange(0x110000, dtype=np.uint64)
    points[[p for p in range(0x110000) if 0xD800 <= p < 0xE000 or not chr(p).isalpha()]] = 0
    return points


def _distinct(v: np.ndarray) -> np.ndarray:
    v = np.sort(v)
    return v[np.r_[True, v[1:] != v[:-1]]] if len(v) else v


def ngrams(text: str) -> np.ndarray:
    """The sorted set of a text's n-grams: 21 bits a letter, the length in the two highest bits."""
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    c = np.r_[np.uint64(0), c, np.uint64(0)]
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]  # runs of spaces are one
    if len(c) < 3:
        c = np.r_[c, np.zeros(3 - len(c), np.uint64)]
    three = _distinct((c[:-2] << _BITS << _BITS) | (c[1:-1] << _BITS) | c[2:])
    two = _distinct(np.r_[three >> _BITS, c[-2] << _BITS | c[-1]])
    one = _distinct(np.r_[two >> _BITS, c[-1]])
    return np.concatenate([three, two | _TWO, one | _ONE])


@dataclass
class Model:
    grams: np.ndarray  # the landmarks' n-grams, sorted
    landmarks: np.ndarray  # [grams, landmarks], each over the root of its size
    weights: np.ndarray  # [landmarks, languages]
    languages: list[str]

    def presence(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(self.grams)), np.float32)
        for k, s in enumerate(sets):
            at = np.minimum(np.searchsorted(self.grams, s), len(self.grams) - 1)
            x[k, at[self.grams[at] == s]] = 1
        return x

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts with the landmarks."""
        return (self.presence(sets) @ self.landmarks) / np.sqrt([[len(s)] for s in sets])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; of equal scores the language that sorts first."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not rows or not self.languages:
            return names, scores
        out = self.kernel([ngrams(texts[i]) for i in rows]) @ self.weights
        best = out.argmax(1)
        for k, i in enumerate(rows):
            names[i] = self.languages[best[k]]
            scores[i] = float(min(1.0, max(0.0, out[k, best[k]])))
        return names, scores


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from a sample; no usable rows: a model that knows no language. Languages weigh alike, however many rows each has."""
    rows = [(t, g) for t, g in zip(texts, languages, strict=True) if t and g is not None and _LETTER.search(t)]
    if not rows:
        return Model(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros((0, 0)), [])
    sizes = Counter(g for _, g in rows)
    names = sorted(sizes)
    sets = [ngrams(t) for t, _ in rows]
    per, seen, chosen = max(1, landmarks // len(names)), Counter(), []
    for i, (_, g) in enumerate(rows):
        seen[g] += 1
        if seen[g] <= per:
            chosen.append(i)
    chosen = [sets[i] for i in chosen[: max(landmarks, MOST_LANDMARKS)]]
    model = Model(_distinct(np.concatenate(chosen)), np.zeros((0, 0)), np.zeros((0, 0)), names)
    model.landmarks = (model.presence(chosen) / np.sqrt([[len(s)] for s in chosen])).T.astype(np.float32)
    values, vectors = np.linalg.eigh(model.kernel(chosen).astype(float))
    project = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = np.concatenate([model.kernel(sets[at : at + 500]) for at in range(0, len(sets), 500)]) @ project
    weight = np.array([len(rows) / (len(names) * sizes[g]) for _, g in rows])[:, None]
    number = {g: n for n, g in enumerate(names)}
    goal = np.zeros((len(names), features.shape[1]))
    np.add.at(goal, [number[g] for _, g in rows], weight * features)
    solved = np.linalg.solve(features.T @ (weight * features) + ridge * len(rows) * np.eye(features.shape[1]), goal.T)
    model.weights = (project @ solved).astype(np.float32)
    return model


def is_held_out(doc: Column) -> Column:
    return (F.crc32(doc.cast("long").cast("string").cast("binary")) % 4 == 2) & doc.isNotNull()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, most_rows: int = TRAIN_ROWS) -> Model:
    """Fit on about per_language rows of every language (fewer where all languages together would be more than most_rows):
    those whose hashed id falls under the language's share.

    Rows with null text, language or id, held-out rows and texts over TRAIN_CHARS characters teach nothing. Languages are
    counted over all rows; a sample of most_rows rows can't hold more than the most_rows most frequent languages.
    """
    usable = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = usable.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("id")) & (F.length("text") <= TRAIN_CHARS))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()
    if not counts:
        return fit([], [])
    each = min(per_language, max(1.0, most_rows / len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], each / r["n"]) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.join(F.broadcast(shares), "lang").where(draw < F.col("share")).orderBy(F.xxhash64("id"), "id", "text")
    rows = sample.limit(math.ceil(1.5 * each * len(counts))).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and score (0 to 1); these two replace columns of the same name.

    `und` with score 0 where the text is null or has no letter, or where no language was learned; of languages with equal
    scores the one that sorts first. All rows and other columns stay, repeated rows and null ids too; an empty table gives none.
    """
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and MOST_LANDMARKS

    def make():
        model = shared.value

        def one(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                names, scores = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

        return one

    return arrow_map(docs, make, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))
