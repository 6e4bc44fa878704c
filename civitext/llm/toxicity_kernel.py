"""Toxicity of whole texts by a subsequence-kernel support vector machine with Nyström landmarks.

Texts are lower-cased and cut at white space into words; punctuation inside a word
is dropped and runs of single letters ("i d i o t") are one word. The kernel of
two words counts their common subsequences of ``ORDER`` symbols, word edges
included, that span at most ``SPAN`` symbols. Every symbol that a subsequence
skips costs a factor ``DECAY``, so a word with inserted characters stays near
the word without them. Kernels are divided by the length norms of both words.

Words like landmarks are turned into features by the Nyström map, and a linear
support vector machine (squared hinge) is trained on labelled sentences: at first every
sentence has the label of its document, then the sentences of a toxic document
count by their strongest word, and only its strongest sentences stay toxic. The margins of
a document's words (the largest, and how many are high) give one probability.

The machine is a weighted sum over landmarks of kernels, and each kernel a sum over
subsequences. Both sums are exchanged: every subsequence of a landmark has one weight, in
a table of ``SYMBOLS ** ORDER`` numbers that a task builds once from the landmarks (a
few KB are sent). Scoring looks up the subsequences of each distinct word of a
slice of texts; its cost is linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.llm import text_arrays as ta

#: Labelled rows of either label that the fit takes, and the longest text (bytes) among them.
SAMPLE, SAMPLE_BYTES = 1200, 1 << 14
THRESHOLD = 0.3
ORDER, SPAN, DECAY, LANDMARKS = 4, 8, 0.6, 192
#: Toxic landmarks are less alike than this.
ALIKE = 0.6
#: Sentences of a toxic document that stay toxic, rounds of training, and the ridge of the machine and of the probability.
STRONGEST, ROUNDS, RIDGE, RIDGE_P = 4, 2, 1e-3, 1e-3
#: Margins that count words, and the largest margin that a word can show.
LEVELS, MOST = (-0.5, 0.0, 0.3, 0.6), 2.0
TOP, GLUED, SEED = 5, 4, 3
#: Symbols: white space, word edge, a to z, digits, other letters by their number.
_SPACE, _EDGE, _LETTER, _DIGIT, _OTHER, SYMBOLS = 0, 1, 2, 28, 29, 40
_SKIP, _PLANE = 255, 0x3000


@cache
def _symbols() -> np.ndarray:
    """The symbol of each lower-case character below ``_PLANE``; the last entry is that of all beyond it."""
    out = np.full(_PLANE + 1, _OTHER, np.uint8)
    for point in range(_PLANE):
        char = chr(point)
        if "a" <= char <= "z":
            out[point] = _LETTER + point - ord("a")
        elif char.isspace():
            out[point] = _SPACE
        elif char.isdigit():
            out[point] = _DIGIT
        else:
            out[point] = _OTHER + point % (SYMBOLS - _OTHER) if char.isalpha() else _SKIP
    return out


@dataclass
class Words:
    """Words of texts: symbols of the distinct ones end to end, and for each word its distinct one, text and sentence."""

    symbols: np.ndarray
    first: np.ndarray
    word: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    texts: int

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        lower = pc.utf8_lower(pc.fill_null(texts, ""))
        sizes = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        points = np.frombuffer("".join(t + "\n" for t in lower.to_pylist()).encode("utf-32-le"), "<u4")
        symbol = _symbols()[np.minimum(points, _PLANE)]
        space = symbol == _SPACE
        ends = points == 10
        ends[1:] |= space[1:] & np.isin(points[:-1], [ord(c) for c in ".!?"])
        del points
        kept = symbol != _SKIP
        sentence, text = np.cumsum(ends, dtype=np.int32)[kept], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[kept]
        symbol, space = symbol[kept], space[kept]
        before = np.concatenate(([True], space[:-1]))
        starts = np.flatnonzero(~space & before)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64), none, none, none, len(sizes))
        n = np.add.reduceat((~space).astype(np.int64), starts)
        letters, sentence, text = symbol[~space], sentence[starts].astype(np.int64), text[starts].astype(np.int64)
        starts = np.cumsum(n) - n
        head = ~_glued(n, letters[starts], sentence)
        starts, sentence, text = starts[head], sentence[head], text[head]
        bounds = np.append(starts, len(letters))
        _, place, word = np.unique(ta.hash_words(letters, bounds[:-1], bounds[1:]), return_index=True, return_inverse=True)
        own = np.diff(bounds)[place] + 2
        first = np.concatenate(([0], np.cumsum(own)))
        symbols = np.full(first[-1], _EDGE, np.uint8)
        inside = np.ones(first[-1], bool)
        inside[first[:-1]] = inside[first[1:] - 1] = False
        symbols[inside] = letters[np.repeat(starts[place] - (first[:-1] - 2 * np.arange(len(own))), own - 2) + np.arange(inside.sum())]
        return cls(symbols, first, word, text, sentence, len(sizes))


def _glued(n: np.ndarray, letter: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Which words go on from the one before: single letters in a run of at least ``GLUED`` in one sentence."""
    single = (n == 1) & (letter != _DIGIT)
    on = np.concatenate(([False], single[1:] & single[:-1] & (sentence[1:] == sentence[:-1])))
    run = np.cumsum(~on)
    return on & (np.bincount(run)[run] >= GLUED)


#: Places of a subsequence's symbols after its first.
_SHAPES = list(combinations(range(1, SPAN), ORDER - 1))


def _found(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape: where it starts, which subsequence is there, and what it counts."""
    ends = np.repeat(words.first[1:], np.diff(words.first))
    left = ends - np.arange(len(ends)) - 1
    weighed = [words.symbols.astype(np.int32) * SYMBOLS**k for k in range(ORDER - 1, -1, -1)]
    at = {last: np.flatnonzero(left >= last) for last in range(ORDER - 1, SPAN)}
    for shape in _SHAPES:
        place = at[shape[-1]]
        key = weighed[0][place]
        for part, off in zip(weighed[1:], shape):
            key = key + part[place + off]
        yield place, key, DECAY ** (shape[-1] + 1 - ORDER)


def _norms(words: Words) -> np.ndarray:
    """The norm of each word as if its subsequences were distinct, which depends on its length alone."""
    n = np.diff(words.first)
    squares = sum(np.maximum(n - shape[-1], 0) * DECAY ** (2 * (shape[-1] + 1 - ORDER)) for shape in _SHAPES)
    return np.sqrt(np.maximum(squares, 1e-12))


def margins(table: np.ndarray, offset: float, words: Words) -> np.ndarray:
    """The margin of each distinct word from the weights of subsequences."""
    total = np.zeros(len(words.symbols), np.float64)
    for place, key, weight in _found(words):
        total[place] += weight * table[key]
    if not len(total):
        return total
    return np.add.reduceat(total, words.first[:-1]) / _norms(words) + offset


def features(words: Words, margin: np.ndarray) -> np.ndarray:
    """Figures of each text: its largest margins, shares of words above levels, and its length."""
    own = np.minimum(margin[words.word], MOST)
    n = np.bincount(words.text, minlength=words.texts)
    order = np.lexsort((-own, words.text))
    rank = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    top = np.full((words.texts, TOP), -1.5)
    seen = rank < TOP
    top[words.text[order][seen], rank[seen]] = own[order][seen]
    shares = [np.log((np.bincount(words.text, own > level, words.texts) + 0.3) / (n + 20)) for level in LEVELS]
    return np.column_stack([top, np.maximum(top, 0), *shares, np.log1p(n)])


@dataclass(frozen=True)
class Model:
    """Landmarks with their weights, and the scale and weights of a text's figures; a few KB."""

    landmarks: Words
    alphas: np.ndarray
    offset: float
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """The weight of each subsequence of a landmark."""
        out = np.zeros(SYMBOLS**ORDER, np.float32)
        owner = np.repeat(np.arange(len(self.alphas)), np.diff(self.landmarks.first))
        alphas = self.alphas / _norms(self.landmarks)
        for place, key, weight in _found(self.landmarks):
            np.add.at(out, key, weight * alphas[owner[place]])
        return out

    def score(self, table: np.ndarray, texts: pa.Array) -> np.ndarray:
        words = Words.of(texts)
        figures = features(words, margins(table, self.offset, words))
        return _sigmoid((figures - self.mean) / self.scale @ self.weights + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pick(words: Words, picked: np.ndarray) -> Words:
    """Some of the distinct words alone."""
    n = np.diff(words.first)[picked]
    first = np.concatenate(([0], np.cumsum(n)))
    symbols = words.symbols[np.repeat(words.first[picked] - first[:-1], n) + np.arange(first[-1])]
    none = np.zeros(0, np.int64)
    return Words(symbols, first, none, none, none, 0)


def kernels(words: Words, landmarks: Words) -> np.ndarray:
    """The kernel of each distinct word with each landmark."""
    keys, owners, values = [], [], []
    owner, norm = np.repeat(np.arange(len(landmarks.first) - 1), np.diff(landmarks.first)), _norms(landmarks)
    for place, key, weight in _found(landmarks):
        keys.append(key)
        owners.append(owner[place])
        values.append(weight / norm[owner[place]])
    distinct, column = np.unique(np.concatenate(keys), return_inverse=True)
    of_landmarks = np.zeros((len(distinct), len(norm)), np.float32)
    np.add.at(of_landmarks, (column, np.concatenate(owners)), np.concatenate(values))
    place_of = np.full(SYMBOLS**ORDER, -1, np.int32)
    place_of[distinct] = np.arange(len(distinct))
    out = np.zeros((len(words.first) - 1, len(norm)), np.float32)
    norm = _norms(words)
    for a in range(0, len(out), 128):  # some words at a time
        part = _pick(words, np.arange(a, min(a + 128, len(out))))
        owner = np.repeat(np.arange(len(part.first) - 1), np.diff(part.first))
        hits = [(owner[p[hit]], place_of[k[hit]], np.full(hit.sum(), w)) for p, k, w in _found(part) for hit in [place_of[k] >= 0]]
        own, at, weight = (np.concatenate(c) for c in zip(*hits))
        if len(own):
            order = np.argsort(own, kind="stable")
            own = own[order]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            sums = np.add.reduceat(of_landmarks[at[order]] * weight[order, None].astype(np.float32), heads, axis=0)
            out[a + own[heads]] = sums / norm[a + own[heads], None]
    return out


def _machine(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Squared-hinge weights by Newton's method; each row counts as toxic and as clean so many times."""
    used = np.flatnonzero(toxic + clean > 0)
    p, q = toxic[used] / max(toxic.sum(), 1), clean[used] / max(clean.sum(), 1)
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-9
    weights = np.zeros(x.shape[1])
    for _ in range(8):
        gradient, curve = ridge * weights, np.diag(ridge)
        for a in range(0, len(used), 8192):  # some rows at a time
            rows = x[used[a : a + 8192]].astype(np.float64)
            f = rows @ weights
            short, over = p[a : a + 8192] * (f < 1), q[a : a + 8192] * (f > -1)
            gradient += rows.T @ (short * (f - 1) + over * (f + 1))
            curve += (rows * (short + over)[:, None]).T @ rows
        step = np.linalg.solve(curve, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6 * max(1, np.abs(weights).max()):
            break
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], RIDGE_P)
    ridge[-1] = 1e-9
    weights = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ weights)
        gradient = x.T @ (counts * (p - y)) + ridge * weights
        weights = weights - np.linalg.solve((x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), gradient)
    return weights[:-1], float(weights[-1])


def _landmarks(words: Words, toxic: np.ndarray, clean: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Distinct words as landmarks: half from toxic texts, a quarter from clean ones, by how surely their share of texts differs; the rest at random."""
    none, some = texts
    spread = np.sqrt((toxic + clean + 1) / (none + some) * (1 / none + 1 / some))
    differs = (toxic / some - clean / none) / spread
    able = np.flatnonzero(np.diff(words.first) >= ORDER + 2)
    order = able[np.argsort(-differs[able], kind="stable")]
    telling = order[: 3 * LANDMARKS]
    alike, own = kernels(_pick(words, telling), _pick(words, telling)) >= ALIKE, []
    for i in range(len(telling)):
        if len(own) < LANDMARKS // 2 and not alike[i, own].any():
            own.append(i)
    chosen = np.concatenate([telling[own], order[::-1][: LANDMARKS // 4], np.random.default_rng(SEED).permutation(able)])
    return chosen[np.sort(np.unique(chosen, return_index=True)[1])][:LANDMARKS]


def fit(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """Trains on texts labelled 1 (toxic) or 0; ``share`` is that of label 1 in all labelled rows. Without both labels, every text scores ``share``."""
    words = Words.of(pa.array(texts, pa.string()))
    y = np.asarray(labels, float)
    able = np.diff(words.first) >= ORDER + 2
    if not able.any() or not 0 < y.mean() < 1:
        width = 2 * TOP + len(LEVELS) + 1
        share = min(max(share, 0.001), 0.999)
        return Model(_pick(words, np.zeros(0, np.int64)), np.zeros(0), -1.0, np.zeros(width), np.ones(width), np.zeros(width), float(np.log(share / (1 - share))))
    distinct = len(words.first) - 1
    by_text = np.unique(words.text * distinct + words.word)  # a word counts once in a text
    toxic, clean = (np.bincount(by_text % distinct, y[by_text // distinct] == k, distinct) for k in (1, 0))
    landmarks = _pick(words, _landmarks(words, toxic, clean, np.bincount(y.astype(int))))
    values, vectors = np.linalg.eigh(kernels(landmarks, landmarks).astype(np.float64))
    sound = values > 1e-3 * values.max()
    whiten = vectors[:, sound] / np.sqrt(values[sound])
    x = np.ones((distinct, whiten.shape[1] + 1), np.float32)
    x[:, :-1] = kernels(words, landmarks) @ whiten.astype(np.float32)
    for turn in range(ROUNDS):
        if turn:
            toxic = np.bincount(_strongest(words, margin, y), minlength=distinct).astype(float)
        weights = _machine(x, toxic, clean)
        margin = x @ weights
    figures = features(words, margin)
    mean, scale = figures.mean(0), figures.std(0) + 1e-9
    counts = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    return Model(landmarks, whiten @ weights[:-1], float(weights[-1]), mean, scale, *_logistic((figures - mean) / scale, y, counts))


def _strongest(words: Words, margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The strongest word of each of the strongest sentences of each toxic text."""
    at = np.flatnonzero(y[words.text] == 1)
    by_sentence = at[np.lexsort((-margin[words.word[at]], words.sentence[at]))]
    best = by_sentence[np.diff(words.sentence[by_sentence], prepend=-1) != 0]
    best = best[np.lexsort((-margin[words.word[best]], words.text[best]))]
    n = np.bincount(words.text[best])
    rank = np.arange(len(best)) - np.repeat(np.cumsum(n) - n, n)
    return words.word[best[rank < STRONGEST]]


def held_out(doc_id: Column | None = None) -> Column:
    """One quarter of the documents, by the CRC of the id as text; a null id is not held out."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most ``sample`` labelled documents of either label that are not held out, picked by a hash of the id.

    Longer texts than ``sample_bytes`` are left out of the fit (not of the
    scores), so at most ``2 * sample * sample_bytes`` bytes reach the driver. Rows
    with a null id, label or text teach nothing; of ids with several labels the
    larger is used, and of repeated ids every text.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    fits = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= sample_bytes)
    rows = fits.join(F.broadcast(picked[0].union(picked[1])), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sample).collect()
    return fit([r.text for r in rows], np.array([r.toxic for r in rows], np.float64), share or 0.0)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in ta.slices(batches, "text"):
            table = model.table() if table is None else table
            yield batch.append_column("score", pa.array(model.score(table, batch.column("text"))))

    return run


def score_toxicity(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on).

    Reads nothing but ``text``, whole; a null or empty one, or one without a
    letter or digit, gets the score of a text without words. Rows stay as they are,
    repeated ones included; columns named ``score`` or ``predicted`` are replaced.
    One scan without a shuffle; an empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    schema = docs.withColumn("score", F.lit(0.0)).schema
    scored = docs.mapInArrow(_scorer(model), schema)
    scored = scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    return scored if keep_text else scored.drop("text")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
