"""Toxicity: gradient-boosted trees over dense text features, isotonic calibration.

Features of a text are rates, so length alone says nothing: words of the
lexicon (a fixed seed list, and words and word beginnings learned from
labelled texts), their nearness to second-person words, capitals, punctuation,
and obfuscated spellings. Trees are fitted to logistic loss on a bounded
sample of labelled rows; an isotonic curve, fitted on rows that the trees did
not see, turns their sum into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, texts_of
from .encoding import forget

#: Labelled rows that a model is fitted on at most: half for the lexicon, the
#: rest for trees and curve.
SAMPLE_ROWS = 24_000
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 48

# Seed insults and second-person words of four languages.
SEED_INSULTS = (
    "idiot idiots moron morons stupid dumb pathetic worthless disgusting loser losers scum trash garbage clown clowns fool imbecile "
    "filth vermin hate kill die bastard jerk "
    "imbécile crétin salaud ordure minable dégage débile "
    "dummkopf abschaum arschloch widerlich trottel versager "
    "imbécil estúpido basura asqueroso inútil payaso tonto"
).split()
SECOND_PERSON = "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti usted ustedes vosotros".split()

PREFIXES = range(4, 9)
NEAR = 5
#: Digits read as the letters they stand for in obfuscated spellings.
LEET = bytes.maketrans(b"0134578", b"oieastb")
ODD_INSIDE = re.compile(rb"[A-Za-z][*@$#0-9]+(?=[A-Za-z])")
MARKS = re.compile(rb"[!?]")


def _table() -> bytes:
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table = bytearray(b" " * 256)
    for b in keep:
        table[b] = b
    return bytes(table)


TABLE = _table()


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(TABLE).split()


def entries_of(word: bytes) -> list[bytes]:
    """The word and its beginnings (marked by ``*``), as lexicon entries."""
    text = word.decode("utf-8", "ignore")
    return [word, *(text[:k].encode() + b"*" for k in PREFIXES if len(text) >= k)]


class WordTraits(dict):
    """Memo: word → index into rows of (seed, weight, beginning's weight, second person, obfuscated)."""

    limit = 150_000

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon
        self.seed = {w.encode() for w in SEED_INSULTS}
        self.second = {w.encode() for w in SECOND_PERSON}
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((0, 5))

    def traits(self, word: bytes) -> tuple:
        plain = word
        if not word.isalpha() and not word.isdigit() and word.isalnum():
            plain = word.translate(LEET)
        lexicon = self.lexicon
        best = max((lexicon.get(e, 0.0) for e in entries_of(plain)[1:]), default=0.0)
        seed, weight = float(plain in self.seed), lexicon.get(plain, 0.0)
        hidden = float(plain != word and (seed > 0 or weight > 0 or best > 0))
        return (seed, round(weight, 2), round(best, 2), float(word in self.second), hidden)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        row = self.traits(word)
        at = self.rows.setdefault(row, len(self.rows))
        if at == len(self.table):
            self.table = np.vstack([self.table, row])
        self[word] = at
        return at


FEATURES = (
    "seed_rate",
    "lexicon_rate",
    "lexicon_weight",
    "beginning_rate",
    "beginning_weight",
    "hits_log",
    "near_second",
    "second_rate",
    "capitals",
    "capital_words",
    "punctuation",
    "marks",
    "odd_inside",
    "hidden_rate",
    "repeats",
    "words_log",
)


def features_of(text: str, traits: WordTraits) -> list[float]:
    """The dense features of one whole text; all 0 for an empty one."""
    words = words_of(text)
    if not words:
        return [0.0] * len(FEATURES)
    n, raw = len(words), text.encode("utf-8", "replace")
    row = np.fromiter(map(traits.__getitem__, words), np.int64, n)
    counts = np.bincount(row, minlength=len(traits.table))
    t = traits.table[: len(counts)]
    seed, weight, start, second, hidden = (counts * t[:, i] for i in range(5))
    flagged = (t[:, 0] > 0) | (t[:, 1] > 0) | (t[:, 2] > 0)
    hits = counts[flagged].sum()
    near = 0
    if hits and second.sum():
        at, you = np.flatnonzero(flagged[row]), np.flatnonzero(t[row, 3] > 0)
        right = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(you[np.maximum(right - 1, 0)] - at))
        near = int((gap <= NEAR).sum())
    upper = sum(map(raw.count, _UPPER))
    letters = max(1, len(text))
    return [
        100 * seed.sum() / n,
        100 * counts[t[:, 1] > 0].sum() / n,
        100 * weight.sum() / n,
        100 * counts[t[:, 2] > 0].sum() / n,
        100 * start.sum() / n,
        math.log1p(hits),
        100 * near / n,
        100 * second.sum() / n,
        upper / letters,
        len(re.findall(rb"\b[A-Z]{3,}\b", raw)) / n if upper > 2 else 0.0,
        100 * sum(map(raw.count, _PUNCT)) / letters,
        100 * len(MARKS.findall(raw)) / letters,
        100 * len(ODD_INSIDE.findall(raw)) / n,
        100 * hidden.sum() / n,
        1 - len(set(words)) / n,
        math.log1p(n),
    ]


_UPPER = [bytes([b]) for b in range(65, 91)]
_PUNCT = [bytes([b]) for b in b".,;:*&%$#@|"]


@dataclass
class Model:
    """Lexicon, trees (feature, bin edge, leaf values by level) and calibration curve."""

    lexicon: dict[bytes, float]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    curve: tuple[np.ndarray, np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, edge, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[at, feature[node]] > edge[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a 50th of the uncalibrated one keeps ranks inside a step."""
        m = self.margin(x)
        return 0.98 * np.interp(m, *self.curve) + 0.02 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Second-order boosting of logistic loss over binned features, fixed depth."""
    p = min(max(y.mean() if len(y) else 0.1, 1e-3), 1 - 1e-3)
    base, trees = math.log(p / (1 - p)), []
    if len(y) < 20 or y.min() == y.max():
        return base, trees
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    margin = np.full(len(y), base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, edge, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS + 1)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                key = local * k + binned[:, f]
                gl, hl, cl = (np.bincount(key, w, width * k).reshape(width, k).cumsum(1) for w in (g, h, np.ones_like(g)))
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(cl < 4) | (ct - cl < 4)] = -1
                at = gain[:, :-1].argmax(1)
                got = gain[np.arange(width), at]
                for i in np.flatnonzero(got > best):
                    best[i], feature[first + i], edge[first + i], cut[first + i] = got[i], f, e[at[i]], at[i]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf_of = node - inner
        gs, hs = np.bincount(leaf_of, g, 2**DEPTH), np.bincount(leaf_of, h, 2**DEPTH)
        leaf = -RATE * gs / (hs + 1)
        margin += leaf[leaf_of]
        trees.append((feature, edge, leaf))
    return base, trees


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y on m by pooling neighbours: knots and values."""
    if not len(m):
        knots = np.linspace(-6, 6, 25)
        return knots, 1 / (1 + np.exp(-knots))
    # Rows of one margin are one point.
    at, of = np.unique(m, return_inverse=True)
    blocks: list[list[float]] = []  # value, weight, first and last margin
    for x, ones, rows in zip(at.tolist(), np.bincount(of, y).tolist(), np.bincount(of).tolist(), strict=True):
        blocks.append([ones / rows, rows, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, z = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + v * w) / (last[1] + w)
            last[1] += w
            last[3] = z
    knots = np.array([x for v, w, a, z in blocks for x in (a, z)])
    # A block of few rows says little: half a row of each label is added.
    values = np.array([(v * w + 0.5) / (w + 1) for v, w, *_ in blocks for _ in range(2)])
    return knots, np.maximum.accumulate(values)


def _entry_counts(df: DataFrame) -> DataFrame:
    """(entry, toxic, clean): rows of each label whose text has the entry."""

    def work(batches):
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for b in batches:
            for t, y in zip(texts_of(b), b.column("toxic").to_pylist(), strict=True):
                (toxic if y else clean).update({e for w in set(words_of(t)) for e in entries_of(w)})
        keys = [k for k in toxic | clean]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["entry", "toxic", "clean"])

    return df.select("text", "toxic").mapInArrow(work, "entry binary, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(df: DataFrame) -> dict[bytes, float]:
    """Entries far more frequent in toxic than in clean texts, with their log ratio.

    ``df`` is the bounded sample, so the entries of at least four of its toxic texts
    have a bound too.
    """
    n1, n0 = df.agg(F.coalesce(F.sum(F.col("toxic")), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n1 or not n0:
        return {}
    p1, p0 = (F.col("toxic") + 0.2) / n1, (F.col("clean") + 0.2) / n0
    p = (F.col("toxic") + F.col("clean")) / (n1 + n0)
    z = (p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    found = _entry_counts(df).where(F.col("toxic") >= 4).withColumns({"ratio": F.log(p1 / p0), "z": z}).where((F.col("ratio") > 1.6) & (F.col("z") > 4.5))
    return {bytes(r["entry"]): float(r["ratio"]) for r in found.select("entry", "ratio").collect()}


def _features(df: DataFrame, lexicon: dict[bytes, float], keep: str) -> DataFrame:
    def work(batches):
        traits = WordTraits(lexicon)
        for whole in batches:
            for b in slices(whole, "text"):
                x = np.array([features_of(t, traits) for t in texts_of(b)]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep.split()), pa.array(list(x), pa.list_(pa.float64()))], names=[*keep.split(), "features"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep.split())
    return df.select(*keep.split(), "text").mapInArrow(work, f"{kinds}, features array<double>")


def held_out(doc_id) -> F.Column:
    """True for the fifth of the documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``sample_rows`` labelled documents of ``df(doc_id, text)``.

    ``labels(doc_id, toxic)``; held-out ids, null ids, null labels and labels of no
    document are left out; of several labels of a document the largest holds, of
    several texts the least (a null text is empty). The sample is the documents whose
    ids hash lowest, so it is the same in every run.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(df.select("doc_id"), "doc_id", "left_semi")
    sample = known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(20))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows rows of two numbers: its size has a bound.
    found = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = materialise(found.groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text")), "toxic-sample")
    lexicon = learn_lexicon(rows.where(F.col("part") < 10))
    seen = _features(rows.where(F.col("part") >= 10), lexicon, "part toxic").collect()
    part, y = (np.array([r[c] for r in seen], float) for c in ("part", "toxic"))
    x = np.array([r["features"] for r in seen]).reshape(-1, len(FEATURES))
    trees = part < 17
    model = Model(lexicon, *fit_trees(x[trees], y[trees]), (np.zeros(0), np.zeros(0)))
    model.curve = isotonic(model.margin(x[~trees]), y[~trees])
    return model


def score(df: DataFrame, model: Model, keep: str | list[str] = "doc_id") -> DataFrame:
    """(keep..., score) of each row of ``df``; a null text counts as empty, and no
    column but the text goes into a score. Repeated rows get equal scores. A column
    ``score`` of ``df`` is replaced."""
    columns = [c for c in (keep.split() if isinstance(keep, str) else keep) if c != "score"]

    def work(batches):
        forget()
        traits = WordTraits(model.lexicon)
        for whole in batches:
            for b in slices(whole, "text"):
                x = np.array([features_of(t, traits) for t in texts_of(b)]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(model.score(x))], names=[*columns, "score"])

    quoted = [f"`{c}`" for c in columns]
    kinds = ", ".join(f"{q} {df.schema[c].dataType.simpleString()}" for c, q in zip(columns, quoted, strict=True))
    return df.select(*dict.fromkeys([*quoted, "`text`"])).mapInArrow(work, f"{kinds}, score double")
