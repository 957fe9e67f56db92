"""License scan by diagonal voting.

Every rolling word k-gram of a text is hashed and joined with the k-grams of
the templates. A hit at word p of the text and word q of a template votes for
the diagonal p - q, if their words are the same and not the hashes alone. Votes
are gathered for each diagonal, neighbouring diagonals (words put in or left out)
are merged into spans, and a span is accepted when the verified words in it are
enough of its template: all of it for the base phrases.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

K = 2
#: Diagonals this close belong to one span.
NEAR = 3
#: Part of a template's k-grams that a span of an ordinary template must have.
COVER = 0.6
#: The sentinel gram each text ends with; it hits template 0 and carries the text's length.
SENTINEL = 0


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


#: The base phrases, and short notices in common use.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("mit", "licensed under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "this work is licensed under a creative commons attribution license"),
    Template("cc-by-sa", "licensed under cc by sa"),
    Template("public-domain", "this work is in the public domain"),
)


def _word_table() -> bytes:
    """Byte → itself lower-cased where it is part of a word, else a space."""
    word = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table = bytearray(b" " * 256)
    for b in word:
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    return bytes(table)


WORD_TABLE = _word_table()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, in UTF-8."""
    return (text or "").encode().translate(WORD_TABLE).split()


class WordHash(dict):
    """Memo of 64-bit word hashes; starts afresh when it holds ``limit`` words."""

    limit = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; empty where there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def grams(text: str | None, memo: WordHash, k: int = K) -> tuple[int, np.ndarray]:
    words = words_of(text)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return len(words), rolling(h, k)


def template_grams(spark: SparkSession, templates: tuple[Template, ...], k: int = K) -> DataFrame:
    """(gram, words, template, q): where each k-gram stands in the templates; a fixed, small table."""
    return spark.createDataFrame([(SENTINEL, b"", 0, 0), *_template_rows(templates, k)], "gram long, words binary, template int, q int")


def _template_rows(templates: tuple[Template, ...], k: int) -> list[tuple[int, bytes, int, int]]:
    memo = WordHash()
    return [
        (int(g), b" ".join(words[q : q + k]), t, q) for t, x in enumerate(templates, 1) for words in (words_of(x.text),) for q, g in enumerate(grams(x.text, memo, k)[1].view(np.int64))
    ]


def text_grams(df: DataFrame, wanted: np.ndarray, k: int = K) -> DataFrame:
    """(row, doc_id, p, gram, words): the rolling k-grams of each text, then the sentinel at
    p = number of words. Grams whose hash is among ``wanted`` (sorted) come with their words."""

    def work(batches):
        memo = WordHash()
        for whole in batches:
            for b in slices(whole, "text"):
                found, at, held, base = [], [], [], 0
                for t in b.column("text").to_pylist():
                    words = words_of(t)
                    g = rolling(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), k).view(np.int64)
                    hits = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)] == g).tolist() if len(wanted) else []
                    at += [base + i for i in hits] + [base + len(g)]
                    held += [b" ".join(words[i : i + k]) for i in hits] + [b""]
                    found.append((len(words), g))
                    base += len(g) + 1
                sizes = np.fromiter((len(g) + 1 for _, g in found), np.int64, len(found))
                ends = np.cumsum(sizes)
                p = np.arange(base) - np.repeat(ends - sizes, sizes)
                p[ends - 1] = [n for n, _ in found]
                gram = np.concatenate([x for _, g in found for x in (g, np.zeros(1, np.int64))])
                of = pa.array(np.repeat(np.arange(len(found)), sizes))
                place = np.full(base, -1)
                place[at] = np.arange(len(at))
                words_at = pa.array(held, pa.binary()).take(pa.array(place, mask=place < 0))
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(of), b.column("doc_id").take(of), pa.array(p.astype(np.int32)), pa.array(gram), words_at], names=["row", "doc_id", "p", "gram", "words"]
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(work, f"row long, doc_id {kind}, p int, gram long, words binary")


def votes(df: DataFrame, templates: tuple[Template, ...], k: int = K) -> DataFrame:
    """(row, doc_id, votes): for each text the diagonals that its k-grams and a template's agree on,
    in hash and in words: (template, diagonal, first, last, qs). Template 0 has the text's length as diagonal."""
    wanted = np.unique(np.array([g for g, *_ in _template_rows(templates, k)], np.int64))
    hits = text_grams(df, wanted, k).join(F.broadcast(template_grams(df.sparkSession, templates, k)), ["gram", "words"])
    # One exchange by row serves both groupings.
    by_diagonal = hits.repartition("row").groupBy("row", "doc_id", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("q").alias("qs")
    )
    return by_diagonal.groupBy("row", "doc_id").agg(F.collect_list(F.struct("template", "diagonal", "first", "last", "qs")).alias("votes"))


def merged(found: list[dict], templates: tuple[Template, ...], k: int = K, near: int = NEAR, cover: float = COVER) -> list[tuple[int, int, int, float]]:
    """Accepted spans (template, first, last, covered) of one text's votes, in order.

    A base phrase stands where one diagonal has all its k-grams. Neighbouring
    diagonals of another template make a span, no more words of the text apart in all
    than the template has; it is accepted if it has enough of the template's k-grams.
    """
    lengths = [len(words_of(x.text)) for x in templates]
    out = []
    runs: dict[int, list] = {}

    def close(t: int) -> None:
        _, _, first, last, qs = runs.pop(t)
        covered = len(qs) / max(1, lengths[t - 1] - k + 1)
        if covered >= cover:
            out.append((t, first, last + k - 1, covered))

    for v in sorted(found, key=lambda v: (v["template"], v["diagonal"])):
        t, d = v["template"], v["diagonal"]
        if not t:
            continue
        if templates[t - 1].base:
            if len(v["qs"]) == max(1, lengths[t - 1] - k + 1):
                out.append((t, d, d + lengths[t - 1] - 1, 1.0))
            continue
        if t in runs and (d - runs[t][1] > near or d - runs[t][0] > lengths[t - 1]):
            close(t)
        if t in runs:
            _, _, first, last, qs = runs[t]
            runs[t][1:] = [d, min(first, v["first"]), max(last, v["last"]), qs | set(v["qs"])]
        else:
            runs[t] = [d, d, v["first"], v["last"], set(v["qs"])]
    for t in list(runs):
        close(t)
    return sorted(out)


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """One row for each row of ``df(doc_id, text)``; null text counts as empty.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (smallest and largest start of a base place, else null),
    base_labels and labels (distinct, sorted, comma-joined; "" if none), score
    (the best cover of any template) and spans (template, first, last, covered),
    in order. Other columns of ``df`` are not read; repeated rows are scanned each;
    an empty table gives none. Texts are read once; a text's votes meet in one task.
    """
    label = lambda found: ",".join(sorted({templates[t - 1].label for t in found}))

    def work(batches):
        for b in batches:
            rows = []
            for found in b.column("votes").to_pylist():
                spans = merged(found, templates, k, near, cover)
                at = [first for t, first, *_ in spans if templates[t - 1].base]
                n_words = next(v["diagonal"] for v in found if not v["template"])
                shown = [dict(zip(("template", "first", "last", "covered"), s, strict=True)) for s in spans]
                labels = (label(t for t, *_ in spans if templates[t - 1].base), label(t for t, *_ in spans))
                rows.append((n_words, len(at), min(at, default=None), max(at, default=None), *labels, max((s[3] for s in spans), default=0.0), shown))
            span = pa.struct([("template", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("covered", pa.float64())])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", *names])

    kind = df.schema["doc_id"].dataType.simpleString()
    return votes(df, templates, k).mapInArrow(
        work,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<template:int,first:int,last:int,covered:double>>",
    )
