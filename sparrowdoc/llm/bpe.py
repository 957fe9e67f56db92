"""BPE encoding by dynamic programming over prefixes, and decoding.

A vocabulary automaton (a trie with suffix links) gives, at each position of a
word, every token that ends there, the longest first. For every prefix exactly
one of them can be the last token of the prefix's encoding: the one whose
preceding prefix ends in a token it is compatible with. Two neighbouring
tokens are compatible when no merge across their border would have come before
the merges that formed them. Following the stored last tokens backwards from
the end of the word gives the exact ids, in time linear in the word's length.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import default_tokenizer, slices
from .encoding import SLICE, ChunkEncoder, byte_letters, joined

NEVER = 1 << 60


class PrefixBpe:
    """Encoder of byte words; the last byte of a word carries the end-of-word mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_mark: str = "</w>"):
        letters = byte_letters()
        symbol = {c: b for b, c in letters.items()} | {c + end_mark: b + 256 for b, c in letters.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        spell: dict[int, tuple[int, ...]] = {}
        for text, s in symbol.items():
            if text in vocab:
                spell[vocab[text]], self.born[vocab[text]] = (s,), -1
        for r, (a, b) in enumerate(merges):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), r)
            if both not in self.parts and both not in self.born:
                self.parts[both], self.born[both], spell[both] = (left, right), r, spell[left] + spell[right]
        self.single = {s[0]: t for t, s in spell.items() if len(s) == 1}
        self.length = {t: len(s) for t, s in spell.items()}
        self.right_spine: dict[int, list[tuple[int, int]]] = {}
        self.left_spine: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._automaton(spell)
        self.whole = {t for t in spell if self._merged(spell[t]) == [t]}
        self.ends = [[(t, self.length[t]) for t in chain if t in self.whole] for chain in self.ends]

    def _automaton(self, spell: dict[int, tuple[int, ...]]) -> None:
        """Trie of all tokens with suffix links; ``ends``: the tokens ending in a state, longest first."""
        step: list[dict[int, int]] = [{}]
        own = [-1]
        for t, s in spell.items():
            at = 0
            for c in s:
                nxt = step[at].get(c)
                if nxt is None:
                    nxt = step[at][c] = len(step)
                    step.append({})
                    own.append(-1)
                at = nxt
            own[at] = t
        link = [0] * len(step)
        ends: list[list[int]] = [[] for _ in step]
        queue = [0]
        for state in queue:
            for c, child in step[state].items():
                if state:
                    f = link[state]
                    while f and c not in step[f]:
                        f = link[f]
                    link[child] = step[f].get(c, 0)
                ends[child] = ([own[child]] if own[child] >= 0 else []) + ends[link[child]]
                queue.append(child)
        self.step, self.link, self.ends = step, link, ends

    def _merged(self, spelled: tuple[int, ...]) -> list[int]:
        """Plain merging of a spelling; only to tell which tokens spell themselves."""
        ids = [self.single[s] for s in spelled]
        while len(ids) > 1:
            r, i = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if r == NEVER:
                break
            ids[i : i + 2] = [next_id] if (next_id := self._joined(ids[i], ids[i + 1])) is not None else ids[i : i + 2]
        return ids

    @functools.cached_property
    def _made(self) -> dict[tuple[int, int], int]:
        return {p: t for t, p in self.parts.items()}

    def _joined(self, a: int, b: int) -> int | None:
        return self._made.get((a, b))

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that consumes it) down one edge of the token's merge tree."""
        out, dies = [], NEVER
        while True:
            out.append((token, dies))
            if token not in self.parts:
                return out
            dies = self.born[token]
            token = self.parts[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joint spelling ends in exactly these two."""
        found = self.pairs.get((left, right))
        if found is None:
            a = self.right_spine.get(left) or self.right_spine.setdefault(left, self._spine(left, 1))
            b = self.left_spine.get(right) or self.left_spine.setdefault(right, self._spine(right, 0))
            rank = self.rank
            # Of equal pairs the leftmost merges first, so a tie on the right side loses.
            found = not any((r := rank.get((x, y))) is not None and r < dx and r <= dy for x, dx in a for y, dy in b)
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """Ids of one non-empty word."""
        step, link, ends, pairs, compatible = self.step, self.link, self.ends, self.pairs, self.compatible
        last: list[int] = [-1]
        state, n = 0, len(word)
        for i in range(1, n + 1):
            c = word[i - 1] + 256 if i == n else word[i - 1]
            while state and c not in step[state]:
                state = link[state]
            state = step[state].get(c, 0)
            for t, size in ends[state]:
                before = i - size
                if before == 0:
                    last.append(t)
                    break
                p = last[before]
                ok = pairs.get((p, t))
                if ok is None:
                    ok = compatible(p, t)
                if ok:
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {word!r}")
        out = []
        while n:
            out.append(last[n])
            n -= self.length[last[n]]
        return out[::-1]


class PrefixEncoder(ChunkEncoder):
    """The chunk encoder with the ids of each word found by :class:`PrefixBpe`."""

    def __init__(self, path: str, **limits: int):
        super().__init__(path, **limits)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = PrefixBpe(model["vocab"], merges, model["end_of_word_suffix"])
        self.pieces = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.specials.items()}
        self.shown: dict[bytes, str] = {}

    def word_ids(self, word: str) -> list[int]:
        return self.bpe.encode(word.encode("utf-8", "surrogateescape"))

    def decode(self, ids: list[int]) -> str:
        """What the library's ``decode(ids, skip_special_tokens=False)`` gives: this
        tokenizer has no decoder, so the pieces stand side by side, a space between."""
        return " ".join(map(self.pieces.__getitem__, ids))

    def encode_shown(self, texts: pa.Array) -> tuple[list[bytes], list[str]]:
        """Ids of each text, and their decoded text, made of the chunks' decoded texts."""
        offsets, number, chunks = self.pieces_of(texts)
        known = self.known(chunks)
        shown = [self.shown[k] if k in self.shown else self._show(k) for k in known]
        raw = joined(offsets, pa.array(known, pa.binary()).take(number), b"")
        if not all(known):
            # A chunk of white space beyond ASCII has no ids, so nothing of it is decoded.
            stays = np.fromiter(map(bool, known), bool, len(known))[number.to_numpy()]
            offsets = pa.array(np.r_[0, np.cumsum(stays)][offsets.to_numpy()].astype(np.int32))
            number = number.filter(pa.array(stays))
        return raw.to_pylist(), joined(offsets, pa.array(shown, pa.string()).take(number), " ").to_pylist()

    def _show(self, ids: bytes) -> str:
        if len(self.shown) > self.memo_limit:
            self.shown.clear()
        found = self.shown[ids] = self.decode(array("I", ids).tolist())
        return found


@functools.lru_cache(maxsize=2)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode_decode(df: DataFrame, tokenizer: str | None = None, ids: bool = True) -> DataFrame:
    """Adds nothing to and drops no row of ``df(doc_id, text)``: one output row each.

    Returns doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids),
    decoded_sha256 (UTF-8), and with ``ids`` the ids (array<int>) and the decoded
    text themselves. A null text counts as empty: no ids, an empty decoded text.
    Repeated rows give repeated results; other columns of ``df`` are not read.
    """
    path = tokenizer or default_tokenizer()

    def work(batches):
        enc = prefix_encoder(path)
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                raw, shown = enc.encode_shown(b.column("text"))
                lists = [np.frombuffer(r, "<u4") for r in raw] if ids else []
                cols = [
                    b.column("doc_id"),
                    pa.array([len(r) // 4 for r in raw], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for s in shown], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols += [pa.array([x.astype("int32") for x in lists], pa.list_(pa.int32())), pa.array(shown, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if ids else ""
    return df.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
