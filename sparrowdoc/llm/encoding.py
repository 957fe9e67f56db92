"""Batch encoding with a word-level BPE tokenizer, memoised by white-space chunk.

The tokenizer never forms a token across white space, so the ids of a text are
the ids of its white-space chunks, one after the other. Natural text repeats
its chunks, so each distinct one is worked out once for a worker; cutting the
texts, numbering the chunks and joining their ids is columnar.
"""

from __future__ import annotations

import functools
import gc
import re
import sys
from array import array

import pyarrow as pa
import pyarrow.compute as pc

from .common import one_thread, release

#: Chunks held before the memo ages; the generation before it is kept too.
MEMO_LIMIT = 300_000
WORD_LIMIT = 150_000
#: Bytes of text encoded together: the more, the fewer distinct chunks a byte.
SLICE = 16 << 20
#: Below U+0250, white space beyond ASCII and the letter whose lower case isn't one character.
RARE = re.compile("[\x85\xa0İ]")
#: The tokenizer's own pattern, for lower-cased chunks without white space
#: whose characters are all below U+0250 (where NFC changes nothing).
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|[\W_]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ChunkEncoder:
    """Exact ids of whole texts as little-endian unsigned 32-bit bytes.

    ``word_ids`` gives the ids of one pre-token; the default asks the
    library's BPE model. Chunks outside the simple alphabet go through the
    library's normaliser and pre-tokenizer.
    """

    def __init__(self, path: str, memo_limit: int = MEMO_LIMIT, word_limit: int = WORD_LIMIT):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.letters = {b: c for b, c in byte_letters().items()}
        self.memo: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.memo_limit, self.word_limit = memo_limit, word_limit

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token, given as ordinary characters."""
        raw = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(raw)]

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.word_limit:
                self.words.clear()
            found = self.words[word] = packed(self.word_ids(word))
        return found

    def _any(self, text: str) -> bytes:
        """Any text: special tokens first, then the library's normaliser and pre-tokenizer."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [self._segment(text[at : m.start()]), packed([self.specials[m[0]]])]
            at = m.end()
        return b"".join([*out, self._segment(text[at:])])

    def _segment(self, text: str) -> bytes:
        if not text:
            return b""
        text = self.tokenizer.normalizer.normalize_str(text)
        back = self.back
        return b"".join(self._word(bytes(map(back.__getitem__, w)).decode("utf-8", "surrogateescape")) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    @functools.cached_property
    def back(self) -> dict[str, int]:
        return {c: b for b, c in self.letters.items()}

    def _chunk(self, chunk: str) -> bytes:
        if (chunk.isascii() or (max(chunk) < "ɐ" and not RARE.search(chunk))) and "<|" not in chunk:
            chunk = chunk.lower()
            if chunk.isalpha():
                return self._word(chunk)
            return b"".join(map(self._word, WORDS.findall(chunk)))
        return self._any(chunk)

    def pieces_of(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, list[str]]:
        """Offsets of the texts' chunks, each chunk's number, and the distinct chunks."""
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.fill_null("")))
        coded = lists.flatten().dictionary_encode()
        return lists.offsets, coded.indices, coded.dictionary.to_pylist()

    def known(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, through the memo and the generation before it."""
        memo = self.memo
        if len(memo) + len(chunks) > self.memo_limit:
            self.aged, memo = memo, {}
            self.memo = memo
        aged, out = self.aged, []
        for c in chunks:
            found = memo.get(c)
            if found is None:
                found = memo[c] = aged[c] if c in aged else self._chunk(c)
            out.append(found)
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        """Binary array with each text's ids; the same as ``Tokenizer.encode``. Null is empty."""
        offsets, number, chunks = self.pieces_of(texts)
        return joined(offsets, pa.array(self.known(chunks), pa.binary()).take(number), b"")


def joined(offsets: pa.Array, pieces: pa.Array, between: bytes | str) -> pa.Array:
    """The pieces of each list, one after the other."""
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pieces), between)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder; it outlives a task, so later tasks find a warm memo."""
    return ChunkEncoder(path)


def forget() -> None:
    """Frees the memo of a worker that goes on with another operator, and gives freed memory back."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
    release()
