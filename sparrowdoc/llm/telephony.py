"""Telephony audio in media columns: G.711 by lookup tables, ADPCM across blocks.

A clip is a RIFF/WAVE file in a binary column, mono: mu-law (format 7), A-law
(6), IMA ADPCM (17) or 16-bit PCM (1). Decoding gives 16-bit PCM, at 16 kHz
and stored as a WAVE file again. Companded bytes expand through tables of 256
entries; ADPCM steps through the samples of a block in order, but through many
blocks of a batch at once. Long clips are handled in pieces of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialise, rows_a_batch, slices

MULAW, ALAW, IMA_ADPCM, PCM = 7, 6, 17, 1
FORMATS = {"mulaw": MULAW, "alaw": ALAW, "ima_adpcm": IMA_ADPCM}
RATE = 8000
#: Bytes of an ADPCM block, and the unit payloads are padded to.
BLOCK = 576
PAD = 255
#: Bytes of payload that are decoded at a time.
PIECE = 1 << 20
#: Rows of an Arrow batch at most, as clips may be long.
BATCH_ROWS = 1000
#: Compression of stored media: zstd, and how hard.
LEVEL = "zstd:12"


@functools.cache
def mulaw_table() -> np.ndarray:
    """16-bit value of every mu-law byte (G.711)."""
    b = ~np.arange(256, dtype=np.int32) & 255
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


@functools.cache
def alaw_table() -> np.ndarray:
    """16-bit value of every A-law byte (G.711)."""
    b = np.arange(256, dtype=np.int32) ^ 0x55
    seg, low = b >> 4 & 7, (b & 15) << 4
    size = np.where(seg == 0, low + 8, low + 264 << np.maximum(seg - 1, 0))
    return np.where(b & 128, size, -size).astype(np.int16)


@functools.cache
def ima_steps() -> np.ndarray:
    """The 89 step sizes: each a tenth above the one before, as the standard rounds them."""
    # Fixed values of the IMA ADPCM standard.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        dtype=np.int32,
    )


@functools.cache
def ima_moves() -> tuple[np.ndarray, np.ndarray]:
    """For (step index * 16 + code): the change of the predictor, and the next step index."""
    step = ima_steps()[:, None]
    code = np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -size, size)
    turn = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)[None, :]
    after = np.clip(np.arange(89)[:, None] + turn, 0, 88)
    return change.astype(np.int32).ravel(), after.astype(np.int32).ravel()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (n, size) uint8 → (n, 2 * (size - 4) + 1) int16."""
    n, size = blocks.shape
    change, after = ima_moves()
    codes = np.empty((2 * (size - 4), n), np.int32)
    body = blocks[:, 4:].T
    codes[0::2] = body & 15
    codes[1::2] = body >> 4
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        at = index * 16 + code
        value = np.clip(value + change[at], -32768, 32767)
        index = after[at]
        out[k] = value
    return out.T


def resample_double(pcm: np.ndarray, before: int | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """The samples and, between them, a 4-tap half-band estimate: twice the rate. A piece of a
    longer sound takes the sample before it and up to two after it; the ends repeat their last sample."""
    if not len(pcm):
        return pcm
    after = pcm[:0] if after is None else after[:2]
    x = np.concatenate([[pcm[0] if before is None else before], pcm, after]).astype(np.int32)
    x = np.pad(x, (0, 2 - len(after)), mode="edge")
    between = np.clip(9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8 >> 4, -32768, 32767)
    out = np.empty(2 * len(pcm), "<i2")
    out[0::2], out[1::2] = pcm, between
    return out


def wave(data: bytes, kind: int, rate: int = RATE) -> bytes:
    """A mono WAVE file around ``data``."""
    bits, block, a_second = {PCM: (16, 2, 2 * rate), IMA_ADPCM: (4, BLOCK, rate * BLOCK // (2 * (BLOCK - 4) + 1))}.get(kind, (8, 1, rate))
    form = struct.pack("<HHIIHH", kind, 1, rate, a_second, block, bits)
    if kind == IMA_ADPCM:
        form += struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1)
    elif kind != PCM:
        form += struct.pack("<H", 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass(frozen=True)
class Clip:
    kind: int
    rate: int
    block: int
    data: bytes


def parse_wave(media: bytes) -> Clip:
    """Format, rate, block size and data of a WAVE file; chunks may come in any number.
    ValueError says what of it isn't telephony audio."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            if size < 16 or at + 24 > len(media):
                raise ValueError("the format chunk is cut short")
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None:
                raise ValueError("no format before the data")
            kind, channels, rate, _, block, bits = form
            if kind not in (MULAW, ALAW, IMA_ADPCM, PCM) or (kind == PCM and bits != 16):
                raise ValueError(f"format {kind} of {bits} bits is not telephony audio")
            if channels != 1:
                raise ValueError(f"{channels} channels")
            if rate not in (RATE, 2 * RATE):
                raise ValueError(f"rate {rate}")
            if at + 8 + size > len(media):
                raise ValueError("the data are cut short")
            if kind == IMA_ADPCM and (block < 5 or size % block):
                raise ValueError(f"{size} bytes are no ADPCM blocks of {block}")
            if kind == PCM and size % 2:
                raise ValueError("half a sample")
            return Clip(kind, rate, block, media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no data in the WAVE file")


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled with 255 up to a positive multiple of the block size."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


CODECS = tuple(FORMATS)


def codec_of(payload: bytes) -> str:
    """The codec of a payload that may take any: by its checksum, so equal texts have the same."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def store_text(df: DataFrame, codec: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text of ``df(doc_id, text)`` as a clip.

    The text's bytes are the clip's samples (mulaw, alaw) or ADPCM blocks,
    unchanged, so nothing is lost; without a ``codec`` the text's bytes tell it.
    Null counts as the empty text; repeated rows give repeated clips.
    """

    def work(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                media = [wave(p, FORMATS[codec or codec_of(p)]) for p in map(payload_of, texts)]
                n = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind_of_id = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(work, f"doc_id {kind_of_id}, n_bytes long, media binary")


def samples_of(clips: list[Clip]) -> list[np.ndarray]:
    """The clips' 16-bit samples. ADPCM blocks of one size are decoded together, ``PIECE`` bytes at a time."""
    out: list = [None] * len(clips)
    blocks: dict[int, list] = {}
    for i, c in enumerate(clips):
        raw = np.frombuffer(c.data, np.uint8)
        if c.kind == MULAW:
            out[i] = mulaw_table()[raw]
        elif c.kind == ALAW:
            out[i] = alaw_table()[raw]
        elif c.kind == PCM:
            out[i] = raw.view("<i2")
        else:
            blocks.setdefault(c.block, []).append((i, raw.reshape(-1, c.block)))
    for size, found in blocks.items():
        every = np.concatenate([x for _, x in found])
        step = max(1, PIECE // size)
        pcm = np.concatenate([decode_ima(every[at : at + step]) for at in range(0, len(every), step)] or [np.empty((0, 2 * (size - 4) + 1), np.int16)])
        at = 0
        for i, x in found:
            out[i] = pcm[at : at + len(x)].ravel()
            at += len(x)
    return out


def features(clip: Clip, x: np.ndarray) -> str:
    """What the decoded sound is like, as short text: format, number of samples, loudness
    (of exact sums), peak and sign changes."""
    pieces = range(0, len(x), PIECE)
    energy = sum(int((x[a : a + PIECE].astype(np.int64) ** 2).sum()) for a in pieces)
    peak = max((int(np.abs(x[a : a + PIECE].astype(np.int32)).max()) for a in pieces), default=0)
    turns = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return f"format={clip.kind};n={len(x)};rms={(energy / max(1, len(x))) ** 0.5:.3f};peak={peak};turns={turns}"


def doubled(x: np.ndarray) -> np.ndarray:
    """:func:`resample_double` of a long sound, piece by piece."""
    parts = [resample_double(x[a : a + PIECE], x[a - 1] if a else None, x[a + PIECE : a + PIECE + 2]) for a in range(0, len(x), PIECE)]
    return np.concatenate(parts) if parts else x.astype("<i2")


def at_16k(clip: Clip, x: np.ndarray) -> np.ndarray:
    """The samples at 16 kHz; 8 kHz sounds are resampled."""
    return x.astype("<i2") if clip.rate == 2 * RATE else doubled(x)


def split_pcm(x: np.ndarray) -> tuple[bytes, bytes]:
    """16-bit samples in two parts: every other one, and what the ones between differ from the
    half-band estimate of these. Nothing is lost; what was resampled differs by 0."""
    even = x[0::2]
    estimate = doubled(even)[1::2][: len(x) // 2]
    return even.astype("<i2").tobytes(), (x[1::2] - estimate).astype("<i2").tobytes()


def join_pcm(even: bytes, rest: bytes) -> np.ndarray:
    """The samples that :func:`split_pcm` split."""
    e, r = np.frombuffer(even, "<i2"), np.frombuffer(rest, "<i2")
    out = np.empty(len(e) + len(r), "<i2")
    out[0::2] = e
    out[1::2] = doubled(e)[1::2][: len(r)] + r
    return out


def decode_media(df: DataFrame, pcm: str | None = "wave") -> DataFrame:
    """Reads clips of ``df(doc_id, n_bytes, media)`` and decodes them.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the
    last 32 bytes), media_bytes, media_sha256, feature, error, and the 16 kHz PCM:
    for ``pcm`` "wave" as a WAVE file ``pcm``, for "split" in the two parts ``pcm_even``
    and ``pcm_rest`` of :func:`split_pcm`, which compress better. A clip that is no
    mono telephony audio of 8 or 16 kHz has its own size and checksum, what is wrong
    with it in ``error``, and nulls; a null clip gives nulls. Other columns of ``df`` are not read, repeated rows give
    repeated results, an empty table gives none.
    """
    sounds = {None: [], "wave": ["pcm"], "split": ["pcm_even", "pcm_rest"]}[pcm]

    def work(batches):
        for whole in batches:
            for b in slices(whole, "media", PIECE):
                media = b.column("media").to_pylist()
                clips, errors = [], []
                for m in media:
                    try:
                        clip, error = (None, None) if m is None else (parse_wave(m), None)
                    except ValueError as e:
                        clip, error = None, str(e)
                    clips.append(clip)
                    errors.append(error)
                sound = iter(samples_of([c for c in clips if c]))
                rows = []
                for m, c, error in zip(media, clips, errors, strict=True):
                    file = [None, None] if m is None else [len(m), hashlib.sha256(m).hexdigest()]
                    if c is None:
                        rows.append([None, None, None, *file, None, error, *[None] * len(sounds)])
                        continue
                    x = next(sound)
                    stored = () if pcm is None else split_pcm(at_16k(c, x)) if pcm == "split" else (wave(at_16k(c, x).tobytes(), PCM, 2 * RATE),)
                    rows.append([len(c.data), hashlib.sha256(c.data).hexdigest(), zlib.crc32(c.data[-32:]), *file, features(c, x), None, *stored])
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * len(sounds)]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", *sounds]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], names=["doc_id", "n_bytes", *names])

    kind = df.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} binary" for c in sounds)
    return df.select("doc_id", "n_bytes", "media").mapInArrow(
        work, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string{more}"
    )


def pcm_checksums(df: DataFrame) -> DataFrame:
    """(all other columns, pcm_samples, pcm_crc32) of sounds ``df(pcm_even, pcm_rest, ...)`` read back and joined."""
    others = [f for f in df.schema.fields if f.name not in ("pcm_even", "pcm_rest")]

    def work(batches):
        for whole in batches:
            for b in slices(whole, "pcm_even", PIECE):
                parts = zip(b.column("pcm_even").to_pylist(), b.column("pcm_rest").to_pylist(), strict=True)
                found = [(None, None) if e is None else (len(x := join_pcm(e, r)), zlib.crc32(x.tobytes())) for e, r in parts]
                cols = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), *cols], names=[*(f.name for f in others), "pcm_samples", "pcm_crc32"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return df.select(*(f"`{f.name}`" for f in others), "pcm_even", "pcm_rest").mapInArrow(work, f"{kinds}, pcm_samples long, pcm_crc32 long")


def store_and_decode(df: DataFrame) -> DataFrame:
    """Stores each text of ``df(doc_id, text)`` as a clip and each clip's 16 kHz PCM, in two tables of the
    shared folder, and returns what :func:`decode_media` and :func:`pcm_checksums` read from them."""
    with rows_a_batch(df.sparkSession, BATCH_ROWS):
        media = materialise(store_text(df), "media", LEVEL)
        sounds = materialise(decode_media(media, "split"), "sounds", LEVEL)
    return pcm_checksums(sounds)
