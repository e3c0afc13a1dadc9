"""Operator 3: telephony audio in media columns.

Containers are RIFF/WAVE files of 8 kHz mono audio in one of three codings, all written and read here: A-law (6),
mu-law (7) and IMA ADPCM (17). Mu-law and A-law expand by lookup tables; ADPCM blocks are independent of one
another, so one numpy step decodes the same sample of every block of a whole batch. The decoded audio is resampled
to 16 kHz by a half-band filter and stored as 16-bit PCM. `encode` makes a column of files, `read` takes such a column
(from wherever it is stored) and gives the PCM column and its features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .store import written

A_LAW, MU_LAW, ADPCM, PCM = 6, 7, 17, 1
CODINGS = (MU_LAW, A_LAW, ADPCM)
NAMES = {MU_LAW: "mu-law", A_LAW: "a-law", ADPCM: "adpcm", PCM: "pcm"}
RATE_IN, RATE_OUT, BLOCK = 8000, 16000, 64
#: Samples on each side from which a new one between two is made, and the bits of the filter's fixed point.
REACH, POINT = 8, 14
#: Fixed values of the IMA ADPCM format: how the step index moves by the low three bits of a code.
INDEX_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Fixed values of the IMA ADPCM format: its step sizes.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876,
    963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


def mu_law_table() -> np.ndarray:
    """PCM of each mu-law byte, by the coding's definition: inverted bits, sign, exponent, mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """PCM of each A-law byte: even bits inverted, sign (set is positive), exponent, mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n x BLOCK bytes) -> PCM (n x samples): a header of predictor and step index, then two codes a byte, low first."""
    steps, moves = np.array(STEPS, dtype=np.int32), np.array(INDEX_MOVES * 2, dtype=np.int32)
    level = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1)
    codes = np.ascontiguousarray(codes.T)
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = level
    for i, code in enumerate(codes):
        step = steps[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        level = np.clip(level + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + moves[code], 0, len(STEPS) - 1)
        out[i + 1] = level
    return np.ascontiguousarray(out.T)


def wrap(payload: bytes, coding: int, rate: int = RATE_IN) -> bytes:
    """A RIFF/WAVE file with the payload as its data chunk."""
    bits, align = {ADPCM: (4, BLOCK), PCM: (16, 2)}.get(coding, (8, 1))
    extra = struct.pack("<HH", 2, (BLOCK - 4) * 2 + 1) if coding == ADPCM else struct.pack("<H", 0)
    per_second = rate * 2 if coding == PCM else rate if coding != ADPCM else rate * BLOCK // ((BLOCK - 4) * 2 + 1)
    fmt = struct.pack("<HHIIHH", coding, 1, rate, per_second, align, bits) + extra
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes) -> tuple[int, int, bytes]:
    """Coding, rate and payload of a file; ValueError where it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, coding, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            coding, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if coding is None or at + 8 + size > len(media):
                raise ValueError("damaged RIFF/WAVE file")
            return coding, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(codings: list[int], payloads: list[bytes]) -> list[np.ndarray]:
    """PCM of each payload; all ADPCM blocks of the batch are decoded together."""
    tables = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(payloads)
    packed = [i for i, c in enumerate(codings) if c == ADPCM]
    if packed:
        parts = [np.frombuffer(payloads[i][: len(payloads[i]) // BLOCK * BLOCK], np.uint8).reshape(-1, BLOCK) for i in packed]
        pcm = decode_adpcm(np.concatenate(parts))
        at = 0
        for i, p in zip(packed, parts, strict=True):
            out[i] = pcm[at : at + len(p)].reshape(-1)
            at += len(p)
    for i, c in enumerate(codings):
        if c in tables:
            out[i] = tables[c][np.frombuffer(payloads[i], np.uint8)]
        elif c == PCM:
            out[i] = np.frombuffer(payloads[i], "<i2")
        elif c != ADPCM:
            raise ValueError(f"unknown coding {c}")
    return out


def filter_taps() -> np.ndarray:
    """Weights of the nearest, second nearest, ... samples on either side of a new one: a sinc under a Hann window, in
    fixed point, whose sum over both sides is exactly one."""
    at = np.arange(REACH) + 0.5
    taps = np.sinc(at) * (0.5 + 0.5 * np.cos(np.pi * at / (REACH + 0.5)))
    taps = np.round(taps / taps.sum() * (1 << (POINT - 1))).astype(np.int32)
    taps[0] += (1 << (POINT - 1)) - taps.sum()
    return taps


_TAPS = filter_taps()


def resample(pcm: np.ndarray) -> np.ndarray:
    """8 kHz -> 16 kHz: given samples stay, and a half-band filter makes one after each; beyond the ends they are held."""
    n = len(pcm)
    out = np.empty(2 * n, dtype="<i2")
    if n:
        x = np.pad(pcm.astype(np.int32), (REACH, REACH + 1), mode="edge")
        total = np.full(n, 1 << (POINT - 1), dtype=np.int32)
        for j, tap in enumerate(_TAPS):
            total += tap * (x[REACH - j : REACH - j + n] + x[REACH + 1 + j : REACH + 1 + j + n])
        out[::2] = pcm
        out[1::2] = np.clip(total >> POINT, -32768, 32767)
    return out


def encode(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text, more) -> doc_id, n_bytes, media: a telephone recording of each text's bytes.

    The UTF-8 bytes, padded with 0 to a positive multiple of 64, are the coded samples of a RIFF/WAVE file; the
    payload's crc32 modulo 3 picks the coding, so that equal texts give equal files. Null counts as the empty text; rows
    come back one for one, repeated and null ids included; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.chunks(batch):
                whole, sizes, medias = data.tobytes(), np.diff(offsets), []
                for a, n in zip(offsets[:-1], sizes, strict=True):
                    raw = whole[a : a + n]
                    raw += b"\0" * (max(BLOCK, -(-n // BLOCK) * BLOCK) - n)
                    medias.append(wrap(raw, CODINGS[zlib.crc32(raw) % len(CODINGS)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(medias, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(stored: DataFrame, with_media: bool = False) -> DataFrame:
    """stored (doc_id, n_bytes, media, more) -> what reading each file back gives; a media that is no such file is an error.

    The file is parsed, its payload digested, its samples expanded and resampled to 16 kHz PCM. feature: coding, seconds,
    peak, root mean square and zero crossings of that PCM, and the first 16 hex digits of its sha256. With with_media the
    files (media) and the PCM files (pcm) come along. Files are decoded about a megabyte at a time, a longer one alone.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, pcm binary" * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.chunks(batch, "media"):
                whole = data.tobytes()
                medias = [whole[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                files = [unwrap(m) for m in medias]
                payloads, features, pcms = [p for _, _, p in files], [], []
                for (coding, _, _), pcm in zip(files, decode([c for c, _, _ in files], payloads), strict=True):
                    out = resample(pcm)
                    wide = out.astype(np.float32)
                    peak, loud = int(np.abs(out.astype(np.int32)).max()), int(round(float(np.sqrt(np.dot(wide, wide) / len(wide)))))
                    crossings = int(np.count_nonzero(np.signbit(wide[1:]) != np.signbit(wide[:-1])))
                    features.append(f"{NAMES[coding]};s={len(out) / RATE_OUT:.4f};peak={peak};rms={loud};zc={crossings};pcm={hashlib.sha256(out.tobytes()).hexdigest()[:16]}")
                    if with_media:
                        pcms.append(wrap(out.tobytes(), PCM, RATE_OUT))
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": part.column("n_bytes"),
                    "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    "tail_crc32": pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    "media_bytes": pa.array([len(m) for m in medias], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in medias]),
                    "feature": pa.array(features),
                } | ({"media": pa.array(medias, pa.binary()), "pcm": pa.array(pcms, pa.binary())} if with_media else {})
                yield pa.RecordBatch.from_pydict(columns)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def store(texts: DataFrame, with_media: bool = False) -> DataFrame:
    """The recordings of encode(), stored as a Parquet table in the shared folder, and what read() gives of that table.

    Null, blank, very long and repeated texts and null ids have a recording like any other; an empty table gives none.
    """
    return read(written(encode(texts), "media"), with_media)
