"""Token ids as directly addressable codes.

A text is encoded by a public byte-level BPE vocabulary (a rank file; its path is a parameter). The ids of a
document become one binary code: each id is cut into chunks of ``WIDTHS`` bits, the low bits first. Level k holds
the k-th chunks of the ids that have one, packed, and a bitmap that says which of them go on to level k + 1, with
a directory of ranks at every ``RANK_BITS`` bits. Reading token i takes one chunk of each level: its place in the
next level is the rank of its bit, one directory entry and a popcount of at most RANK_BITS bits. No block is decoded.

Layout (little-endian): magic "DAC1"; uint8 number of levels; uint8 width of each; uint32 number of ids on each
level; then for each level its chunks, and for all but the last its directory (uint32 each) and its bitmap.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, kind

VOCABULARY, WIDTHS, RANK_BITS, CACHE_WORDS = "/opt/tokenizers/byte_bpe_50k.tiktoken", (10, 7), 512, 500_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same split for texts of these signs alone, where Python's classes agree with the pattern's.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ɏ]*")
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Encoder(dict):
    """Byte strings of little-endian ids for pieces of text, made when first asked for."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = np.array(self.encoding.encode_ordinary(piece), self.kind).tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, as the tokenizer gives them."""
        if PLAIN.fullmatch(text):
            return np.frombuffer(b"".join(map(self.__getitem__, PIECE.findall(text))), self.kind)
        return np.array(self.encoding.encode_ordinary(text), self.kind)


def _pack(values: np.ndarray, width: int) -> bytes:
    if width == 8:
        return values.astype(np.uint8).tobytes()
    bits = (values.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The code of any sequence of ids that fit the widths together."""
    rest = np.asarray(ids, np.uint32)
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError("an id doesn't fit the widths")
    sizes, body = [], []
    for k, width in enumerate(widths):
        sizes.append(len(rest))
        body.append(_pack(rest & np.uint32((1 << width) - 1), width))
        if k + 1 < len(widths):
            rest = rest >> np.uint32(width)
            on = rest > 0
            blocks = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.uint32) if len(on) else np.zeros(0, np.uint32)
            body += [(np.cumsum(blocks, dtype=np.uint32) - blocks).astype("<u4").tobytes(), np.packbits(on, bitorder="little").tobytes()]
            rest = rest[on]
    return b"".join([b"DAC1", bytes([len(widths), *widths]), struct.pack(f"<{len(sizes)}I", *sizes), *body])


class Code:
    """Random access to the ids in a code."""

    def __init__(self, code: bytes):
        if code[:4] != b"DAC1":
            raise ValueError("not a code")
        self.code, n = memoryview(code), code[4]
        self.widths = tuple(code[5 : 5 + n])
        self.sizes = struct.unpack_from(f"<{n}I", code, 5 + n)
        at, self.parts = 5 + 5 * n, []
        for k, (width, size) in enumerate(zip(self.widths, self.sizes)):
            chunks, at = at, at + (width * size + 7) // 8
            ranks, at = at, at + (4 * (-(-size // RANK_BITS)) if k + 1 < n else 0)
            bits, at = at, at + ((size + 7) // 8 if k + 1 < n else 0)
            self.parts.append((chunks, ranks, bits))

    def __len__(self) -> int:
        return self.sizes[0] if self.sizes else 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for k, (width, (chunks, ranks, bits)) in enumerate(zip(self.widths, self.parts)):
            first = i * width
            low, high = chunks + first // 8, chunks + (first + width + 7) // 8
            value |= (int.from_bytes(self.code[low:high], "little") >> first % 8 & (1 << width) - 1) << shift
            shift += width
            if k + 1 == len(self.widths) or not self.code[bits + i // 8] >> i % 8 & 1:
                return value
            block = i // RANK_BITS
            inside = int.from_bytes(self.code[bits + block * RANK_BITS // 8 : bits + i // 8 + 1], "little")
            inside &= (1 << i - block * RANK_BITS) - 1
            i = struct.unpack_from("<I", self.code, ranks + 4 * block)[0] + inside.bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = at = None
        shift = 0
        for k, (width, size, (chunks, _, bits)) in enumerate(zip(self.widths, self.sizes, self.parts)):
            raw = np.frombuffer(self.code[chunks : chunks + (width * size + 7) // 8], np.uint8)
            values = np.unpackbits(raw, bitorder="little", count=width * size).reshape(size, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
            if k == 0:
                out, at = values.astype(np.uint32), np.arange(size)
            else:
                out[at] |= values.astype(np.uint32) << np.uint32(shift)
            shift += width
            if k + 1 < len(self.widths):
                on = np.unpackbits(np.frombuffer(self.code[bits : bits + (size + 7) // 8], np.uint8), bitorder="little", count=size).astype(bool)
                at = at[on]
        return out if out is not None else np.zeros(0, np.uint32)


_encoders: dict[str, Encoder] = {}


def _run(path: str, widths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in batches:
            n, codes = [], []
            for text in batch.column(1):
                text = text.as_py()
                if text is None:
                    n.append(None)
                    codes.append(None)
                    continue
                ids = encoder.ids(text)
                n.append(len(ids))
                codes.append(encode(ids, widths))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(codes, pa.binary())], names=["doc_id", "n_tokens", "code"])

    return run


def token_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(doc_id, n_tokens, code) for every row of docs, in place: nothing is shuffled.

    A null text has null for both, an empty one a code of no ids; long texts are encoded whole. Ids keep their type;
    repeated rows, and rows without an id, get rows of their own. An empty table gives an empty result. Other columns
    are never looked at, whatever their names. Code(code)[i] reads token i.
    """
    rows = docs.select(col(id_col).alias("i"), col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(_run(vocabulary, widths), f"doc_id {kind(docs, id_col)}, n_tokens long, code binary")
