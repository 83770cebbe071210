"""SentencePiece ids of whole texts, each piece with the bytes of the text that it stands for.

The text is normalised here: at every place the longest prefix that the model's compiled
character map holds (a double-array trie over UTF-8 bytes) is replaced, white
space is marked, and for each byte written the source bytes are noted. The
library merges the normalised text into pieces, by a copy of the model whose own
normaliser does nothing. Pieces lie side by side in the normalised text, so
their lengths give their places there, and the notes give their source bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Fixed values of the model format: fields of the model, of its normaliser and its pieces, kinds of pieces.
_PIECE, _NORMALISER = 1, 3
_CHARACTER_MAP, _DUMMY_PREFIX, _NO_EXTRA_SPACES, _ESCAPE_SPACES = 2, 3, 4, 5
_TRAINER, _SPACE_AS_SUFFIX = 2, 24
_NORMAL, _USER_DEFINED, _BYTE = 1, 4, 6
_MARK = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _field(number: int, value: int | bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


class CharacterMap:
    """The compiled map: prefixes of texts and what replaces them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]
        self.opens = re.compile("[" + "".join(re.escape(c) for c in sorted(self._openings())) + "]") if self.units else re.compile("(?!)")

    def _child(self, node: int, byte: int) -> int | None:
        """The node behind `byte` below `node`, a place in the array with its offset applied."""
        at = node ^ byte
        if at >= len(self.units):
            return None
        unit = self.units[at]
        if unit & 0x800000FF != byte:
            return None
        return at ^ (unit >> 10 << ((unit & 512) >> 6))

    def _root(self) -> int:
        unit = self.units[0]
        return unit >> 10 << ((unit & 512) >> 6)

    def _openings(self) -> set[str]:
        """The characters with which a prefix begins, found by walking the trie down to whole characters."""
        found, todo = set(), [(self._root(), b"")]
        while todo:
            node, path = todo.pop()
            for byte in range(1, 256):
                below = self._child(node, byte)
                if below is None:
                    continue
                text = path + bytes([byte])
                try:
                    found.add(text.decode())
                except UnicodeDecodeError:
                    if len(text) < 4:
                        todo.append((below, text))
        return found

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of data[at:] in the map."""
        node, best = self._root(), None
        for end in range(at, len(data)):
            byte = data[end]
            unit_at = node ^ byte
            node = self._child(node, byte)
            if node is None:
                break
            if self.units[unit_at] & 256:
                best = end + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.replacements[best[1] : self.replacements.index(b"\0", best[1])]


class PieceEncoder:
    """Ids, source spans and decoded texts by one SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        fields = list(message_fields(model))
        spec = {_CHARACTER_MAP: b"", _DUMMY_PREFIX: 1, _NO_EXTRA_SPACES: 1, _ESCAPE_SPACES: 1}
        suffix = 0
        for number, value in fields:
            if number == _NORMALISER:
                spec |= dict(message_fields(value))
            elif number == _TRAINER:
                suffix = dict(message_fields(value)).get(_SPACE_AS_SUFFIX, 0)
        self.map = CharacterMap(spec[_CHARACTER_MAP])
        self.dummy_prefix, self.trims = bool(spec[_DUMMY_PREFIX]), bool(spec[_NO_EXTRA_SPACES])
        self.space = (_MARK if spec[_ESCAPE_SPACES] else " ").encode()
        self.suffix = bool(suffix)
        plain = _field(_NORMALISER, b"".join([_field(1, b"identity"), _field(_DUMMY_PREFIX, 0), _field(_NO_EXTRA_SPACES, 0), _field(_ESCAPE_SPACES, 0)]))
        kinds, sizes, whole = [], [], []
        for _, value in (f for f in fields if f[0] == _PIECE):
            piece = {3: _NORMAL} | dict(message_fields(value))
            kinds.append(piece[3])
            sizes.append(1 if piece[3] == _BYTE else len(piece[1]))
            if piece[3] == _USER_DEFINED:
                whole.append(piece[1])
        #: Strings that stay as they are, the longest first.
        self.fixed = re.compile(b"|".join(map(re.escape, sorted(whole, key=lambda w: (-len(w), w)))) or b"(?!)")
        self.sizes, self.exact = np.array(sizes, np.int64), _BYTE in kinds
        own = b"".join(_field(n, v) for n, v in fields if n in (_PIECE, _TRAINER)) + plain
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=own)

    def _parts(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Start, end and replacement of what is taken at a time where it isn't copied byte by byte; white space included."""
        text = data.decode("utf-8", "surrogatepass")
        hits = sorted({*(m.start() for m in self.map.opens.finditer(text)), *(m.start() for m in re.finditer(" ", text))})
        if not text.isascii() and hits:
            lengths = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            lengths = 1 + (lengths >= 0x80) + (lengths >= 0x800) + (lengths >= 0x10000)
            hits = np.concatenate([[0], np.cumsum(lengths)])[hits].tolist()
        kept = [(m.start(), m.end()) for m in self.fixed.finditer(data)] if self.fixed.pattern != b"(?!)" else []
        done = k = 0
        for at in hits:
            if at < done:
                continue
            while k < len(kept) and kept[k][1] <= at:
                k += 1
            if k < len(kept) and kept[k][0] <= at:
                done = kept[k][1]
                yield kept[k][0], done, data[kept[k][0] : done]
                continue
            hit = self.map.longest(data, at) if self.map.units else None
            if hit is None and data[at] != 32:
                continue
            size, text_out = hit or (1, b" ")
            done = at + size
            yield at, done, text_out

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised text, and for each of its bytes the source bytes [start, end) that it comes from.

        A mark that stands for no byte has an empty span.
        """
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return b"", np.empty(0, np.int64), np.empty(0, np.int64)
        if not (self.map.units or self.trims or self.suffix or self.fixed.pattern != b"(?!)"):
            return self._marked(data)
        out: list[bytes] = []
        starts: list[np.ndarray] = []
        ends: list[np.ndarray] = []

        def put(piece: bytes, a: int, b: int) -> None:
            if b - a == len(piece) and b > a and piece == data[a:b]:
                starts.append(np.arange(a, b))
                ends.append(np.arange(a + 1, b + 1))
            else:
                starts.append(np.full(len(piece), a))
                ends.append(np.full(len(piece), b))
            out.append(piece)

        after_space, at = self.trims, 0
        for a, b, piece in [*self._parts(data), (len(data), len(data), b"")]:
            if a > at:
                put(data[at:a], at, a)
                after_space = False
            at = b
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                after_space = self.trims and piece.endswith(b" ")
                for part in re.findall(rb" |[^ ]+", piece):
                    put(self.space if part == b" " else part, a, b)
        if self.trims:
            while out and out[-1].endswith(self.space):
                size = len(out[-1]) - len(self.space)
                out[-1], starts[-1], ends[-1] = out[-1][:size], starts[-1][:size], ends[-1][:size]
                if not size:
                    for x in (out, starts, ends):
                        x.pop()
        if not out:
            return b"", np.empty(0, np.int64), np.empty(0, np.int64)
        if self.dummy_prefix:
            edge = int(ends[-1][-1]) if self.suffix else int(starts[0][0])
            mark, spot = self.space, np.full(len(self.space), edge)
            where = len(out) if self.suffix else 0
            for x, v in ((out, mark), (starts, spot), (ends, spot)):
                x.insert(where, v)
        return b"".join(out), np.concatenate(starts), np.concatenate(ends)

    def _marked(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """normalise() for models without a character map: only spaces are marked."""
        mark = len(self.space)
        wide = np.where(np.frombuffer(data, np.uint8) == 32, mark, 1)
        start = np.repeat(np.arange(len(data)), wide)
        lead = np.zeros(mark * self.dummy_prefix, np.int64)
        return self.space * self.dummy_prefix + data.replace(b" ", self.space), np.concatenate([lead, start]), np.concatenate([lead, start + 1])

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and an array (pieces, 2) of source bytes [start, end): of whole bytes, and of all bytes that share a replacement."""
        norm, start, end = self.normalise(text)
        if not norm:
            return [], np.empty((0, 2), np.int64)
        plain = norm.decode("utf-8", "surrogatepass")
        ids = self.merger.encode(plain)
        if self.exact:
            size = self.sizes[ids]
        else:  # unknown characters have no piece of their own
            size = np.array([len(p.encode()) for p in self.merger.encode(plain, out_type=str)], np.int64)
        stop = np.cumsum(size)
        if int(stop[-1]) != len(norm):
            raise ValueError("pieces do not cover the normalised text")
        return ids, np.stack([start[stop - size], end[stop - 1]], 1)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def piece_encoder(name: str) -> PieceEncoder:
    """The encoder of a public model file, once per Python worker. `name` may also be a path."""
    import os

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, "rb") as f:
        return PieceEncoder(f.read())


_SPAN = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_KINDS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())]
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
WITH_PIECES = SCHEMA + ", pieces array<struct<id int, start bigint, end bigint>>, decoded string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", with_pieces: bool = False) -> DataFrame:
    """Ids of every row of `docs` (doc_id, text), decoded again, as digests; spans_sha256 digests start and end of each piece in source bytes, as little-endian 64-bit integers.

    with_pieces adds the pieces (id and source bytes) and the decoded text. A null or
    empty text has no ids, and its digests are those of nothing. Equal rows and rows with a null doc_id
    are texts like any other. Other columns are ignored.
    """
    kinds = [*_KINDS, *((("pieces", _SPAN), ("decoded", pa.string())) if with_pieces else ())]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(model)
        for big in batches:
            for lo in range(0, big.num_rows, 128):
                batch, rows = big.slice(lo, 128), []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids, spans = coder.encode(text.as_py())
                    decoded = coder.decode(ids) if ids else ""
                    row = (i, len(ids), _sha(",".join(map(str, ids))), _sha(decoded), hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest())
                    rows.append((*row, *(([{"id": x, "start": a, "end": b} for x, (a, b) in zip(ids, spans.tolist())], decoded) if with_pieces else ())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[c for c, _ in kinds])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, WITH_PIECES if with_pieces else SCHEMA)
