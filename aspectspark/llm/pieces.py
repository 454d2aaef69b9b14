"""SentencePiece encoding with byte spans in the original text, and decoding.

A text is normalised here: the longest prefix that the model's compiled
character map knows is replaced, and every normalised byte keeps the offset
of its source.  The library then segments the normalised text (by a copy of
the model whose own normaliser does nothing), and the pieces' byte lengths
are projected through the offsets.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aspectspark.session import ship_package

SPACE = "▁"

#: The first blank of a run.
RUN_START = re.compile(f"(?<!{SPACE}){SPACE}")

#: Bytes of text that one output batch is made of (a longer text is one batch).
BATCH_BYTES = 1 << 20

#: Characters after which a text is cut for the library at the next blank,
#: where no piece can span it: its work on a stretch grows faster than the stretch.
STRETCH = 512


def read_character_map(blob: bytes) -> dict[str, str]:
    """The entries of a compiled character map: the size of a double-array
    trie, the trie in 4-byte units, and the replacements, NUL-terminated."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, strings = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size:]
    jump = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    found, stack = {}, [(jump(units[0]), b"")]
    while stack:
        base, key = stack.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            child = at ^ jump(units[at])
            if units[at] >> 8 & 1:
                start = units[child] & 0x7FFFFFFF
                found[key + bytes([byte])] = strings[start:strings.index(b"\0", start)]
            stack.append((child, key + bytes([byte])))
    return {k.decode(): v.decode() for k, v in found.items()}


class Normalizer:
    """Normalised bytes of a text, and the source offset of each."""

    def __init__(self, spec, whitespace_as_suffix: bool):
        self.map = read_character_map(spec.precompiled_charsmap)
        self.longest = max(map(len, self.map), default=0)
        self.starts = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in self.map}))) + "]") if self.map else None
        self.trim, self.escape = spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.prefix, self.suffix = spec.add_dummy_prefix, whitespace_as_suffix

    def _replaced(self, text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode()
        found, at = [], 0  # stretches: source byte range, and bytes in its place or None
        if self.starts is not None:
            chars, size = 0, 0  # characters read, and their bytes
            while m := self.starts.search(text, at):
                key = next((text[m.start():m.start() + n] for n in range(self.longest, 0, -1)
                            if text[m.start():m.start() + n] in self.map), None)
                if key is None:
                    at = m.start() + 1
                    continue
                begin = size + len(text[chars:m.start()].encode())
                chars = at = m.start() + len(key)
                size = begin + len(key.encode())
                found.append((begin, size, self.map[key].encode()))
        if not found:
            return raw, np.arange(len(raw) + 1, dtype=np.int32)
        parts, offsets, at = [], [], 0
        for begin, end, new in found:
            parts += [raw[at:begin], new]
            offsets += [np.arange(at, begin, dtype=np.int32), np.full(len(new), begin, dtype=np.int32)]
            at = end
        return b"".join([*parts, raw[at:]]), np.concatenate([*offsets, np.arange(at, len(raw) + 1, dtype=np.int32)])

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        data, source = self._replaced(text)
        codes = np.frombuffer(data, dtype=np.uint8)
        blank = codes == 32
        if self.trim and blank.any():  # no blank at the start, one of a run
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            codes, blank, source = codes[keep], blank[keep], np.append(source[:-1][keep], source[-1])
        if not len(codes):
            return "", source[-1:]
        out, mark = codes.tobytes().decode(), " "
        if self.escape:
            out, mark = out.replace(" ", SPACE), SPACE
            source = np.append(np.repeat(source[:-1], np.where(blank, 3, 1)), source[-1])
        extra = len(mark.encode())
        if self.prefix and not self.suffix:
            out = mark + out
            source = np.concatenate([np.full(extra, source[0], dtype=np.int32), source])
        if self.trim and out.endswith(mark):
            size = len(out)
            out = out.rstrip(mark)
            source = source[:len(source) - (size - len(out)) * extra]
        if self.prefix and self.suffix:
            out = out + mark
            source = np.append(source, np.full(extra, source[-1], dtype=np.int32))
        return out, source


class PieceEncoder:
    """A model: ids and byte spans of texts, and texts of ids."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds = pb.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        byte = np.array([p.type == kinds.BYTE for p in proto.pieces])
        self.is_byte = byte
        self.sizes = np.where(byte, 1, [len(p.piece.encode()) for p in proto.pieces]).astype(np.int32)
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.separable = (proto.trainer_spec.model_type == pb.TrainerSpec.BPE
                          and any(p.piece == SPACE and p.type == kinds.NORMAL for p in proto.pieces)
                          and not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in proto.pieces))
        spec = proto.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix = b"", False
        spec.remove_extra_whitespaces, spec.escape_whitespaces, spec.name = False, False, "identity"
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def segment(self, normal: str) -> list[int]:
        """Ids of a normalised text.  Pieces of a BPE model that have a blank
        at their start alone never join what is on both sides of one: such a
        text is segmented stretch by stretch, with the ids of the whole."""
        if not self.separable:
            return self.plain.encode(normal)
        ids, at = [], 0
        while m := RUN_START.search(normal, at + STRETCH):
            ids += self.plain.encode(normal[at:m.start()])
            at = m.start()
        return ids + self.plain.encode(normal[at:])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the byte where each piece begins and ends in the text.
        Of the byte pieces of one character the last has its span, the
        others are empty at its start."""
        normal, source = self.normalize(text)
        if not normal:
            return (np.empty(0, dtype=np.int32),) * 3
        ids = np.array(self.segment(normal), dtype=np.int32)
        sizes = self.sizes[ids]
        if (ids == self.unknown).any():  # the piece does not tell its length
            pieces = self.plain.encode(normal, return_type="proto").pieces
            sizes = np.array([len(p.surface.encode()) for p in pieces], dtype=np.int32)
        ends = np.cumsum(sizes, dtype=np.int32)
        begins = ends - sizes
        if (at := np.flatnonzero(self.is_byte[ids])).size:
            heads = np.flatnonzero((np.frombuffer(normal.encode(), dtype=np.uint8) & 0xC0) != 0x80)
            heads = np.append(heads, ends[-1])
            own = heads[np.searchsorted(heads, begins[at], side="right") - 1]
            done = heads[np.searchsorted(heads, ends[at], side="left")] == ends[at]
            begins[at], ends[at] = own, np.where(done, ends[at], own)
        return ids, source[begins], source[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


_ENCODERS: dict[bytes, PieceEncoder] = {}


def encoder_of(model: bytes) -> PieceEncoder:
    """One encoder per worker and model."""
    if model not in _ENCODERS:
        _ENCODERS[model] = PieceEncoder(model)
    return _ENCODERS[model]


def _list_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts in turn, as many at a time as have BATCH_BYTES."""
    first, size, part = 0, 0, []
    for i in range(len(texts)):
        part.append(texts[i].as_py() or "")
        size += len(part[-1])
        if size >= BATCH_BYTES:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part


def _array(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType(), False))


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  round_trip: bool = False) -> DataFrame:
    """``id_col``, ids, begins and ends (byte span of each piece in the
    text) of every row; with ``round_trip`` also ``decoded``, the text that
    the ids decode to.

    A null text is encoded as the empty text: no ids.  Rows are encoded one
    by one, whole; ids of rows may be null or repeated; other columns are
    not read.  The model file is read by the driver and broadcast (its size
    does not depend on the data).
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(model_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                found = [encoder.encode(t) for t in texts]
                columns = [batch.column(0).slice(first, len(texts)), *(_list_of([f[k] for f in found]) for k in range(3))]
                if round_trip:
                    columns.append(pa.array([encoder.decode(f[0]) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [docs.schema[id_col], _array("ids"), _array("begins"), _array("ends")]
    if round_trip:
        fields.append(T.StructField("decoded", T.StringType()))
    names = [f.name for f in fields]
    return docs.select(id_col, text_col).mapInArrow(encode, T.StructType(fields))


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded``, the text of a row's ids (null or none: empty)."""
    spark = encoded.sparkSession
    ship_package(spark)
    with open(model_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for batch in batches:
            texts = [encoder.library.decode(ids.as_py() or []) or "" for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=names)

    names = [id_col, "decoded"]
    return encoded.select(id_col, ids_col).mapInArrow(
        decode, T.StructType([encoded.schema[id_col], T.StructField("decoded", T.StringType())]))
