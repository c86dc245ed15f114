"""SentencePiece encoding with offsets, and decoding.

`CharMap` walks the model's compiled character map (a double-array trie behind
its size, then zero-terminated replacements): at each place the longest key is
replaced, and for every normalised byte the source byte it comes from is
recorded.  Without a map only spaces change.  The library encodes the normalised
text, and the pieces' lengths, added up, are projected through the alignment to
byte spans of the original text.

Null texts count as empty and give the end id alone.  Empty tables give empty
results, repeated rows are separate rows, a text of any length is encoded
whole, and columns besides key and text are ignored, also such as are named like
a column of ours.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelkite.llm import _base

MARK = "▁"


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class CharMap:
    """Longest-prefix normalisation with alignment."""

    def __init__(self, compiled: bytes) -> None:
        self.units: np.ndarray = np.zeros(0, np.uint32)
        self.texts = b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4)
            self.texts = compiled[4 + size :]
            root = self._below(0)
            self.first = np.array([root ^ b < len(self.units) and int(self.units[root ^ b]) & 0x800000FF == b for b in range(256)])

    def _below(self, node: int) -> int:
        unit = int(self.units[node])
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest key that raw[at:] begins with."""
        units, found = self.units, None
        node = self._below(0)
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = int(units[node])
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = int(units[node]) & 0x7FFFFFFF
                found = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The bytes after mapping, and for each of their boundaries the source byte (one more than bytes)."""
        raw = text.encode()
        if not len(self.units):
            return raw, np.arange(len(raw) + 1)
        # Keys are whole characters, so one can only begin where a key's first byte stands.
        starts = np.flatnonzero(self.first[np.frombuffer(raw, np.uint8)])
        out, source, at = [], [], 0
        for start in starts.tolist():
            if start >= at and (hit := self.longest(raw, start)):
                width, new = hit
                out += [raw[at:start], new]
                source += [np.arange(at, start), np.full(len(new), start)]
                at = start + width
        out.append(raw[at:])
        return b"".join(out), np.concatenate([*source, np.arange(at, len(raw) + 1)])


class PieceCodec:
    """Encodes and decodes as the library does, with an end id, and gives byte spans."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(Path(path).read_bytes())
        norm = proto.normalizer_spec
        if not (norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and proto.trainer_spec.model_type == 2):
            raise ValueError("a BPE model with a dummy prefix, escaped and kept spaces is needed")
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.map = CharMap(norm.precompiled_charsmap)
        self.plain = self.lib
        if norm.precompiled_charsmap:
            # A text that was normalised here must not be normalised again.
            norm.precompiled_charsmap = b""
            self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        names = [self.lib.id_to_piece(i) for i in range(self.lib.vocab_size())]
        self.size = np.array([1 if self.lib.is_byte(i) else len(p.encode()) for i, p in enumerate(names)], np.int64)
        self.size[self.lib.eos_id()] = 0
        self.digits = [str(i) for i in range(len(names))]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids with the end id, byte offsets): piece i covers offsets[i]:offsets[i+1] of the text's UTF-8."""
        normal = [self.map.normalise(t or "") for t in texts]
        coded = self.plain.encode([raw.decode() for raw, _ in normal], num_threads=1)
        for own, (raw, source), text in zip(coded, normal, texts, strict=True):
            if text and not raw:
                # Nothing is left but the mark that stands before every text.
                end = len(text.encode())
                yield np.array([self.lib.piece_to_id(MARK), self.lib.eos_id()], np.int32), np.array([0, end, end])
                continue
            ids = np.array([*own, self.lib.eos_id()], np.int32)
            at = np.concatenate(([0], np.cumsum(self.size[ids])))
            yield ids, source[self._unescaped(raw)[at]]

    @staticmethod
    def _unescaped(raw: bytes) -> np.ndarray:
        """For each byte boundary of the marked text, the byte of `raw`: a mark is three bytes for a space's one, the first for none."""
        width = np.where(np.frombuffer(raw, np.uint8) == 0x20, 3, 1)
        back = np.repeat(np.arange(len(raw)), width)
        return np.concatenate((np.zeros(3 * bool(raw), np.int64), back, [len(raw)]))

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pieces, offsets): piece ids with the end id, and one byte offset more than pieces."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(path)
        for batch in _base.slices(batches, 128):
            done = list(codec.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i for i, _ in done], pa.list_(pa.int32())), pa.array([o for _, o in done], pa.list_(pa.int64()))],
                names=["key", "pieces", "offsets"],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"key {kind}, pieces array<int>, offsets array<bigint>").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts and hashes of what encode() and decode() give, worked out where they are made, so that no ids are moved.

    offsets_sha256 is of the pieces' byte offsets as little-endian 64-bit numbers.
    """
    path = path or model_path()

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(path)
        for batch in _base.slices(batches, 128):
            out: list[list] = [[], [], [], [], []]
            for ids, offsets in codec.encode(batch.column(1).to_pylist()):
                listed = ids.tolist()
                out[0].append(len(listed))
                out[1].append(sha(" ".join(map(codec.digits.__getitem__, listed))))
                out[2].append(sha(codec.decode(listed)))
                out[3].append(int(offsets[-1]))
                out[4].append(hashlib.sha256(offsets.astype("<i8").tobytes()).hexdigest())
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "offsets_sha256"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, offsets_sha256 string").withColumnRenamed("key", key)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_base.table(spark, sf_dir, "documents"))
