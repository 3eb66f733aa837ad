"""SentencePiece encoding and decoding on the backend of the tokenizers library.

A model file is parsed from its protobuf wire format: pieces with scores and types, trainer and normaliser
settings. From it a fast tokenizer is rebuilt: the normaliser (its compiled character map, the handling of white
space, the metaspace marker U+2581 and the marker put before a text), the model (unigram scores, or the merges
that a BPE model's scores imply), byte fallback, and the decoder. Batches are encoded by the library's threads.

The rebuilt tokenizer gives all ids. It is held against the sentencepiece library: ``encode`` has both encode every
whole text, and where their ids differ - the two may break ties between equally good BPE merges differently -
parity is false.

Cases: a null text gives null ids, n_tokens 0 and no decoded text; an empty one gives no ids. Texts are encoded
whole. Names of control pieces that stand in a text are ordinary text. Repeated rows are encoded one by one;
further columns named in ``keep`` are passed through, but for those named like a result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import carried, released, table
from .kernels import give_back, hold

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 1 << 18
RESULTS = ("token_ids", "n_tokens", "parity", "round_trip")


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: whole numbers, or bytes for all other wire types."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        if kind == 2:
            size = varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown wire type {kind}")
        if at + size > len(data):
            raise ValueError("the message ends within a field")
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What the messages ModelProto, TrainerSpec and NormalizerSpec say."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown_id: int = 0
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True

    @staticmethod
    def parse(data: bytes) -> PieceModel:
        out = PieceModel()
        for number, value in wire_fields(data):
            if number == 1:
                piece = dict(wire_fields(value))
                score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                out.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(wire_fields(value))
                out.kind, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                out.unknown_id, out.suffix_mark = spec.get(40, 0), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(wire_fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.strip_spaces, out.escape_spaces = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if out.suffix_mark:
            raise ValueError("white space as a suffix is not supported")
        return out

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces whose joint piece exists, best score first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                for cut in range(1, len(piece)):
                    if piece[:cut] in ids and piece[cut:] in ids:
                        found.append((-score, ids[piece[:cut]], ids[piece[cut:]], piece[:cut], piece[cut:]))
        return [x[3:] for x in sorted(found)]

    def plain(self) -> bool:
        """Normalising only puts in markers, and nothing is matched before that."""
        return not self.charsmap and not self.strip_spaces and self.escape_spaces and all(kind != USER_DEFINED for _, _, kind in self.pieces)

    def marked(self, text: str) -> str:
        """What the normaliser makes of a text, if that is plain."""
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        if self.kind == BPE:
            vocab = {piece: i for i, (piece, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown_id][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            # Pieces that must never match in a text get a score that no other way of cutting it can be below.
            scored = [(piece, score if kind in (NORMAL, USER_DEFINED) else -1e9 if kind != UNKNOWN else score) for piece, score, kind in self.pieces]
            model = models.Unigram(scored, self.unknown_id, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.strip_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape_spaces else " "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        # Plain markers are put in before and replaced after by string functions, which is faster than steps of the library.
        if steps and not self.plain():
            out.normalizer = normalizers.Sequence(steps)
        out.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        own = [AddedToken(p, normalized=False, special=False) for p, _, kind in self.pieces if kind == USER_DEFINED]
        if own:
            out.add_tokens(own)
        return out


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, data: bytes, threads: int) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = PieceModel.parse(data)
        self.fast, self.plain = self.model.tokenizer(), self.model.plain()
        self.exact = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        texts = [self.model.marked(x) for x in texts] if self.plain else texts
        return [x.ids for x in self.fast.encode_batch_fast(texts, add_special_tokens=False)]

    def checked(self, texts: Sequence[str]) -> tuple[list[list[int]], list[bool]]:
        """The ids of whole texts, and whether the sentencepiece library gives the same."""
        ids = self.encode(texts)
        return ids, [x == y for x, y in zip(ids, self.exact.encode(list(texts), num_threads=1), strict=True)]

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        texts = [self.fast.decode(x, skip_special_tokens=False) for x in ids]
        texts = [x.replace(MARK, " ") for x in texts] if self.model.escape_spaces else texts
        return [x.removeprefix(" ") for x in texts] if self.model.dummy_prefix else texts

    def normalized(self, text: str) -> str:
        """What a text decodes to: the text after normalisation."""
        if not self.model.charsmap and not self.model.strip_spaces:
            return text.replace(MARK, " ")
        return self.exact.normalize(text).replace(MARK, " ").removeprefix(" " if self.model.dummy_prefix else "")


def _codec(data: bytes, threads: int) -> Codec:
    """One codec for each Python worker and model."""
    return hold((Codec, hash(data), threads), lambda: Codec(data, threads))


def _groups(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_BYTES, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
        yield start, stop
        start = stop


def encode(docs: DataFrame, model_path: str = MODEL_PATH, keep: tuple[str, ...] = ("doc_id",), threads: int = 2) -> DataFrame:
    """``keep`` columns of ``docs`` (text, ...), token_ids, n_tokens, parity and round_trip.

    ``model_path`` is read by the driver; executors get its bytes. parity: both libraries give the same ids.
    round_trip: the ids decode to the normalised text. Both are null for a null text. ``threads``: of one batch.
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kept, packed, own = carried(docs, keep, *RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, threads)
        for batch in batches:
            column = batch.column("text")
            for a, b in _groups(column):
                texts = column.slice(a, b - a).to_pylist()
                full = [x or "" for x in texts]
                ids, parity = codec.checked(full)
                back = [codec.normalized(x) == y for x, y in zip(full, codec.decode(ids), strict=True)]
                null = [x is None for x in texts]
                sizes = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1]))
                columns = [
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat), mask=pa.array(null)),
                    pa.array(np.diff(sizes).astype(np.int64)),
                    pa.array([None if z else x for x, z in zip(parity, null, strict=True)], pa.bool_()),
                    pa.array([None if z else x for x, z in zip(back, null, strict=True)], pa.bool_()),
                ]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("own"), *columns], ["own", *RESULTS])
        give_back()

    schema = StructType([own, StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("parity", BooleanType()), StructField("round_trip", BooleanType())])
    return released(packed.select("own", "text").mapInArrow(run, schema), kept, *RESULTS)


def decode(encoded: DataFrame, model_path: str = MODEL_PATH, keep: tuple[str, ...] = ("doc_id",), threads: int = 2) -> DataFrame:
    """``keep`` columns of ``encoded`` (token_ids, ...) and text; null ids give a null text."""
    with open(model_path, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())
    kept, packed, own = carried(encoded, keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, threads)
        for batch in batches:
            ids = batch.column("token_ids").to_pylist()
            texts = codec.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array([None if x is None else y for x, y in zip(ids, texts, strict=True)], pa.string())], ["own", "text"])

    return released(packed.select("own", "token_ids").mapInArrow(run, StructType([own, StructField("text", StringType())])), kept, "text")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
