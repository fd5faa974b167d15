"""Packing of tokenised examples into training sequences as vector bin packing.

An example is a vector of tokens, segments and loss-bearing tokens, and a sequence a bin with a limit on each. Each
task packs what it reads, so nothing is shuffled: full sequences are cut off long examples, the rest wait in a
bounded buffer, and a sequence takes, again and again, the waiting piece with the largest dot product with what is left
of the three limits. What no whole piece can fill is filled by cutting one. The last pieces of a task end in
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that wait in a task before sequences are filled from them.
WAITING = 2048
END_ID = 0
COLUMNS = {
    "row_id": "bigint", "start": "bigint", "length": "bigint", "ids": "array<int>", "loss_tokens": "bigint",
    "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint", "ids_crc32": "bigint",
}
KINDS = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024

    def __post_init__(self) -> None:
        # a token that no empty sequence can hold would never be placed
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("a sequence must have room for a token, a segment and a loss-bearing token")

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.float64)


@dataclass
class Piece:
    row_id: int | None
    start: int
    ids: np.ndarray
    #: Running number of loss-bearing tokens, one longer than ids.
    loss: np.ndarray
    doc_tokens: int

    def vector(self) -> tuple[int, int, int]:
        return len(self.ids), 1, int(self.loss[-1] - self.loss[0])

    def cut(self, n: int) -> tuple[Piece, Piece]:
        one = Piece(self.row_id, self.start, self.ids[:n], self.loss[: n + 1], self.doc_tokens)
        return one, Piece(self.row_id, self.start + n, self.ids[n:], self.loss[n:], self.doc_tokens)

    def fitting(self, left: np.ndarray) -> int:
        """Longest prefix that the limits allow."""
        if left[1] < 1:
            return 0
        by_loss = int(np.searchsorted(self.loss, self.loss[0] + left[2], "right")) - 1
        return max(0, min(len(self.ids), int(left[0]), by_loss))


class Packer:
    """Places pieces; ``placed`` gives (piece, sequence, offset)."""

    def __init__(self, limits: Limits, first_sequence: int) -> None:
        self.limits, self.sequence = limits, first_sequence
        self.waiting: list[Piece] = []

    def add(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        whole = self.limits.vector()
        while len(piece.ids) >= self.limits.tokens and piece.fitting(whole) == self.limits.tokens:
            one, piece = piece.cut(self.limits.tokens)
            yield from self._emit([one])
        if len(piece.ids):
            self.waiting.append(piece)
        if len(self.waiting) >= WAITING:
            yield from self._fill(WAITING // 2)

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        yield from self._fill(0)

    def _emit(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for piece in pieces:
            yield piece, self.sequence, offset
            offset += len(piece.ids)
        self.sequence += 1

    def _fill(self, leave: int) -> Iterator[tuple[Piece, int, int]]:
        """Sequences from the waiting pieces until at most ``leave`` wait or they cannot fill a sequence."""
        whole = self.limits.vector()
        pieces = self.waiting
        sizes = np.array([p.vector() for p in pieces], np.float64).reshape(-1, 3)
        free = np.ones(len(pieces), bool)
        while free.sum() > leave and free.any():
            if not leave and sizes[free, 0].sum() < self.limits.tokens:
                break
            left, chosen = whole.copy(), []
            while left[0] > 0 and left[1] > 0 and free.any():
                # the last segment there is room for must end the sequence
                fits = free & (sizes <= left).all(axis=1) & ((left[1] > 1) | (sizes[:, 0] == left[0]))
                if fits.any():
                    best = int(np.argmax(np.where(fits, (sizes / whole) @ (left / whole), -1.0)))
                    piece, free[best] = pieces[best], False
                else:
                    best = int(np.argmax(np.where(free, sizes[:, 0], -1.0)))
                    n = pieces[best].fitting(left)
                    if not n:
                        break
                    if n == len(pieces[best].ids):
                        piece, free[best] = pieces[best], False
                    else:
                        piece, pieces[best] = pieces[best].cut(n)
                        sizes[best] = pieces[best].vector()
                left -= piece.vector()
                chosen.append(piece)
            yield from self._emit(chosen)
        self.waiting = [p for p, f in zip(pieces, free.tolist()) if f]
        if not leave:
            yield from self._powers()

    def _powers(self) -> Iterator[tuple[Piece, int, int]]:
        """The last pieces, less than a sequence of them, in sequences of a power of two each where the limits allow."""
        pieces, self.waiting = self.waiting[::-1], []
        while pieces:
            total = sum(len(p.ids) for p in pieces)
            want, left, chosen = 1 << (total.bit_length() - 1), self.limits.vector(), []
            left[0] = min(want, self.limits.tokens)
            while pieces and left[0] > 0:
                n = pieces[-1].fitting(left)
                if not n:
                    break
                piece = pieces.pop()
                if n < len(piece.ids):
                    piece, rest = piece.cut(n)
                    pieces.append(rest)
                left -= piece.vector()
                chosen.append(piece)
            yield from self._emit(chosen)


class Encoder:
    """Ids of a tokenizer file. Where the same vocabulary lies beside it as ranks, the faster library encodes by them; the two
    give the same ids for every text without the string of a special token, which the tokenizer itself encodes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast, ranks = None, os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return np.array([*found, END_ID], np.int32)

    def loss(self, text: str, ids: np.ndarray, loss_from: int | None) -> np.ndarray:
        """Running count of tokens that bear loss: those that end after character ``loss_from``, and the final id."""
        if loss_from is None:
            bears = np.ones(len(ids), np.int64)
        else:
            offsets = self.tokenizer.encode(text, add_special_tokens=False).offsets
            bears = np.array([end > loss_from for _, end in offsets] + [True], np.int64)
        return np.concatenate(([0], np.cumsum(bears)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pack(path: str, limits: Limits, outputs: list[str]):
    kinds = [KINDS[COLUMNS[c]] for c in outputs]

    def rows(placed: Iterator[tuple[Piece, int, int]]) -> Iterator[dict]:
        for piece, sequence, offset in placed:
            found = {
                "row_id": piece.row_id, "start": piece.start, "length": len(piece.ids), "loss_tokens": piece.vector()[2],
                "doc_tokens": piece.doc_tokens, "sequence_id": sequence, "offset": offset,
            }
            if "ids" in outputs:
                found["ids"] = piece.ids
            if "ids_crc32" in outputs:
                found["ids_crc32"] = zlib.crc32(piece.ids.astype("<u4").tobytes())
            yield found

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], k) for c, k in zip(outputs, kinds)], outputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, packer = encoder(path), Packer(limits, TaskContext.get().partitionId() << 33)
        for batch in batches:
            found: list[dict] = []
            for row_id, text, loss_from in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                whole = text.as_py() or ""
                ids = own.ids(whole)
                found += rows(packer.add(Piece(row_id, 0, ids, own.loss(whole, ids, loss_from), len(ids))))
                if len(found) >= 2000:
                    yield batch_of(found)
                    found = []
            yield batch_of(found)
        yield batch_of(list(rows(packer.finish())))

    return work


def pack(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), ids: bool = True) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: where it lies in its document and in its sequence.

    Columns: ``doc_id, start, length, ids, loss_tokens, doc_tokens, sequence_id, offset, ids_crc32``; without ``ids`` the ids are left out. A
    document is its ids and a final 0, so a null or empty text is one token. Every token lies in one piece; a sequence has
    no gap and keeps all limits. ``loss_from`` (a column of ``docs``, if there) is the character where loss begins; by default, or where it is
    null, all tokens bear loss. Documents with a null doc_id, and repeated rows, are packed like others, each row for itself.
    ``sequence_id`` is unique, not dense. No other column is read.
    """
    outputs = [c for c in COLUMNS if ids or c != "ids"]
    start = F.col("loss_from").cast("bigint") if "loss_from" in docs.columns else F.lit(None).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("row_id"), "text", start.alias("loss_from"))
    schema = ", ".join(f"`{c}` {COLUMNS[c]}" for c in outputs)
    return rows.mapInArrow(_pack(tokenizer_path, limits, outputs), schema).withColumnRenamed("row_id", "doc_id")
