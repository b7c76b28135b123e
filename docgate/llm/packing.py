"""Packing of pieces of documents into sequences of a fixed length, shortest pack first."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.bpe import codec
from docgate.llm.common import fresh, slices, stage

#: Pieces of one length are ranked in parts of about so many, so that a common length is not one task's work.
RANKED = 100_000


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (the lengths in a sequence, in order) and how many sequences have each.

    Lengths are placed from the longest down, each into the sequences with the most room if it fits there, else into new
    ones. Sequences with one pattern are handled as a count, so the work depends on the histogram alone."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    most = 0  # no open sequence has more room
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not room.get(most):
                most -= 1
            if most >= length:
                pattern, count = room[most].pop()
                at, fit = most, 1
            else:  # as many of the length as a new sequence holds
                fit = min(left, size // length)
                pattern, count, at = (), left // fit, size
            n = min(left // fit, count)
            if n < count:
                room[at].append((pattern, count - n))
            at -= length * fit
            room.setdefault(at, []).append((pattern + (length,) * fit, n))
            most = max(most, at)
            left -= n * fit
    return [x for _, same in sorted(room.items()) for x in same]


def slots(found: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the piece of a length with a rank goes: length, first rank, sequence of that rank and offset in it, sorted."""
    rows, base, used = [], 0, {}
    for pattern, count in found:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, base, offset))
            used[length] = rank + count
            offset += length
        base += count
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def pack(pieces: DataFrame, size: int = 1024, ranked: int = RANKED) -> DataFrame:
    """The columns of pieces (doc_id, start, length and any others) and sequence_id, offset.

    Lengths lie in 1 to `size`; others fail. In each sequence the pieces are gapless from offset 0. Which of several
    pieces of a length goes where is by a hash, doc_id and start. `pieces` is read three times, so it should be a written
    table. No rows give no rows.

    The driver gets the counts by length, at most `size`, and those by length and part: a part holds about `ranked`
    pieces, picked by hash. Pieces are ranked within their part, and the rank is looked up in the pattern table by binary
    search."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    part_of, rank_of = fresh(pieces, "part"), fresh(pieces, "rank")
    total = {int(length): n for length, n in pieces.groupBy("length").count().collect()}
    if wrong := [x for x in total if not 1 <= x <= size]:
        raise ValueError(f"a piece has length {wrong[0]}; 1 to {size} can be packed")
    parts = np.ones(size + 1, np.int64)
    for length, n in total.items():
        parts[length] = -(-n // ranked)
    first = np.cumsum(parts) - parts  # the number of each length's first part
    many = F.create_map(*[F.lit(int(x)) for length in total for x in (length, parts[length])]) if total else F.create_map().cast("map<int,int>")
    part = F.pmod(F.xxhash64("doc_id", "start"), F.element_at(many, F.col("length").cast("int")))
    pieces = pieces.select(*[F.col(f"`{c}`") for c in names], part.alias(part_of))
    counts = np.zeros(int(parts.sum()), np.int64)
    for length, own, n in pieces.groupBy("length", part_of).count().collect():
        counts[first[length] + own] = n
    ends = np.cumsum(counts)
    before = ends - counts - (ends - counts)[np.repeat(first, parts)]  # pieces of the length in earlier parts
    lengths, ranks, sequences, offsets = slots(patterns(total, size))
    wide = max(total.values(), default=0) + 1
    keys = lengths * wide + ranks

    def place(batches):
        for batch in batches:
            length, own, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", part_of, rank_of))
            rank = rank - 1 + before[first[length] + own]
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            columns = [*(batch.column(c) for c in names), pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", part_of).orderBy("doc_id", "start")
    placed = pieces.withColumn(rank_of, F.row_number().over(order).cast("long"))
    fields = [pieces.schema[c] for c in names]
    return placed.mapInArrow(place, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


PIECE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
)


def cut(docs: DataFrame, path: str, size: int = 1024, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Documents as pieces of at most `size` ids: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids.

    A document's ids are those of its text under the vocabulary at `path` (docgate.llm.bpe), then `end`; a null or empty
    text has `end` alone. All pieces but the last are full. Extra columns are ignored."""
    kind = PIECE if with_ids else T.StructType(PIECE.fields[:-1])

    def run(batches):
        own = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = own.encode(part.column("text").fill_null("").to_pylist())
                n = part.num_rows
                ids = np.insert(ids, offsets[1:], end)
                offsets = offsets + np.arange(n + 1)
                tokens = np.diff(offsets)
                pieces = -(-tokens // size)
                row = np.repeat(np.arange(n), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start, length = nth * size, np.minimum(tokens[row] - nth * size, size)
                data = ids.astype("<u4").tobytes()
                begin = (offsets[row] + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist(), strict=True)]
                columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row])]
                if with_ids:
                    bounds = np.append(begin // 4, len(ids)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, kind.names)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end: int = 0, with_ids: bool = True) -> DataFrame:
    """cut() and pack(): every id of every document in exactly one place of one sequence. The pieces are written to the
    shared folder between the two, so that the texts are encoded once."""
    return pack(stage(cut(docs, path, size, end, with_ids), "pieces"), size)
