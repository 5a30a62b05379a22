"""Token ids in packed matrices, by best-fit-decreasing packing.

Each task encodes its documents, cuts those longer than a row into parts, and packs blocks of parts: the longest
first, each into the row with the least room that still holds it, which a segment tree over the possible rooms finds.
The work is map-only: no text and no ids are shuffled, and a lost task is done again from its part of the input.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.text_units import UnitTable, spaced_units

#: Ids of a row of a matrix, and rows of a matrix.
ROW, ROWS = 2048, 64
#: Ids that a task packs at once: its memory, and the range over which the fit is best.
BLOCK = 1 << 22
RANKS = "byte_bpe_50k.tiktoken"
#: The vocabulary's free id ends each document and fills up rows.
END = 50256

PACKED = (
    "matrix binary, n_rows int, row_length int, n_tokens bigint, cumulative_lengths array<int>, position_resets array<int>, "
    "segment_starts array<int>, segment_lengths array<int>, doc_ids array<bigint>, parts array<int>, part_counts array<int>"
)


class RoomTree:
    """The rows of each room 0 ... row; node i of the tree tells whether a leaf below it has rows."""

    def __init__(self, row: int):
        self.leaves = 1 << row.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, index: int) -> None:
        self.rows[room].append(index)
        at = room + self.leaves
        while at and not self.some[at]:
            self.some[at] = True
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the smallest room >= least."""
        at = least + self.leaves
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        index = self.rows[room].pop()
        if not self.rows[room]:
            self.some[at] = False
            at >>= 1
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = False
                at >>= 1
        return room, index


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each from 1 to ``row``): best-fit-decreasing, equal lengths in their order."""
    tree, rows = RoomTree(row), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room, at = tree.take(lengths[i]) or (row, len(rows))
        if at == len(rows):
            rows.append([])
        rows[at].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], at)
    return rows


def rank_encoder(path: str, pattern: str):
    """Encodes units of bytes with a file of ranks; a worker's table of units is kept between batches.

    A vocabulary must leave END free and fit 16 bits: others raise ValueError.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= 1 << 16 or END in ranks.values():
        raise ValueError(f"ids of {path} do not fit 16 bits, or {END} is one of them")
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return UnitTable(lambda units: [np.array(encoding.encode_ordinary(u.decode("utf-8", "replace")), np.int32) for u in units])


_tables: dict[tuple[str, str], UnitTable] = {}


def encoded(texts: pa.Array, path: str, pattern: str) -> Iterator[np.ndarray]:
    """Ids of each whole text. Its pattern never joins what stands on both sides of a space and what follows it to a
    piece, so units from one such space to the next are encoded by themselves, each distinct one once."""
    if (path, pattern) not in _tables:
        _tables[path, pattern] = rank_encoder(path, pattern)
    table = _tables[path, pattern]
    for units in spaced_units(texts):
        start, size = table.look_up(units)
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = table.values[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        edges = ends[np.searchsorted(units.text, np.arange(units.n + 1))]
        yield from (ids[edges[i] : edges[i + 1]] for i in range(units.n))


def packed_rows(parts: list[tuple[int | None, int, int, np.ndarray]], row: int, rows: int) -> Iterator[dict]:
    """Matrices of parts (doc_id, part, parts of the document, ids), at most ``rows`` rows each."""
    filled = best_fit_decreasing([len(p[3]) for p in parts], row)
    for at in range(0, len(filled), rows):
        chosen = [[parts[i] for i in r] for r in filled[at : at + rows]]
        matrix = np.full((len(chosen), row), END, "<u2")
        ends, starts = [0], []
        for y, r in enumerate(chosen):
            x = 0
            for _, _, _, ids in r:
                matrix[y, x : x + len(ids)] = ids
                starts.append(y * row + x)
                x += len(ids)
                ends.append(y * row + x)
            if x < row:
                ends.append((y + 1) * row)
        every = [p for r in chosen for p in r]
        yield {
            "matrix": matrix.tobytes(),
            "n_rows": len(chosen),
            "row_length": row,
            "n_tokens": sum(len(p[3]) for p in every),
            "cumulative_lengths": ends,
            "position_resets": ends[:-1],
            "segment_starts": starts,
            "segment_lengths": [len(p[3]) for p in every],
            "doc_ids": [p[0] for p in every],
            "parts": [p[1] for p in every],
            "part_counts": [p[2] for p in every],
        }


def pack(docs: DataFrame, path: str, pattern: str, row: int = ROW, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Packed matrices of the ids of docs (doc_id, text); further columns are ignored.

    One row of the result is a matrix: ``matrix``, n_rows x row_length unsigned 16-bit ids, little-endian. All places
    are those of the matrix read row by row. cumulative_lengths bound the segments from 0 on, what fills up a row being
    a segment of its own, so that attention stays inside a segment; position_resets are the places where positions
    start again at 0. Of the segments that hold ids, in order, come segment_starts, segment_lengths, doc_ids, parts and
    part_counts; n_tokens counts their ids. A document is its ids and END. One longer than a row is cut into parts of
    ``row`` ids and a rest: joined by part, they are the document. Null and empty texts have no ids and no segment.
    Repeated rows and null ids are segments like others. An empty table gives no matrix.
    """
    if row > 1 << 15 or block < row:
        raise ValueError("a row holds at most 32768 ids, and a block a row or more")
    places = ("cumulative_lengths", "position_resets", "segment_starts", "segment_lengths")
    schema = pa.schema(
        [("matrix", pa.binary()), ("n_rows", pa.int32()), ("row_length", pa.int32()), ("n_tokens", pa.int64()), *((n, pa.list_(pa.int32())) for n in places)]
        + [("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("part_counts", pa.list_(pa.int32()))]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text"), path, pattern), strict=True):
                if not len(ids):
                    continue
                ids = np.append(ids, END)
                n = -(-len(ids) // row)
                for k in range(n):
                    parts.append((doc_id, k, n, ids[k * row : (k + 1) * row].astype("<u2")))
                    held += len(parts[-1][3])
                    if held >= block:
                        yield from (pa.RecordBatch.from_pylist([m], schema) for m in packed_rows(parts, row, rows))
                        parts, held = [], 0
        yield from (pa.RecordBatch.from_pylist([m], schema) for m in packed_rows(parts, row, rows))

    return docs.select("doc_id", "text").mapInArrow(task, PACKED)


def unpacked(matrices: DataFrame) -> DataFrame:
    """(doc_id, part, part_count, ids) of every segment: what pack() has put in."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                ids = np.frombuffer(m["matrix"], "<u2")
                cut = [(d, p, n, ids[a : a + size].tolist()) for d, p, n, a, size in zip(m["doc_ids"], m["parts"], m["part_counts"], m["segment_starts"], m["segment_lengths"], strict=True)]
                yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(("doc_id", "part", "part_count", "ids"), zip(*cut), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())))})

    return matrices.mapInArrow(task, "doc_id long, part int, part_count int, ids array<int>")
