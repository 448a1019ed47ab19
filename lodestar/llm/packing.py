"""Packing documents into fixed windows by the online sum-of-squares rule.

Each input partition packs its own documents in one pass: a document's full windows stand alone, and the rest of
it goes to the fill level that leaves the smallest sum of squared counts of partially filled windows, read from an
array of counts by level. At the end the fullest open windows stay as they are and are filled up with what the emptiest
hold, which alone is cut anew; the last of it goes into powers of two, so that nothing is padded. No shuffle, no state
beyond one partition.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import gathered, only, tidy
from .tokens import default_vocabulary, encoder, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """The online packer of one partition; pieces are (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = 2048, first_sequence: int = 0, max_open: int = 8192):
        self.window, self.next, self.max_open = window, first_sequence, max_open
        self.counts = np.zeros(window + 1, np.int64)  # of windows by fill; 0 and the full level stay 0
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0
        self.filled = 0  # windows filled up at the end

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) at which size ids leave the least sum of squares; ties to the fullest."""
        n, w = self.counts, self.window
        most = w - size
        levels = np.flatnonzero(n[1 : most + 1]) + 1
        up = 2 * n[size:w + 1] + 1  # by the level before, from 0 to most
        up[most] = 0  # a full window is no partially filled one
        if not len(levels):
            return 0
        gain = up[levels] - 2 * n[levels] + 1
        best = gain.min()
        if up[0] < best:
            return 0
        return int(levels[np.flatnonzero(gain == best)[-1]])

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, w, start = len(ids), self.window, 0
        while total - start >= w:
            yield doc, start, ids[start : start + w], total, self._sequence(), 0
            start += w
        if start == total:
            return
        size = total - start
        level = self.level_for(size)
        if level:
            box = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            box = []
        box.append((doc, start, ids[start:].copy(), total))  # not a view, which would hold its whole batch
        fill = level + size
        if fill == w:
            yield from self._closed(box)
        else:
            self.open[fill].append(box)
            self.counts[fill] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                yield from self.finish()

    def _closed(self, box: list) -> Iterator[tuple]:
        sequence, offset = self._sequence(), 0
        for doc, start, ids, total in box:
            yield doc, start, ids, total, sequence, offset
            offset += len(ids)

    def finish(self) -> Iterator[tuple]:
        """Closes every open window: the emptiest fill up the fullest, and the rest goes into powers of two."""
        boxes = deque(box for level in reversed(self.open) for box in level)
        self.open = [[] for _ in range(self.window)]
        self.counts[:] = 0
        self.n_open = 0
        rest: list = []  # pieces of the emptiest window, the first one last
        while boxes:
            box = boxes.popleft()
            gap = self.window - sum(len(p[2]) for p in box)
            while gap and (rest or boxes):
                rest = rest or boxes.pop()[::-1]
                doc, start, ids, total = rest.pop()
                box.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    rest.append((doc, start + gap, ids[gap:], total))
                gap -= len(box[-1][2])
            if gap:
                rest = box[::-1]
            else:
                self.filled += 1
                yield from self._closed(box)
        left = sum(len(p[2]) for p in rest)
        room, sequence, offset = 0, 0, 0
        for doc, start, ids, total in rest[::-1]:
            while len(ids):
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                    sequence, offset = self._sequence(), 0
                take = min(room, len(ids))
                yield doc, start, ids[:take], total, sequence, offset
                start, ids, room, offset = start + take, ids[take:], room - take, offset + take


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = 2048, with_ids: bool = False, max_open: int = 8192) -> DataFrame:
    """Pieces of every document (doc_id, text) in windows of at most `window` ids.

    max_open: windows open at once in a task, which bounds its memory; beyond it they are closed as at the end, and nothing
    is lost. Texts may be of any length.
    A null or empty text is its end id alone; a null doc_id is kept; repeated rows are packed each by itself; ties
    between levels go to the fuller; an empty table gives no pieces; other columns are ignored. sequence_id is unique
    over all partitions. with_ids adds the ids themselves as an array.
    """
    path = vocabulary or default_vocabulary()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        from pyspark import TaskContext

        enc, packer = encoder(path), Packer(window, TaskContext.get().partitionId() << 36, max_open)

        def table(pieces):
            rows = [(d, s, len(i), zlib.crc32(i.astype("<u4").tobytes()), t, q, o, i) for d, s, i, t, q, o in pieces]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([i.astype("<i4") for i in cols[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in gathered(batches):
            for at, size in slices(batch.column(1)):
                part = batch.slice(at, size)
                ids, n = enc.encode(part.column(1))
                each = np.split(ids, np.cumsum(n)[:-1])
                yield table([p for d, i in zip(part.column(0).to_pylist(), each, strict=True) for p in packer.add(d, i)])
        yield table(list(packer.finish()))

    return only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), schema)
