"""External induced sorting of the suffixes of one shard, with disk-backed priority queues.

The substrings between leftmost S-type positions are sorted and named through a queue; where names
repeat, the string of names is sorted the same way; then the order of those positions induces that
of all L-type suffixes in a rising pass and that of all S-type ones in a falling pass. A tuple
carries the symbols before its suffix, so the text is read once, in order; memory holds ``memory``
tuples of each queue, and the rest lies in sorted runs on disk.

The near-linear bound is on tuples, and a tuple costs microseconds in Python, so this serves shards of
some megabytes whose whole order is wanted. Operator 9 works on all documents by sampling instead.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator, Sequence

BLOCK = 4096


class DiskQueue:
    """A priority queue that keeps ``memory`` tuples at hand and the others in sorted runs."""

    def __init__(self, memory: int):
        self.memory, self.heap, self.heads, self.files = memory, [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.memory:
            self._spill()

    def _spill(self) -> None:
        run = sorted(self.heap)
        file = tempfile.TemporaryFile()  # a shard is one task's own work, and nothing of it is read elsewhere
        for at in range(0, len(run), BLOCK):
            pickle.dump(run[at : at + BLOCK], file, -1)
        file.seek(0)
        self.heap = []
        rows = self._rows(file)
        heapq.heappush(self.heads, (next(rows), len(self.files), rows))
        self.files.append(file)

    @staticmethod
    def _rows(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if not (self.heads and (not self.heap or self.heads[0][0] < self.heap[0])):
            return heapq.heappop(self.heap)
        item, at, rows = self.heads[0]
        if (after := next(rows, None)) is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (after, at, rows))
        return item

    def drain(self) -> Iterator[tuple]:
        while self.peek() is not None:
            yield self.pop()


class Tape:
    """Rows written in order and read back in reverse."""

    def __init__(self):
        self.file, self.block, self.starts = tempfile.TemporaryFile(), [], []

    def write(self, row: tuple) -> None:
        self.block.append(row)
        if len(self.block) >= BLOCK:
            self.starts.append(self.file.tell())
            pickle.dump(self.block, self.file, -1)
            self.block = []

    def backwards(self) -> Iterator[tuple]:
        yield from reversed(self.block)
        for at in reversed(self.starts):
            self.file.seek(at)
            yield from reversed(pickle.load(self.file))
        self.file.close()


def suffixes(text: Sequence[int], memory: int = 1 << 16) -> Iterator[int]:
    """Start positions of all suffixes of ``text``, in order; a suffix comes before those it begins."""
    n = len(text)
    if not n:
        return
    # S* positions, and for each the symbols before it
    small = bytearray(n + 1)
    small[n] = 1
    for i in range(n - 2, -1, -1):
        small[i] = text[i] < text[i + 1] or (text[i] == text[i + 1] and small[i + 1])
    stars = [i for i in range(1, n) if small[i] and not small[i - 1]]
    before = lambda k: tuple(reversed(text[stars[k - 1] if k else 0 : stars[k] if k < len(stars) else n]))
    named = DiskQueue(memory)
    for k, i in enumerate(stars):
        end = stars[k + 1] + 1 if k + 1 < len(stars) else n
        key = tuple(2 * text[j] + small[j] for j in range(i, end))
        named.push((key if k + 1 < len(stars) else (*key, -1), k))
    name, last, names = -1, None, DiskQueue(memory)
    for key, k in named.drain():
        name += key != last
        last = key
        names.push((k, name))
    if name + 1 == len(stars):
        ordered = DiskQueue(memory)
        for k, r in names.drain():
            ordered.push((r, k))
        rank: Iterable[int] = (k for _, k in ordered.drain())
    else:
        rank = suffixes([r for _, r in names.drain()], memory)

    def seeds() -> Iterator[tuple[int, int, tuple]]:
        yield -1, n, before(len(stars))
        for k in rank:
            yield text[stars[k]], stars[k], before(k)

    rising, tape, count = DiskQueue(memory), Tape(), 0
    source = seeds()
    seed = next(source, None)
    while seed is not None or rising.peek() is not None:
        top = rising.peek()
        if top is not None and (seed is None or top[0] <= seed[0]):
            c, _, at, ahead = rising.pop()
            goes = bool(ahead) and ahead[0] >= c
            tape.write((c, at, () if goes else ahead))
        else:
            (c, at, ahead), goes = seed, True
            seed = next(source, None)
        if goes and ahead:
            rising.push((ahead[0], count, at - 1, ahead[1:]))
            count += 1

    falling, out, count = DiskQueue(memory), Tape(), 0
    larges = tape.backwards()
    large = next(larges, None)
    while large is not None or falling.peek() is not None:
        top = falling.peek()
        if top is not None and (large is None or -top[0] >= large[0]):
            c, _, at, ahead = falling.pop()
            c, goes = -c, bool(ahead) and ahead[0] <= -c
        else:
            c, at, ahead = large
            goes = bool(ahead) and ahead[0] < c
            large = next(larges, None)
        out.write((at,))
        if goes:
            falling.push((-ahead[0], count, at - 1, ahead[1:]))
            count += 1
    for (at,) in out.backwards():
        yield at


def common_prefixes(text: bytes, order: Iterable[int], depth: int) -> Iterator[tuple[int, int]]:
    """Each suffix of ``order`` with the length, up to ``depth``, of what it shares with the one before."""
    last = b""
    for at in order:
        here = text[at : at + depth]
        shared = next((i for i, (a, b) in enumerate(zip(last, here)) if a != b), min(len(last), len(here)))
        yield at, shared
        last = here
