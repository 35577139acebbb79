"""Operator 6: order-preserving packing of token streams into windows by dynamic programming.

Documents are laid end to end in ascending ``doc_id`` order within a shard, and the stream is cut into windows of at
most ``limit`` tokens at document or sentence boundaries. A cut costs nothing after a document and a little after a
sentence; only inside a sentence longer than a window may it lie elsewhere, every ``grid`` tokens, for more. A window
costs the padding that fills it up to ``limit`` (none when its length is a power of two). With candidates p (possible
cuts), the cost of the best cutting that ends at p[j] is

    f[j] = penalty[j] + min over p[j] - limit <= p[i] < p[j] of f[i] + padding(p[j] - p[i])

Padding is linear in p[i] but for powers of two, so the minimum of f[i] + p[i] slides over the candidates: a monotone
queue gives each in constant time, and the powers of two add a dozen single transitions. Of equal ones the longest
window wins. The stream is solved in blocks without loss: a cut is given out once every state that later windows can
start from agrees on it, and what follows it is solved again with the next block.

Edge cases: null text counts as empty (a document of the end id alone); rows with a null ``doc_id`` come first and are
packed; repeated rows are packed each; documents longer than ``limit`` are cut; texts that hold a token such as
``<|endoftext|>`` get the ids the library gives them; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scan_width
from .encoding import encoded_batches

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, limit: int, grid: int, sentence_cost: float, other_cost: float):
    """Sorted possible cuts of whole documents and what each costs: document and sentence ends, and every ``grid`` tokens
    inside a stretch without any that is longer than a window."""
    at = np.union1d(doc_ends, sentence_ends)
    cost = np.full(len(at), sentence_cost)
    cost[np.searchsorted(at, doc_ends)] = 0.0
    before = np.concatenate(([0], at[:-1]))
    inside = [np.arange(a + grid, b, grid) for a, b in ((before[k], at[k]) for k in np.flatnonzero(at - before > limit))]
    if inside:
        more = np.concatenate(inside)
        at, cost = np.concatenate((at, more)), np.concatenate((cost, np.full(len(more), other_cost)))
        order = np.argsort(at)
        at, cost = at[order], cost[order]
    return at, cost


def _exact_steps(at: np.ndarray, limit: int):
    """For each candidate the earlier candidates that lie a power of two before it, the farthest first: (flat indices,
    where each begins)."""
    place = np.full(int(at[-1]) + 1, -1, dtype=np.int64)
    place[at] = np.arange(len(at))
    to, back = [], []
    for w in (1 << k for k in reversed(range(limit.bit_length()))):
        j = np.flatnonzero(at >= w)
        k = place[at[j] - w]
        to.append(j[k >= 0])
        back.append(k[k >= 0])
    to, back = np.concatenate(to), np.concatenate(back)
    order = np.argsort(to, kind="stable")
    return back[order].tolist(), np.searchsorted(to[order], np.arange(len(at) + 1)).tolist()


def best_steps(at: np.ndarray, cost: np.ndarray, limit: int) -> list[int]:
    """For each candidate (the first is 0) the candidate before it on the cheapest way to it."""
    steps, begin = _exact_steps(at, limit)
    places, costs = at.tolist(), cost.tolist()
    best, back, queue, value = [0.0] * len(places), [0] * len(places), deque([0]), [0.0] * len(places)
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0]] < p - limit:
            queue.popleft()
        i = queue[0]
        low = value[i] + limit - p
        for k in steps[begin[j] : begin[j + 1]]:
            if best[k] < low:
                low, i = best[k], k
        best[j], back[j] = low + costs[j], i
        value[j] = v = best[j] + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    return back


def way_to(j: int, back: list[int]) -> list[int]:
    """Candidates on the cheapest way to ``j``, without 0."""
    out = []
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def agreed(at: np.ndarray, back: list[int], limit: int) -> int:
    """The last candidate that lies on the way to every state a later window can start from."""
    live = list(range(int(np.searchsorted(at, at[-1] - limit, "right")), len(at)))
    heap = [-j for j in live]
    heapify(heap)
    held = set(live)
    while len(held) > 1:
        j = -heappop(heap)
        held.discard(j)
        if back[j] not in held:
            held.add(back[j])
            heappush(heap, -back[j])
    return held.pop()


def best_cuts(at: np.ndarray, cost: np.ndarray, limit: int) -> list[int]:
    """Positions of the cheapest cutting, without 0 and with the last candidate."""
    return at[way_to(len(at) - 1, best_steps(at, cost, limit))].tolist()


@lru_cache(maxsize=1)
def sentence_enders(tokenizer: str) -> np.ndarray:
    """True for each id that ends a sentence: a word of sentence punctuation alone."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(tokenizer).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, dtype=bool)
    for word, i in vocab.items():
        bare = word.removesuffix("</w>")
        out[i] = bool(bare) and bare != word and bare[0] in ".!?" and set(bare) <= set(".!?\"')")
    return out


class Stream:
    """Documents that wait to be cut, and the cutting of them."""

    def __init__(self, limit: int):
        self.limit, self.n, self.sequence = limit, 0, 0
        self.docs: list[tuple] = []  # id, tokens of the document before this part, all its tokens, this part's tokens
        self.ids: list[np.ndarray] = []
        self.at: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        self.cost: list[np.ndarray] = [np.zeros(1)]

    def add(self, doc_ids: list, ids: np.ndarray, ends: np.ndarray, at: np.ndarray, cost: np.ndarray) -> None:
        sizes = np.diff(ends, prepend=0).tolist()
        self.docs += [(d, 0, size, size) for d, size in zip(doc_ids, sizes)]
        self.ids.append(ids)
        self.at.append(at + self.n)
        self.cost.append(cost)
        self.n += len(ids)

    def cut(self, last: bool, most: int) -> list[np.ndarray] | None:
        """Columns of the pieces that are settled: all of them at the end of the stream. Where more than ``most`` tokens
        agree on nothing (whole windows that tie throughout), the cheapest way so far is taken but for its end."""
        ids, at, cost = np.concatenate(self.ids), np.concatenate(self.at), np.concatenate(self.cost)
        back = best_steps(at, cost, self.limit)
        way = way_to(len(at) - 1 if last else agreed(at, back, self.limit), back)
        if not way and self.n > most:
            way = way_to(len(at) - 1, back)[:-2]
        if not way:
            self.ids, self.at, self.cost = [ids], [at], [cost]
            return None
        cut = np.concatenate(([0], at[way]))
        done, sizes = int(cut[-1]), np.array([d[3] for d in self.docs], dtype=np.int64)
        ends = np.cumsum(sizes)
        edge = np.union1d(cut, ends[ends <= done])
        a, b = edge[:-1], edge[1:]
        doc, window = np.searchsorted(ends, a, "right"), np.searchsorted(cut, a, "right") - 1
        raw = memoryview(np.ascontiguousarray(ids[:done], dtype="<u4")).cast("B")
        before = np.array([d[1] for d in self.docs], dtype=np.int64)
        out = [
            [self.docs[d][0] for d in doc.tolist()],
            before[doc] + a - (ends - sizes)[doc],
            b - a,
            [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())],
            [self.docs[d][2] for d in doc.tolist()],
            self.sequence + window,
            a - cut[window],
        ]
        self.sequence += len(way)
        d = int(np.searchsorted(ends, done, "right"))
        self.docs = self.docs[d:]
        if self.docs:
            name, passed, total, size = self.docs[0]
            skip = done - int(ends[d] - size)
            self.docs[0] = (name, passed + skip, total, size - skip)
        self.n -= done
        self.ids, self.at, self.cost = [ids[done:]], [at[way[-1] :] - done], [cost[way[-1] :]]
        return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    limit: int = 2048,
    sentence_cost: float = 8.0,
    other_cost: float = 48.0,
    grid: int = 64,
    block_tokens: int = 1 << 19,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents of ``docs``.

    One range shuffle by doc_id; each task solves its stream in blocks of about ``block_tokens`` tokens, so only the
    last window of a task is padded more than the costs ask for.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(scan_width(docs), "doc_id", "tie")
    ordered = ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]

    def windows(batches):
        from pyspark import TaskContext

        enders, stream = sentence_enders(tokenizer), Stream(limit)
        stream.sequence = TaskContext.get().partitionId() << 40

        def settled(last: bool):
            out = stream.cut(last, 4 * block_tokens)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

        tried = 0  # tokens that were waiting when the last block was solved
        for batch, ids, ends in encoded_batches(batches, "text", tokenizer, False, end_id):
            at, cost = candidates(ends, np.flatnonzero(enders[ids]) + 1, limit, grid, sentence_cost, other_cost)
            stream.add(batch.column(0).to_pylist(), ids, ends, at, cost)
            if stream.n >= tried + block_tokens:
                yield from settled(False)
                tried = stream.n
        if stream.n:
            yield from settled(True)
        release()

    return ordered.mapInArrow(windows, PIECE_SCHEMA)
