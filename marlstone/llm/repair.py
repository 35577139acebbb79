"""Operator 1: token ids as binary shards, compressed by Re-Pair grammars that allow random access.

A shard is a contiguous run of documents in ascending ``doc_id`` order. Inside it, Re-Pair replaces frequent pairs of
adjacent symbols by new symbols (nonterminals), round after round until no pair stands ``least`` times in the shard. No
pair reaches over the end of a document, so each document owns a slice of the compressed sequence and can be decoded
alone; with the stored expansion lengths any range of tokens is found by a prefix sum, without expanding what stands
before it. Numbers are stored as 16-bit words and one packed plane for each further bit in use.

Edge cases: null text counts as empty (it gives the end id alone); a null ``doc_id`` sorts first and is kept; repeated
rows are separate documents; a document longer than a shard is a shard of its own; texts that hold a token such as
``<|endoftext|>`` get the ids the library gives them; an empty table writes an empty shard table; further columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, scan_width, scratch_path
from .encoding import encoded_batches

MAGIC, VERSION = b"MRPG", 2
HEAD = struct.Struct("<4sII")  # magic, version, first nonterminal
PART = struct.Struct("<QB")  # numbers, bits of each
SHARD_SCHEMA = "part int, seg int, n_docs long, n_tokens long, n_symbols long, n_rules int, shard binary"
DIGEST_SCHEMA = "doc_id long, at long, n_tokens long, ids_crc32 long, part int, seg int"


# ---- grammar -------------------------------------------------------------------------------------------------------


def _beginnings(seq: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Where a pair may begin: inside a document and, in a run of one symbol, at every other place."""
    out = inner.copy()
    same = np.flatnonzero((seq[:-1] == seq[1:]) & inner)
    if len(same):
        first = np.flatnonzero(np.diff(same, prepend=-2) != 1)
        start = np.repeat(same[first], np.diff(first, append=len(same)))
        out[same[(same - start) % 2 == 1]] = False
    return out


def _choose(pairs: np.ndarray, counts: np.ndarray, top: int, head: int = 256) -> np.ndarray:
    """Which of the frequent pairs to replace at once, so that no two of them can overlap.

    Each symbol either begins pairs, ends them, or is paired with itself. The ``head`` most frequent pairs settle this
    for their symbols in order; any other symbol takes the part in which it covers more. What is left waits.
    """
    first, second = pairs >> 32, pairs & 0xFFFFFFFF
    part = np.zeros(top, dtype=np.int8)  # 1 begins, 2 ends, 3 both
    order = np.lexsort((pairs, -counts))[:head]
    for a, b in zip(first[order].tolist(), second[order].tolist()):
        if a == b:
            part[a] = part[a] or 3
        elif part[a] in (0, 1) and part[b] in (0, 2):
            part[a], part[b] = 1, 2
    begins = np.bincount(first, counts * np.isin(part[second], (0, 2)), top)
    ends = np.bincount(second, counts * np.isin(part[first], (0, 1)), top)
    part = np.where(part == 0, np.where(begins >= ends, 1, 2), part)
    return np.where(first == second, part[first] == 3, (part[first] == 1) & (part[second] == 2))


def _by_pair(seq: np.ndarray, at: np.ndarray, top: int):
    """The pairs at places ``at``, sorted: (distinct pairs, how often each stands, places grouped by pair)."""
    wide, room = top.bit_length(), len(seq).bit_length()
    if 2 * wide + room < 64:  # pair and place fit into one number, which sorts several times faster than an index
        key = seq[at].astype(np.int64)
        key <<= wide
        key |= seq[at + 1]
        key <<= room
        key |= at
        key.sort()
        place = key & ((1 << room) - 1)
        key >>= room
        edge = np.flatnonzero(np.concatenate((at[:1] >= 0, key[1:] != key[:-1])))
        pairs = (key[edge] >> wide << 32) | (key[edge] & ((1 << wide) - 1))
    else:
        key = (seq[at].astype(np.int64) << 32) | seq[at + 1]
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        edge = np.flatnonzero(np.concatenate((at[:1] >= 0, key[1:] != key[:-1])))
        pairs = key[edge]
    return pairs, np.diff(edge, append=len(key)), place


def compress(ids: np.ndarray, doc_ends: np.ndarray, base: int, least: int = 8):
    """(symbols, rules, symbol count at each document's end).

    ``rules[k]`` are the two symbols that nonterminal ``base + k`` stands for. A pair's count never grows, so after the
    first round only pairs with a symbol of the round before, and those that had to wait, can be frequent: their places
    are carried from round to round, and no others are looked at. Pairs of one symbol twice are looked for anew, as the
    places where they may begin move when their run gets shorter.
    """
    small = base + len(ids) < 1 << 31  # there are fewer rules than ids
    seq, ends = ids.astype(np.int32 if small else np.int64), doc_ends.astype(np.int64)
    rules: list[np.ndarray] = []
    top, places = base, None
    while len(seq) > 1:
        inner = np.ones(len(seq) - 1, dtype=bool)
        inner[ends[ends < len(seq)] - 1] = False
        look = _beginnings(seq, inner)
        if places is not None:
            some = seq[:-1] == seq[1:]
            for x in places:
                some[x[x < len(some)]] = True
            look &= some
        pairs, count, place = _by_pair(seq, np.flatnonzero(look), top)
        often = count >= least
        if not often.any():
            break
        place, pairs, count = place[np.repeat(often, count)], pairs[often], count[often]
        take = _choose(pairs, count, top)
        rules.append(pairs[take])
        hit = np.repeat(take, count)
        at, waiting = place[hit], place[~hit]
        seq[at] = np.repeat(np.arange(top, top + len(rules[-1]), dtype=seq.dtype), count[take])
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        before = np.zeros(len(seq) + 1, dtype=seq.dtype)
        np.cumsum(keep, out=before[1:])
        ends, seq, fresh = before[ends].astype(np.int64), seq[keep], before[at]
        places = (fresh, fresh[fresh > 0] - 1, before[waiting[keep[waiting]]])
        top += len(rules[-1])
    flat = np.concatenate(rules) if rules else np.zeros(0, dtype=np.int64)
    return seq.astype(np.int64), np.stack((flat >> 32, flat & 0xFFFFFFFF), axis=1), ends


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids that the nonterminals stand for, end to end; how many each stands for): substituted until none is left."""
    seq, owner = rules.reshape(-1), np.repeat(np.arange(len(rules)), 2)
    while True:
        open_ = seq >= base
        if not open_.any():
            return seq.astype(np.uint32), np.bincount(owner, minlength=len(rules))
        twice = 1 + open_
        at = (np.cumsum(twice) - twice)[open_]
        put = rules[seq[open_] - base]
        seq, owner = np.repeat(seq, twice), np.repeat(owner, twice)
        seq[at], seq[at + 1] = put[:, 0], put[:, 1]


# ---- files ---------------------------------------------------------------------------------------------------------


def pack_numbers(x: np.ndarray) -> bytes:
    """Non-negative integers: their low 16 bits as words, then one packed plane for each further bit in use."""
    x = np.asarray(x, dtype=np.int64)
    bits = max(16, int(x.max(initial=0)).bit_length())
    planes = [np.packbits((x >> k & 1).astype(bool)).tobytes() for k in range(16, bits)]
    return PART.pack(len(x), bits) + (x & 0xFFFF).astype("<u2").tobytes() + b"".join(planes)


def unpack_numbers(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    """(numbers, where the next part begins)."""
    n, bits = PART.unpack_from(blob, at)
    at += PART.size
    x = np.frombuffer(blob, dtype="<u2", count=n, offset=at).astype(np.int64)
    at, size = at + 2 * n, -(-n // 8)
    for k in range(16, bits):
        plane = np.frombuffer(blob, dtype=np.uint8, count=size, offset=at)
        x |= np.unpackbits(plane, count=n).astype(np.int64) << k
        at += size
    return x, at


class Shard:
    """A shard read back: its grammar, its symbols, and where its documents lie."""

    def __init__(self, blob: bytes):
        magic, version, self.base = HEAD.unpack_from(blob)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a shard of this format")
        at, parts = HEAD.size, []
        for _ in range(6):
            x, at = unpack_numbers(blob, at)
            parts.append(x)
        rules, self.sizes, self.symbols, held, tokens, known = parts
        self.rules = rules.reshape(2, -1).T
        self.doc_ids, self.known = np.frombuffer(blob, dtype="<i8", count=len(known), offset=at), known
        self.doc_symbols, self.doc_tokens = (np.concatenate(([0], np.cumsum(x))) for x in (held, tokens))
        flat, sizes = expansions(self.rules, self.base)
        if not np.array_equal(sizes, self.sizes):
            raise ValueError("expansion lengths do not match the rules")
        self.size = np.concatenate((np.ones(self.base, dtype=np.int64), sizes))
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = np.concatenate((np.arange(self.base, dtype=np.uint32), flat))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(0, dtype=np.uint32)
        return self.flat[np.repeat(self.at[symbols] - (ends - size), size) + np.arange(ends[-1])]

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, without touching the others."""
        return self.expand(self.symbols[self.doc_symbols[i] : self.doc_symbols[i + 1]])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of the shard: the symbols that cover them are found by expansion lengths."""
        ends = np.cumsum(self.size[self.symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, max(stop, start), "left") + 1
        skip = start - (ends[a - 1] if a else 0)
        return self.expand(self.symbols[a:b])[skip : skip + max(stop - start, 0)]

    def all_tokens(self) -> np.ndarray:
        return self.expand(self.symbols)


def pack_shard(doc_ids: list, ids: np.ndarray, doc_ends: np.ndarray, base: int, **how) -> tuple[bytes, int, int]:
    """(file bytes, symbols, rules) of one shard."""
    symbols, rules, ends = compress(ids, doc_ends, base, **how)
    lengths = expansions(rules, base)[1]
    parts = (rules.T.reshape(-1), lengths, symbols, np.diff(ends, prepend=0), np.diff(doc_ends, prepend=0), [d is not None for d in doc_ids])
    named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    return HEAD.pack(MAGIC, VERSION, base) + b"".join(map(pack_numbers, parts)) + named.tobytes(), len(symbols), len(rules)


# ---- Spark ---------------------------------------------------------------------------------------------------------


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, vocabulary: int = 50_257, shard_tokens: int = 1 << 20
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them as Re-Pair shards under ``path`` in ascending doc_id order.

    One range shuffle puts each run of doc_ids into one task; a task holds one shard of about ``shard_tokens`` ids (or
    one longer document) at a time. The tie-breaking hash parts rows even if a third of them had one doc_id. Output
    goes through Spark's writer, so retried tasks replace their own files only.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(scan_width(docs), "doc_id", "tie")
    ordered = ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def shards(batches):
        from pyspark import TaskContext

        part, seg, held, ids, ends, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            blob, n_symbols, n_rules = pack_shard(held, np.concatenate(ids), np.concatenate(ends), vocabulary)
            row = ([part], [seg], [len(held)], [n], [n_symbols], [n_rules], [blob])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=names)

        for batch, new, stops in encoded_batches(batches, "text", tokenizer, True, end_id):
            held += batch.column(0).to_pylist()
            ids.append(new)
            ends.append(stops + n)
            n += len(new)
            if n >= shard_tokens:
                yield flush()
                seg, held, ids, ends, n = seg + 1, [], [], [], 0
        if held:
            yield flush()
        release()

    ordered.mapInArrow(shards, SHARD_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def read_digests(shards: DataFrame) -> DataFrame:
    """Per document of the shards, decoded from them: doc_id, start, n_tokens and the crc32 of its ids.

    ``start`` is a prefix sum in two steps: shards within their task, and tasks (a few thousand rows at most).
    """

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row["shard"])
                ids, cut = memoryview(np.ascontiguousarray(s.all_tokens(), dtype="<u4")).cast("B"), (4 * s.doc_tokens).tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.doc_ids.astype(np.int64), pa.int64(), mask=s.known == 0),
                        pa.array(s.doc_tokens[:-1].astype(np.int64)),
                        pa.array(np.diff(s.doc_tokens).astype(np.int64)),
                        pa.array(crc, pa.int64()),
                        pa.array([row["part"]] * len(crc), pa.int32()),
                        pa.array([row["seg"]] * len(crc), pa.int32()),
                    ],
                    names=[x.split()[0] for x in DIGEST_SCHEMA.split(", ")],
                )

    light = shards.select("part", "seg", "n_tokens")
    parts = light.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_tokens")
    starts = light.withColumn("inside", inside).join(parts, "part").select("part", "seg", (F.col("before") + F.col("inside")).alias("base"))
    docs = shards.select("part", "seg", "shard").mapInArrow(decode, DIGEST_SCHEMA)
    return docs.join(starts, ["part", "seg"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_shards(docs: DataFrame, tokenizer: str, path: str | None = None, **how) -> DataFrame:
    """Write the shards of ``docs`` and return what :func:`read_digests` reads back from them."""
    spark: SparkSession = docs.sparkSession
    return read_digests(write_shards(docs, path or scratch_path(spark, "shards"), tokenizer, **how))
