"""Operator 3: exact duplicates by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its UTF-8 bytes modulo two primes. Chunks of a text are hashed on their own and
combined by length-shifted arithmetic, h(AB) = h(A) * B**len(B) + h(B), so huge documents need no pass in one piece.
Rows whose (fingerprint, length) is alone are unique. The others are compared byte by byte, chunk by chunk, with the
first row of their fingerprint; what differs from it (a collision) forms new groups and is compared again.

Edge cases: null text counts as empty, and empty texts are equal; repeated rows are copies, of which one is kept; a null
``doc_id`` loses against any other and a group of only such rows keeps one of them; an empty table gives no row; further
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
#: Bytes in a chunk: 2**8 * 2**31 * 2**13 = 2**52, so a chunk's dot product is exact in doubles.
CHUNK = 1 << 13
#: Bytes compared at once when fingerprints agree.
BLOCK = 1 << 16
#: Rows of a group that one task compares with the group's first text.
PORTION = 512


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    """Falling powers of BASE modulo each prime, the last is BASE**0: CHUNK x 2 doubles."""
    out = np.empty((CHUNK, len(PRIMES)))
    for k, p in enumerate(PRIMES):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, k] = x
            x = x * BASE % p
    return out


def chunk_hashes(data: np.ndarray) -> list[tuple[int, int]]:
    """Polynomial hash of up to CHUNK bytes (each counted as byte + 1) for both primes."""
    h = (data.astype(np.float64) + 1.0) @ _powers()[CHUNK - len(data) :]
    return [int(v) % p for v, p in zip(h, PRIMES)]


def combine(left: list[int], right: list[int], right_length: int) -> list[int]:
    """Hash of two texts laid end to end from their hashes and the length of the second."""
    return [(a * pow(BASE, right_length, p) + b) % p for a, b, p in zip(left, right, PRIMES)]


def fingerprint(blob: bytes) -> int:
    """62 bits: both hashes of the whole text, composed from its chunks."""
    data = np.frombuffer(blob, dtype=np.uint8)
    h = [0, 0]
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        h = combine(h, chunk_hashes(part), len(part))
    return h[0] << 31 | h[1]


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(0)
        prints = [fingerprint(t.as_buffer()) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), *batch.columns[1:]], names=["print", *batch.schema.names[1:]])


def exact_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = docs.select(raw.alias("raw"), "doc_id").withColumn("sha", F.sha2("raw", 256)).withColumn("n", F.octet_length("raw"))
    light = base.mapInArrow(_fingerprints, "print long, doc_id long, sha string, n int")
    # equal rows fold here, before any shuffle of what is left
    rows = written(light.groupBy("print", "n", "doc_id", "sha").agg(F.count(F.lit(1)).alias("copies")), "prints")
    groups = written(rows.groupBy("print", "n").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("print", "n"), "groups")
    n_groups = groups.count()
    shared = rows.join(sized(groups, n_groups), ["print", "n"], "left_semi")
    verified = _verified(docs, shared, rows, sized(groups, n_groups)) if n_groups else None
    single = rows.join(sized(groups, n_groups), ["print", "n"], "left_anti")
    out = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"), "copies", "sha", F.lit(True).alias("first"))
    if verified is not None:
        size = verified.groupBy("class").agg(F.sum("copies").alias("group_size"), F.max("doc_id").alias("keep_id"), F.max(F.struct("doc_id", "sha")).alias("top"))
        n_classes = size.count()
        both = verified.join(sized(size, n_classes), "class")
        out = out.unionByName(both.select("doc_id", "keep_id", "group_size", "copies", "sha", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("first")))
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def _verified(docs: DataFrame, shared: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(class, doc_id, sha, copies) of the rows that share a fingerprint, by comparing their bytes."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    # one text for each row of ``shared``: fingerprints are computed again rather than keeping all texts
    texts = docs.select(raw.alias("raw"), "doc_id").withColumn("sha", F.sha2("raw", 256)).withColumn("n", F.octet_length("raw"))
    keys = shared.select(F.col("doc_id").alias("id"), F.col("sha").alias("own"), "print", "copies")
    n_keys = keys.count()
    members = texts.join(sized(keys, n_keys), texts.doc_id.eqNullSafe(F.col("id")) & (texts.sha == F.col("own")))
    members = members.select("print", "n", "doc_id", "sha", "copies", "raw")
    pending, done, turn = members, None, 0
    while True:
        leads = pending.groupBy("print", "n").agg(F.max(F.struct("sha", "doc_id")).alias("lead"), F.count(F.lit(1)).alias("rows"))
        # rows of a group are dealt to portions, each with a copy of the first text: no group meets in one task
        portions = F.ceil(F.col("rows") / PORTION).cast("int").alias("portions")
        leads = written(leads.select("print", "n", F.col("lead.sha").alias("lead_sha"), F.col("lead.doc_id").alias("lead_id"), portions), "leads")
        n_leads = leads.count()
        if not n_leads:
            return done
        led = pending.join(sized(leads, n_leads), ["print", "n"])
        led = led.withColumn("portion", F.pmod(F.xxhash64("sha", "doc_id"), "portions").cast("int"))
        lead_text = led.where((F.col("sha") == F.col("lead_sha")) & F.col("doc_id").eqNullSafe(F.col("lead_id")))
        lead_text = lead_text.dropDuplicates(["print", "n"]).select("print", "n", F.col("raw").alias("lead_raw"), "portions")
        spans = F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / BLOCK).cast("int"))
        cut = lambda c: F.expr(f"substring({c}, block * {BLOCK} + 1, {BLOCK})")
        ours = led.withColumn("block", F.explode(spans)).select("print", "n", "block", "portion", "doc_id", "sha", "copies", cut("raw").alias("piece"))
        theirs = lead_text.withColumn("block", F.explode(spans)).select("print", "n", "block", "portions", cut("lead_raw").alias("lead_piece"))
        theirs = theirs.withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).drop("portions")
        same = ours.join(theirs, ["print", "n", "block", "portion"]).groupBy("print", "n", "doc_id", "sha").agg(
            F.min((F.col("piece") == F.col("lead_piece")).cast("int")).alias("same"), F.max("copies").alias("copies")
        )
        compared = written(same, "compared")
        mark = F.concat_ws(":", F.lit(str(turn)), "print", "n")
        equal = compared.where("same = 1").select(mark.alias("class"), "doc_id", "sha", "copies")
        done = equal if done is None else done.unionByName(equal)
        rest = compared.where("same = 0").select("print", "n", "doc_id", "sha")
        if not rest.limit(1).count():
            return done
        again = rest.select("print", "n", F.col("doc_id").alias("id"), F.col("sha").alias("other"))
        pending = pending.join(again, ["print", "n"]).where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("other"))).drop("id", "other")
        turn += 1
