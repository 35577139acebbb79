"""Operator 9: near-duplicate texts by DartMinHash signatures of weighted word shingles.

A text is the multiset of its runs of five words; a shingle's weight is how often it occurs. Each shingle throws hashed
darts into its region [0, weight) x [0, rank limit): the regions [0, 1), [1, 2), [2, 4), ... carry independent Poisson
streams of darts in ascending rank, seeded by the shingle and the region, and a dart counts if its weight coordinate
lies below the shingle's weight. Every dart also hashes to one of ``k`` coordinates, and a signature keeps the earliest
dart of each coordinate. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity. The
rank limit falls with a text's total weight, so about k ln k darts are drawn whatever its length.

Bands of coordinates are joined through their hash: within each band's bucket every text is paired with the bucket's
first text, links are verified exactly on the shingle multisets, and linked texts fall into components. Texts of
different components that still share a bucket are then compared block by block, so a link between components is lost
only if no band holds both texts.

Equal texts are one class from the start. A bucket's rows are never gathered: buckets are aggregated (count, minimum)
and joined back, so a third of all rows may share one.

Edge cases: texts shorter than five words are one shingle of all their words; null, empty and white-space texts have no
shingle, link with nothing and each is kept; a null ``doc_id`` never represents a group with other ids; repeated rows
are copies; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, byte_hasher, drop_written, joined, mix64, release, sized, text_slices, uniform, word_bounds, written
from .components import components

U = np.uint64


def shingles(texts: list[str], width: int = 5):
    """(text number, shingle hash of 48 bits, weight) of all texts, sorted by text and hash."""
    data, at = joined(texts)
    start, end = word_bounds(data)
    words = byte_hasher()(data, start, end)
    doc = np.searchsorted(at, start, "right") - 1
    n = len(words)
    held = np.bincount(doc, minlength=len(texts)) if n else np.zeros(len(texts), dtype=np.int64)
    m = max(n - width + 1, 0)
    acc = np.zeros(m, dtype=U)
    for j in range(width):
        acc = acc * U(0x9E3779B97F4A7C15) + words[j : j + m]
    whole = doc[:m] == doc[n - m :]
    h, d = acc[whole], doc[:m][whole]
    short = np.flatnonzero((held > 0) & (held < width))
    if len(short):
        first = np.concatenate(([0], np.cumsum(held)))
        extra = []
        for i in short.tolist():
            v = int(held[i])
            for w in words[first[i] : first[i + 1]].tolist():
                v = (v * 0x9E3779B97F4A7C15 + w) & MASK64
            extra.append(v)
        h, d = np.concatenate((h, np.array(extra, dtype=U))), np.concatenate((d, short))
    key = np.sort((d.astype(U) << U(48)) | (mix64(h) >> U(16)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    weight = np.diff(new, append=len(key))
    key = key[new]
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), weight


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k dart ids (0 where a text has no shingle)."""
    out = np.zeros((n_docs, k), dtype=U)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    limit = np.where(total > 0, k * (np.log(k) + 1.0) / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        mine = todo[doc]
        best, ids = _darts(doc[mine], element[mine], weight[mine], limit, n_docs, k)
        full = todo & np.isfinite(best).all(axis=1)
        out[full] = ids[full]
        todo &= ~full
        limit = limit * 2.0
    return out


def _darts(doc, element, weight, limit, n_docs: int, k: int):
    best, ids = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, dtype=U)
    low, region = 0, 0
    while len(doc):
        size = 1.0 if region == 0 else float(low)
        seed = mix64(element + U(0x632BE59BD9B4E019 * (region + 1) & MASK64))
        d, w, s, rank, turn = doc, weight, seed, np.zeros(len(doc)), 1
        while len(d):
            h = mix64(s + U(0x9E3779B97F4A7C15 * turn & MASK64))
            rank = rank - np.log(uniform(h)) / size
            near = rank <= limit[d]
            d, w, s, rank, h = d[near], w[near], s[near], rank[near], h[near]
            other = mix64(h ^ U(0xA0761D6478BD642F))
            inside = (low + size * uniform(other) <= w) if region else np.ones(len(d), dtype=bool)
            slot = d[inside] * k + (mix64(other + U(1)) % U(k)).astype(np.int64)[inside]
            r = rank[inside]
            np.minimum.at(best, slot, r)
            won = best[slot] == r
            ids[slot[won]] = h[inside][won]
            turn += 1
        low, region = max(1, low * 2), region + 1
        more = weight > low
        doc, element, weight = doc[more], element[more], weight[more]
    return best.reshape(n_docs, k), ids.reshape(n_docs, k)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands int64 hashes; the band's number is part of each."""
    out = np.zeros((len(sig), bands), dtype=U)
    for b in range(bands):
        h = np.full(len(sig), U(b + 1))
        for r in range(rows):
            h = mix64(h * U(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def text_class(column: str = "text"):
    """The class of equal texts: their SHA-256, whole, so that no number of texts merges two by chance."""
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def band_table(docs: DataFrame, bands: int, rows: int, width: int = 5) -> DataFrame:
    """doc_id, sha, bands (null for texts without words), one row per row of ``docs``."""

    def sketch(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(2)):
                doc, element, weight = shingles(texts, width)
                sig = signatures(doc, element, weight, len(texts), bands * rows)
                some = np.zeros(len(texts), dtype=bool)
                some[doc] = True
                h = band_hashes(sig, bands, rows)
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands)
                lists = pa.ListArray.from_arrays(offsets, pa.array(h.reshape(-1)), mask=pa.array(~some))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "sha", "bands"])
        release()

    src = docs.select("doc_id", text_class().alias("sha"), "text")
    return src.mapInArrow(sketch, "doc_id long, sha binary, bands array<long>")


#: Most of a shingle's weight that one packed entry carries.
MOST = 65535


def packed_shingles(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash * 2**16 + weight). A weight above MOST goes on in further entries under hashes of their own,
    filled one after the other, so that entries' smaller weights still add up to the smaller weight of the two texts."""
    parts = -(-weight // MOST)
    which = np.repeat(np.arange(len(weight)), parts)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    h, w = element[which], np.minimum(weight[which] - MOST * turn, MOST)
    more = np.flatnonzero(turn)
    h[more] = mix64(h[more] * U(0xD1342543DE82EF95) + turn[more].astype(U)) >> U(16)
    return doc[which], (h << U(16)) | w.astype(U)


def shingle_table(docs: DataFrame, wanted: DataFrame, width: int = 5) -> DataFrame:
    """(cls, held): for one text of each wanted class (cls, sha, lead) its packed shingles."""

    def build(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                doc, packed = packed_shingles(*shingles(texts, width))
                ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(packed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.slice(at, len(texts)).column(0), lists], names=["cls", "held"])
        release()

    chosen = docs.select(text_class().alias("own"), "text", F.col("doc_id").alias("id"))
    mine = chosen.join(wanted, (F.col("own") == F.col("sha")) & F.col("id").eqNullSafe(F.col("lead"))).select("cls", "text")
    return mine.mapInArrow(build, "cls long, held array<long>").dropDuplicates(["cls"])


def _slices(lengths: np.ndarray, most: int = 1 << 21):
    """(first, end) of runs of rows with about ``most`` values, 2**14 rows at most."""
    upto, at = np.cumsum(lengths), 0
    while at < len(lengths):
        before = upto[at - 1] if at else 0
        to = min(at + (1 << 14), max(at + 1, int(np.searchsorted(upto, before + most, "right"))))
        yield at, to
        at = to


def _similar(least: float):
    """mapInArrow function: keeps pairs (a, b, ha, hb) whose weighted Jaccard similarity is at least ``least``."""

    def numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, packed) of a list column: the row goes above the 48 bits of the hash."""
        n = np.diff(column.offsets.to_numpy())
        return np.repeat(np.arange(len(n), dtype=U), n), column.flatten().to_numpy(zero_copy_only=False).view(U)

    def keep(batches):
        low = U(MOST)
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            lengths = np.diff(a.offsets.to_numpy()) + np.diff(b.offsets.to_numpy())
            for at, to in _slices(lengths):
                row, packed = (np.concatenate(x) for x in zip(numbered(a.slice(at, to - at)), numbered(b.slice(at, to - at))))
                weight = (packed & low).astype(np.int64)
                total = np.bincount(row.astype(np.int64), weight, to - at)
                key = (row << U(48)) | (packed >> U(16))
                order = np.argsort(key, kind="stable")
                key, weight = key[order], weight[order]
                same = np.flatnonzero(key[1:] == key[:-1])
                shared = np.bincount((key[same] >> U(48)).astype(np.int64), np.minimum(weight[same], weight[same + 1]), to - at)
                ok = pa.array(at + np.flatnonzero(shared >= least * (total - shared) - 1e-9))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok)], names=["a", "b"])

    return keep


def verified(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` that are similar enough."""
    a = table.select(F.col("cls").alias("a"), F.col("held").alias("ha"))
    b = table.select(F.col("cls").alias("b"), F.col("held").alias("hb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInArrow(_similar(least), "a long, b long")


def _crossing(query: list, query_comp: np.ndarray, others: list, other_comp: np.ndarray, least: float):
    """(i, j) of similar texts of different components, one j for each query and component met.

    ``query`` and ``others`` are packed shingle arrays. The others' shingles form one sorted posting list, and each
    query adds up what it shares with all of them at once.
    """
    low = U(MOST)
    sizes = [len(x) for x in others]
    packed = np.concatenate(others) if others else np.zeros(0, dtype=U)
    owner = np.repeat(np.arange(len(others)), sizes)
    h, w = packed >> U(16), (packed & low).astype(np.int64)
    total = np.bincount(owner, weights=w, minlength=len(others))
    order = np.argsort(h, kind="stable")
    h, w, owner = h[order], w[order], owner[order]
    for i, q in enumerate(query):
        qh, qw = q >> U(16), (q & low).astype(np.int64)
        start, stop = np.searchsorted(h, qh, "left"), np.searchsorted(h, qh, "right")
        n = stop - start
        if not n.any():
            continue
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], weights=np.minimum(np.repeat(qw, n), w[at]), minlength=len(others))
        ok = np.flatnonzero((shared >= least * (qw.sum() + total - shared) - 1e-9) & (other_comp != query_comp[i]))
        if len(ok):
            for j in ok[np.unique(other_comp[ok], return_index=True)[1]].tolist():
                yield i, j


def across_components(entries: DataFrame, groups: DataFrame, held: DataFrame, least: float, block: int = 512) -> DataFrame:
    """Links (a, b) between texts of different components that share a bucket.

    In each bucket that holds several components, texts outside the commonest one (the rest) are compared with all. Both
    sides are dealt in blocks of about ``block`` texts, so no bucket has to fit one task; texts of the commonest
    component are not compared with each other, so a bucket that is nearly one group costs about its length. Pairs
    never leave the task that compares them: only links come out.
    """
    tagged = entries.select("bucket", "cls").join(sized(groups.withColumnRenamed("id", "cls")), "cls", "left")
    tagged = tagged.select("bucket", "cls", F.coalesce("component", "cls").alias("component"))
    per = tagged.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")
    ).where("kinds > 1")
    blocks = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    mixed = mixed.select("bucket", F.col("top.component").alias("major"), blocks(F.col("top.n")).alias("b0"), blocks(F.col("n") - F.col("top.n")).alias("b1"))
    mixed = written(mixed, "mixed")
    open_ = tagged.join(sized(mixed), "bucket")
    h = F.xxhash64("cls", "bucket")
    keys = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rest = F.col("component") != F.col("major")
    cols = ["bucket", "cls", "component"]
    common = open_.where(~rest).select(*cols, F.lit(0).alias("kind"), F.explode(keys("b1")).alias("i"), F.pmod(h, "b0").cast("int").alias("j"))
    query = open_.where(rest).withColumn("own", F.pmod(h, "b1").cast("int"))
    to_common = query.select(*cols, F.lit(1).alias("kind"), F.col("own").alias("i"), F.explode(keys("b0")).alias("j"))
    among = query.where("b1 > 1 or own = 0").withColumn("k", F.explode(keys("b1")))
    among = among.select(*cols, F.when(F.col("own") <= F.col("k"), 2).otherwise(3).alias("kind"), F.least("own", "k").alias("i"), (-1 - F.greatest("own", "k")).alias("j"))

    def compare(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        kind, cls = table.column("kind").to_numpy(), table.column("cls").to_numpy()
        comp = table.column("component").to_numpy()
        texts = [x.values.to_numpy(zero_copy_only=False).view(U) for x in table.column("held")]
        asks, told = (kind == 1, kind == 0) if j >= 0 else (kind == 2, kind == 2 if i == -1 - j else kind == 3)
        q, o = np.flatnonzero(asks), np.flatnonzero(told)
        found = list(_crossing([texts[x] for x in q], comp[q], [texts[x] for x in o], comp[o], least))
        a = cls[q[[x for x, _ in found]]] if found else cls[:0]
        b = cls[o[[x for _, x in found]]] if found else cls[:0]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = common.unionByName(to_common).unionByName(among).join(held, "cls")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_texts(docs: DataFrame, least: float = 0.8, bands: int = 20, rows: int = 5, width: int = 5, keep_class: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, cluster_id (smallest doc_id of its group), cluster_size, kept.

    ``keep_class`` adds cls, the class of equal texts (see :func:`text_class`).
    """
    table = written(band_table(docs, bands, rows, width), "bands")
    # texts with words, each distinct one under a number of its own, fixed once written
    distinct = table.where("bands is not null").groupBy("sha").agg(F.min("doc_id").alias("lead"), F.first("bands").alias("bands"))
    classes = written(distinct.withColumn("cls", F.monotonically_increasing_id()), "classes")
    spread = classes.select("cls", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.min("cls").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "rep")
    full = written(full, "buckets")
    n_full = full.count()
    entries = written(spread.join(sized(full, n_full), "bucket"), "entries")
    star = written(entries.where("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b")).distinct(), "stars")
    in_play = written(entries.select("cls").distinct().join(classes.select("cls", "sha", "lead"), "cls"), "inplay")
    held = written(shingle_table(docs, sized(in_play), width), "shingles")
    links = written(verified(star, held, least), "links")
    groups = components(links)
    more = written(across_components(entries, groups, held, least), "more")
    if more.limit(1).count():
        groups = components(links.unionByName(more))
    named = written(groups.withColumnRenamed("id", "cls").join(in_play.select("cls", "sha"), "cls").select("sha", "component"), "named")
    for spent in (entries, star, in_play, held, more, classes):
        drop_written(spent)
    # a group is a component's number or, for a text linked with no other, its digest: of different lengths
    grp = F.coalesce(F.col("component").cast("string").cast("binary"), F.col("sha"))
    rows_of = table.join(sized(named), "sha", "left").select("doc_id", "sha", F.when(F.col("bands").isNotNull(), grp).alias("grp"))
    many = rows_of.where("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("cluster_id"), F.count(F.lit(1)).alias("cluster_size"))
    many = written(many.where("cluster_size > 1"), "clusters")
    out = rows_of.join(sized(many), "grp", "left")
    same = out.groupBy("doc_id", "sha", "grp", "cluster_id", "cluster_size").agg(F.count(F.lit(1)).alias("copies"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    lead = F.col("doc_id").eqNullSafe(F.col("cluster_id")) & (F.col("copy") == 1)
    return each.select(
        *([F.col("sha").alias("cls")] if keep_class else []),
        "doc_id",
        F.coalesce("cluster_id", "doc_id").alias("cluster_id"),
        F.coalesce("cluster_size", F.lit(1)).cast("long").alias("cluster_size"),
        (F.col("cluster_size").isNull() | F.col("grp").isNull() | lead).alias("kept"),
    )
