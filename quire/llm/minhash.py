"""Near-dedup of texts by circulant MinHash, banding and exact Jaccard verification.

A shingle's hash goes through one permutation of 2**32, and coordinate k of a text's signature is the least value that a
second permutation, circularly shifted by k, gives its shingles; so two permutations make all coordinates.  BANDS bands of
ROWS coordinates put texts of equal shingle sets (one class, one row) into buckets: at a similarity of 0.75 a pair meets
in no bucket once in 200,000 pairs.  Within buckets, signatures screen pairs (a pair at 0.75 fails SCREEN once in ten
million); only screened pairs move, and all links are confirmed on the full shingle sets.

Not every link is needed for components, so they are looked for in three rounds: first each class and the most similar of the
leaders (least numbers) of its buckets, which joins up most of a large group of near copies at one comparison for each member; then
each class and its best screened partner of a lower number in another component; then all screened pairs that are still in
different components.  No link between components can be missed by that.  The last round also screens by odd sketches, a bit for the parity of each of 4 to 8 bins a shingle: as many bits as differ, so many shingles differ at
least, so this drops no link, and of pairs without one hardly any is left to verify.  Large buckets are split in tiles,
which hold each of their pairs once.

Texts with no words have no shingles and link with nothing.  Null ids get no component and are kept; rows that share an
id are one document (their links count together).  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.arrays import Prefix, Words, mix, tidy, word_chunks
from quire.llm.components import connected_components
from quire.llm.tables import forget, stored

SHINGLE = 5
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
SCREEN = 0.55
TILE = 2048
_U32 = np.uint32


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text, by text and hash; a text of fewer words has its whole sequence."""
    counts = w.counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    doc = np.repeat(np.arange(len(counts)), n)
    start = w.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(counts[doc], size)
    hashes = mix(Prefix(w.hashes).hash(start, start + length) + length.astype(np.uint64), 5)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def _permuted(x: np.ndarray, out: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """A fixed permutation of 2**32."""
    np.right_shift(x, _U32(16), out=scratch)
    np.bitwise_xor(x, scratch, out=out)
    np.multiply(out, _U32(0x85EBCA6B), out=out)
    np.right_shift(out, _U32(13), out=scratch)
    np.bitwise_xor(out, scratch, out=out)
    np.multiply(out, _U32(0xC2B2AE35), out=out)
    np.right_shift(out, _U32(16), out=scratch)
    return np.bitwise_xor(out, scratch, out=out)


def signatures(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Circulant MinHash of the non-empty sets that begin at begins: COORDINATES numbers of 16 bits for each."""
    out = np.empty((len(begins), COORDINATES), np.uint16)
    if not len(begins):
        return out
    first = (hashes >> np.uint64(32)).astype(_U32)
    first = _permuted(first * _U32(0x9E3779B1), np.empty_like(first), np.empty_like(first))
    shifted, value, scratch = (np.empty_like(first) for _ in range(3))
    for k in range(COORDINATES):
        np.subtract(first, _U32(k), out=shifted)
        out[:, k] = np.minimum.reduceat(_permuted(shifted, value, scratch), begins).astype(np.uint16)
    return out


def _sets(w: Words, size: int):
    """(set sizes, begins of non-empty sets, their texts, hashes, two digests of each set)."""
    hashes, doc = shingles(w, size)
    n = np.bincount(doc, minlength=len(w.first) - 1)
    full = np.flatnonzero(n)
    begins = (np.cumsum(n) - n)[full]
    digests = [np.add.reduceat(mix(hashes, salt), begins).view(np.int64) if len(begins) else np.zeros(0, np.int64) for salt in (11, 12)]
    return n, begins, full, hashes, digests


def _signed(size: int, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in word_chunks(batch.column(1), lower=True):
                n, begins, full, hashes, digests = _sets(w, size)
                raw = signatures(hashes, begins)
                k1, k2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                k1[full], k2[full] = digests
                width = np.where(n > 0, 2 * COORDINATES, 0)
                sig = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(width)]).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), sig], names=[id_name, "n", "k1", "k2", "sig"])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in word_chunks(batch.column(1), lower=True):
                n, _, full, hashes, digests = _sets(w, size)
                own = np.zeros((2, j - i), np.int64)
                own[:, full] = digests
                right = (own[0] == batch.column(2).to_numpy()[i:j]) & (own[1] == batch.column(3).to_numpy()[i:j])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["cid", "shingles"]).filter(pa.array(right))

    return run


def _odd_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, odd) of sets of shingles: the parities of 2**k bins, at least 4 for each shingle and 64 in all."""
    for batch in batches:
        column = batch.column(1)
        n = np.diff(column.offsets.to_numpy())
        hashes = column.flatten().to_numpy().view(np.uint64)
        for a, b in _by_total(n, 1 << 18):
            bits = 1 << np.ceil(np.log2(np.maximum(4 * n[a:b], 64))).astype(np.int64)
            begin = np.cumsum(bits) - bits
            own = hashes[n[:a].sum() : n[:b].sum()]
            at = np.repeat(begin, n[a:b]) + (own & np.repeat(bits - 1, n[a:b]).astype(np.uint64)).astype(np.int64)
            raw = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little")
            odd = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(bits // 8)]).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), odd], names=["cid", "odd"])


def _by_total(n: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


class OddSketches:
    """Odd sketches of rows, by size, for counting the bits in which rows differ."""

    def __init__(self, column: pa.Array):
        raw = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        self.size = np.array([len(x) for x in raw])
        self.row = np.zeros(len(raw), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.row[at] = np.arange(len(at))
            self.of[size] = np.stack([raw[k] for k in at.tolist()])

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits that differ between the rows x and y, the longer sketch folded to the shorter's size."""
        out = np.zeros(len(x), np.int64)
        a, b = self.size[x], self.size[y]
        for one, two in {*zip(a.tolist(), b.tolist(), strict=True)}:
            at, size = np.flatnonzero((a == one) & (b == two)), min(one, two)
            for part in np.array_split(at, -(-len(at) * max(one, two) // (1 << 19))):
                left, right = (np.bitwise_xor.reduce(self.of[k][self.row[z[part]]].reshape(len(part), -1, size), axis=1) for k, z in ((one, x), (two, y)))
                out[part] = np.bitwise_count(left ^ right).sum(axis=1)
        return out


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Whole runs of equal (key, t1, t2) of a stream sorted by them, as arrays; several runs at once."""
    held: list[pa.RecordBatch] = []

    def arrays(table: pa.Table) -> list[np.ndarray]:
        out = [table.column(c).combine_chunks().to_numpy() for c in columns]
        sig = table.column("sig").combine_chunks()
        flat = np.frombuffer(sig.buffers()[2], np.uint16) if len(sig) else np.zeros(0, np.uint16)
        first = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset] // 2 if len(sig) else 0
        odd = [OddSketches(table.column("odd").combine_chunks())] if "odd" in table.column_names else [None]
        return [*out, flat[first : first + len(sig) * COORDINATES].reshape(-1, COORDINATES), *odd]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        at = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "t1", "t2")]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in at]))
        if len(new):
            k = int(new[-1]) + 1
            done = pa.Table.from_batches([*held[:-1], batch.slice(0, k)])
            held = [batch.slice(k)]
            yield arrays(done)
    if held:
        yield arrays(pa.Table.from_batches(held))


def _pairs(key, t1, t2, block, comp, limit: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of each run that lie in different components (rows of one follow each other), first before second, some
    at a time; in a tile of two blocks only pairs across them."""
    bounds = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]), [True]]))
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    same = np.zeros(len(key), bool)
    same[1:] = (comp[1:] == comp[:-1]) & (begin[1:] == begin[:-1])
    rank = np.maximum.accumulate(np.where(same, 0, np.arange(len(key)))) - begin  # rows before its own component's
    total = np.cumsum(rank)
    a = 0
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, side="right")))
        n = rank[a:b]
        second = np.repeat(np.arange(a, b), n)
        first = np.repeat(begin[a:b], n) + np.arange(len(second)) - np.repeat(np.cumsum(n) - n, n)
        ok = (t1[second] == t2[second]) | (block[first] != block[second])
        yield first[ok], second[ok]
        a = b


def _estimated(floor: float):
    """Pairs (a, b, signatures of both) whose estimated similarity is floor or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, COORDINATES) for k in (2, 3))
                about = (one == two).mean(axis=1)
                kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(about)], names=["a", "b", "about"])
                yield kept.filter(pa.array(about >= floor))

    return run


def _screened(similarity: int, floor: float, best_only: bool):
    """Pairs of a bucket with estimated similarity over SCREEN, in the first band that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t1, t2, block, band, cid, n, comp, sig, odd in _groups(batches, ("key", "t1", "t2", "block", "band", "cid", "n", "comp")):
            bands = sig.view(np.uint64)
            partner, score = np.zeros(len(cid), np.int64), np.full(len(cid), -1.0)
            for x, y in _pairs(key, t1, t2, block, comp):
                fits = 100 * np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])
                x, y = x[fits], y[fits]
                same = sig[x] == sig[y]
                about = same.mean(axis=1) if len(x) else np.zeros(0)
                keep = about >= floor
                x, y, about = x[keep], y[keep], about[keep]
                shared = bands[x] == bands[y]
                at = band[x]
                keep = shared[np.arange(len(x)), at] & (shared.argmax(axis=1) == at) if len(x) else np.zeros(0, bool)
                x, y, about = x[keep], y[keep], about[keep]
                if not best_only:
                    keep = (100 + similarity) * odd.differing(x, y) <= (100 - similarity) * (n[x] + n[y])
                    x, y, about = x[keep], y[keep], about[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(cid[x]), pa.array(cid[y]), pa.array(about)], names=["a", "b", "about"])
                    continue
                later, other = np.where(cid[x] > cid[y], x, y), np.where(cid[x] > cid[y], y, x)
                order = np.lexsort((-cid[other], about))  # of equal estimates the least number is put last, so it stays
                later, other, about = later[order], other[order], about[order]
                better = about > score[later]
                later, other, about = later[better], other[better], about[better]
                score[later], partner[later] = about, cid[other]
            if best_only:
                own = score >= 0
                yield pa.RecordBatch.from_arrays([pa.array(cid[own]), pa.array(partner[own]), pa.array(score[own])], names=["a", "b", "about"])

    return run


def _tiled(members: DataFrame, known: DataFrame) -> DataFrame:
    """Bucket rows (key, band, cid, m, comp) with what is known of their classes, dealt out and sorted by tile."""
    blocks = F.ceil(F.col("m") / TILE).cast("int")
    block = F.pmod(F.xxhash64("cid", "key"), blocks).cast("int")
    rows = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"t1": F.least("block", "other"), "t2": F.greatest("block", "other")}).drop("other", "m")
    rows = rows.join(known, "cid")
    return rows.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "comp")


def near_duplicates(df: DataFrame, similarity: int = 75, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable by links of 100 * intersection >= similarity * union),
    kept (whether it is its component's id)."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(source.mapInArrow(tidy(_signed(shingle, "id")), f"id {kind}, n long, k1 long, k2 long, sig binary"), "signatures")
    real = signed.where("n > 0 and id is not null")
    classes = real.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    key = F.expr(f"inline(transform(sequence(0, {BANDS - 1}), i -> struct(i AS band, xxhash64(i, substring(sig, 8 * i + 1, 8)) AS key)))")
    bucketed = classes.select("cid", key)
    full = bucketed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(bucketed.join(full, "key"), "members")
    needed = classes.join(members.select("cid").distinct(), "cid").select("cid", F.col("rep").alias("id"), "k1", "k2")
    sets = source.join(needed, "id").select("cid", "text", "k1", "k2").mapInArrow(tidy(_full_sets(shingle)), "cid long, shingles array<long>")
    sets = stored(sets.groupBy("cid").agg(F.max("shingles").alias("shingles")), "sets")
    known = classes.select("cid", "n", "sig")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"{c}s")) for c in "ab")
        both = pairs.join(one, "a").join(two, "b")
        both = both.select("a", "b", F.size(F.array_intersect("as", "bs")).cast("long").alias("i"), (F.size("as") + F.size("bs")).cast("long").alias("s"))
        return both.where(100 * F.col("i") >= similarity * (F.col("s") - F.col("i"))).select("a", "b")

    def grown(joined: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with comp, theirs."""
        comps = members.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        mixed = comps.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        return comps.join(mixed, "key")

    screen = "a long, b long, about double"
    floor = similarity / 100 - 0.75 + SCREEN
    best_partner = F.max_by("b", F.struct("about", -F.col("b"))).alias("b")
    leaders = members.groupBy("key").agg(F.min("cid").alias("b"))
    led = members.join(leaders, "key").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
    for c in "ab":
        led = led.join(known.select(F.col("cid").alias(c), F.col("n").alias(f"{c}n"), F.col("sig").alias(f"{c}sig")), c)
    near = led.where(100 * F.least("an", "bn") >= similarity * F.greatest("an", "bn")).select("a", "b", "asig", "bsig")
    near = near.mapInArrow(tidy(_estimated(floor)), screen).groupBy("a").agg(best_partner)
    stars = stored(verified(near), "links")
    joined = connected_components(stars)
    best = _tiled(grown(joined), known).mapInArrow(tidy(_screened(similarity, floor, True)), screen).groupBy("a").agg(best_partner)
    first = stored(stars.unionByName(verified(best)), "links")
    forget(stars, joined)
    joined = connected_components(first)
    odd = sets.mapInArrow(tidy(_odd_sketches), "cid long, odd binary")
    rest = _tiled(grown(joined), known.join(odd, "cid")).mapInArrow(tidy(_screened(similarity, floor, False)), screen)
    second = stored(verified(rest), "links")
    links = first.unionByName(second)
    named = [classes.select(F.col("cid").alias(c), F.col("rep").alias(f"{c}r")) for c in "ab"]
    edges = links.join(named[0], "a").join(named[1], "b").select(F.col("ar").alias("a"), F.col("br").alias("b"))
    copies = real.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(edges.unionByName(copies))
    forget(members, sets, joined, first, second, classes)
    out = signed.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(df: DataFrame, similarity: int = 75, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each group of near duplicates; all columns stay.

    A document is what rows alike in id and text have in common, so rows that share an id but not the text are documents of their own,
    with links of their own. Of a group the least id stays (null ids come last, equal ids in the order of a hash of their texts), and
    of alike rows the one whose other columns have the least hash. Empty and null texts are near copies of nothing.
    """
    one, two = F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))
    key = F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (two, one)]))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    found = near_duplicates(rows.select("key", "text"), similarity, shingle, "key", "text").select("key", "component_id").distinct()
    order = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])
    single = rows.groupBy("key").agg(F.min_by("row", order).alias("row"), F.min("id").alias("id"))
    named = single.select("key", "id").join(found, "key")
    stays = named.groupBy("component_id").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("key")).select("key")
    return single.join(stays, "key", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
