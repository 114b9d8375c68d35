"""Language-model scoring by subword lattices.

The vocabulary is that of a public subword tokenizer.  Its piece scores are fitted to the training texts by expectation
maximisation, and a text's score is its marginal probability: over each word's lattice all segmentations count, summed in log
space by a forward recursion.  A word is written with the vocabulary's word mark in front; characters without a piece go
through the vocabulary's byte pieces; each text ends with an end piece.

Texts are dealt into blocks of about BLOCK_BYTES.  A block sends each of its distinct words once; the corpus counts them, the lattice
is walked once for each distinct word of the corpus, and the answers go back to the block, whose texts are then scored.  A task
streams its blocks one after another and holds the distinct words of one, besides a batch of texts.  Nothing but the fixed
vocabulary's counts and three totals reaches the driver.

Null texts count as empty (one end token). Null ids are training rows; repeated rows count each (rows alike in id and text share a
block, which costs its task time, not memory). There are no ties. Texts count whole, however long. Other columns are ignored, and an
empty table gives an empty result.  Within a block words are told apart by 64 bits: two of a million words collide once in 10**7 blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.llm.arrays import Prefix, buffers, chunks, mix, tidy, words as words_of
from quire.llm.tables import forget, stored

BLOCK_BYTES = 8 << 20
ROUNDS = 2
SMOOTHING = 0.1
MARK = "▁"
_FEW = 8  # so few words of one length are walked one by one
_MISS = -1


class Pieces:
    """The pieces of a sentencepiece vocabulary; ids 0..n-1 are pieces, n the end piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        self.id_of: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not special[i]:
                self.id_of[piece] = i
        self.size, self.end = n + 1, n
        self.longest = max(map(len, self.id_of), default=1)
        # scores of the file order pieces by rank; as a first guess they make a power law
        rank = np.array([-min(0.0, model.get_score(i)) for i in range(n)] + [0.0])
        usable = np.zeros(n + 1, bool)
        usable[list(self.id_of.values())] = usable[self.byte_ids] = usable[n] = True
        first = np.where(usable, 1.0 / (rank + 1000.0), 0.0)
        self.usable, self.first = usable, np.log(np.maximum(first / first.sum(), 1e-300))
        texts = list(self.id_of)
        lengths = np.array([len(t) for t in texts])
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        hashes = substring_hashes(cps).hash(ends - lengths, ends) + lengths.astype(np.uint64)
        ids = np.array([self.id_of[t] for t in texts])
        self.bits = 18
        while True:  # a table without collisions in the buckets' first entries is not needed: buckets are short lists
            slot = (mix(hashes) >> np.uint64(64 - self.bits)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            begin = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1))
            self.depth = int(np.diff(begin).max(initial=0))
            if self.depth <= 3 or self.bits >= 22:
                break
            self.bits += 1
        self.keys = np.zeros((self.depth, 1 << self.bits), np.uint64)
        self.values = np.full((self.depth, 1 << self.bits), _MISS, np.int32)
        level = np.arange(len(order)) - begin[slot[order]]
        self.keys[level, slot[order]], self.values[level, slot[order]] = hashes[order], ids[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        slot = (mix(hashes) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(hashes), _MISS, np.int32)
        for keys, values in zip(self.keys, self.values, strict=True):
            hit = keys[slot] == hashes
            out[hit] = values[slot[hit]]
        return out


def substring_hashes(cps: np.ndarray) -> Prefix:
    return Prefix(mix(cps.astype(np.uint64), 9))


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Marginal log probabilities of words, and expected piece counts, under piece log probabilities logp."""

    def __init__(self, vocab: Pieces, logp: np.ndarray):
        self.vocab, self.logp = vocab, logp
        self.by_char: dict[str, float] = {}

    def char(self, c: str) -> float:
        """Log probability of a character by its byte pieces."""
        if c not in self.by_char:
            self.by_char[c] = float(self.logp[self.vocab.byte_ids[list(c.encode())]].sum())
        return self.by_char[c]

    def _one(self, word: str, counts: np.ndarray | None, times: float) -> float:
        n, ids, logp = len(word), self.vocab.id_of, self.logp
        edges: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]  # by end: start, piece, log probability
        for a in range(n):
            for b in range(a + 1, min(n, a + self.vocab.longest) + 1):
                i = ids.get(word[a:b], _MISS)
                if i >= 0 or b == a + 1:
                    edges[b].append((a, i, float(logp[i]) if i >= 0 else self.char(word[a])))
        fore = [0.0] * (n + 1)
        for b in range(1, n + 1):
            terms = [fore[a] + p for a, _, p in edges[b]]
            top = max(terms)
            fore[b] = top + math.log(sum(math.exp(t - top) for t in terms))
        if counts is not None:
            back = [-math.inf] * n + [0.0]
            for b in range(n, 0, -1):
                for a, i, p in edges[b]:
                    x = back[b] + p
                    hi, lo = max(back[a], x), min(back[a], x)
                    back[a] = hi + math.log1p(math.exp(lo - hi)) if lo > -math.inf else hi
                    w = times * math.exp(min(0.0, fore[a] + x - fore[n]))
                    if i >= 0:
                        counts[i] += w
                    else:
                        np.add.at(counts, self.vocab.byte_ids[list(word[a].encode())], w)
        return fore[n]

    def _many(self, found: list[str], n: int, counts: np.ndarray | None, times: np.ndarray) -> np.ndarray:
        """The same for words of n characters, one vector operation for all of them at a time."""
        m = len(found)
        cps = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
        prefix = substring_hashes(cps)
        row = np.arange(m) * n
        points, which = np.unique(cps, return_inverse=True)
        single = np.array([self.char(chr(c)) for c in points])[which]
        fore = np.full((n + 1, m), -np.inf)
        fore[0] = 0
        edges: dict[tuple[int, int], np.ndarray] = {}
        logp = np.append(self.logp, -np.inf)  # what _MISS finds
        for b in range(1, n + 1):
            terms = []
            for a in range(max(0, b - self.vocab.longest), b):
                ids = self.vocab.find(prefix.hash(row + a, row + b) + np.uint64(b - a))
                if b - a > 1 and not (ids >= 0).any():
                    continue
                edges[a, b] = ids
                p = logp[ids]
                terms.append(fore[a] + (np.where(ids >= 0, p, single[row + a]) if b - a == 1 else p))
            fore[b] = _logsum(terms)
        if counts is not None:
            back = np.full((n + 1, m), -np.inf)
            back[n] = 0
            for b in range(n, 0, -1):
                for a in range(max(0, b - self.vocab.longest), b):
                    if (ids := edges.get((a, b))) is None:
                        continue
                    p = logp[ids]
                    x = back[b] + (np.where(ids >= 0, p, single[row + a]) if b - a == 1 else p)
                    back[a] = np.logaddexp(back[a], x)
                    w = times * np.exp(np.minimum(0.0, fore[a] + x - fore[n]))
                    counts += np.bincount(np.where(ids >= 0, ids, len(counts)), w, len(counts) + 1)[:-1]
                    if b - a == 1 and (miss := np.flatnonzero(ids < 0)).size:
                        for c, v in zip(*_summed(cps[row[miss] + a], w[miss]), strict=True):
                            np.add.at(counts, self.vocab.byte_ids[list(chr(c).encode())], v)
        return fore[n]

    def walk(self, found: list[str], counts: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """Log marginal probability of each marked word; adds times the expected uses of each piece to counts."""
        out = np.zeros(len(found))
        times = np.ones(len(found)) if times is None else times
        length = np.fromiter(map(len, found), np.int64, len(found))
        order = np.argsort(length, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            n = int(length[at[0]])
            if len(at) < _FEW:
                out[at] = [self._one(found[k], counts, float(times[k])) for k in at.tolist()]
                continue
            for part in np.array_split(at, -(-len(at) * n // 400_000)):
                out[part] = self._many([found[k] for k in part.tolist()], n, counts, times[part])
        return out


def _logsum(terms: list[np.ndarray]) -> np.ndarray:
    top = terms[0] if len(terms) == 1 else np.maximum.reduce(terms)
    return top if len(terms) == 1 else top + np.log(sum(np.exp(t - top) for t in terms))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[list, list]:
    found, which = np.unique(keys, return_inverse=True)
    return found.tolist(), np.bincount(which, weights).tolist()


class _Block:
    """The distinct words of a block, gathered batch by batch."""

    def __init__(self):
        self.hashes, self.counts, self.texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, column: pa.Array, trains: np.ndarray) -> None:
        data, offsets = buffers(column)
        for i, j in chunks(offsets, 4 << 20):
            w = words_of(data, offsets[i : j + 1], lower=True)
            h, one, which = np.unique(w.hashes, return_index=True, return_inverse=True)
            n = np.bincount(which, np.repeat(trains[i:j], w.counts), len(h)).astype(np.int64)
            place = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            old = self.hashes[place] == h if len(self.hashes) else np.zeros(len(h), bool)
            self.counts[place[old]] += n[old]
            raw, new = w.data.tobytes(), ~old
            found = np.empty(int(new.sum()), object)
            found[:] = [raw[a:b] for a, b in zip(w.start[one[new]].tolist(), w.end[one[new]].tolist(), strict=True)]
            both = np.concatenate([self.hashes, h[new]])
            order = np.argsort(both, kind="stable")
            self.hashes = both[order]
            self.counts = np.concatenate([self.counts, n[new]])[order]
            self.texts = np.concatenate([self.texts, found])[order]

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.hashes), 50_000):
            part = slice(a, a + 50_000)
            text = pa.array(self.texts[part].tolist(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(text), block, np.int32)), pa.array(self.hashes[part].view(np.int64)), text, pa.array(self.counts[part])], names=["block", "hash", "word", "n"])


def _runs(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[int, int]]:
    """Ranges of rows of equal keys."""
    columns = [batch.column(k).to_numpy() for k in keys]
    cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True)


def _vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, hash, word, n) of the distinct words of each block of a stream (block, text, trains) in block order; n counts training
    texts only."""
    now, held = None, _Block()
    for batch in batches:
        for a, b in _runs(batch, "block") if batch.num_rows else ():
            block = batch.column(0)[a].as_py()
            if block != now:
                if now is not None:
                    yield from held.rows(now)
                now, held = block, _Block()
            held.add(batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64))
    if now is not None:
        yield from held.rows(now)


def lm_scores(df: DataFrame, vocabulary: str, fold: int = 1, folds: int = 5, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out (crc32 of the id as text has remainder fold), n_tokens, n_known, train_tokens, base_score (add-half
    unigram words, log10) and score (marginal lattice probability, log10). Learns from rows that are not held out."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~held).alias("trains"))
    totals = source.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("trains").alias("ends")).first()
    blocks, ends = max(1, -(-(totals["bytes"] or 0) // BLOCK_BYTES)), totals["ends"]
    dealt = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    in_order = dealt.select("block", "text", "trains").repartition("block").sortWithinPartitions("block")
    asked = stored(in_order.mapInArrow(tidy(_vocabularies), "block int, hash long, word string, n long"), "words")
    counted = stored(asked.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    sums = counted.agg(F.count_if(F.col("c") > 0).alias("v"), F.sum("c").alias("n")).first()
    n_train, v_train = (sums["n"] or 0) + ends, sums["v"] + (1 if ends else 0)
    logp = fitted(counted.where("c > 0"), vocabulary, ends, rounds)
    scale = math.log10(n_train + 0.5 * (v_train + 1))
    of_end, base_end = float(logp[-1]) / math.log(10), math.log10(ends + 0.5) - scale

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces(vocabulary), logp)
        for batch in batches:
            p = lattice.walk([MARK + w for w in batch.column(0).to_pylist()]) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=["word", "c", "logp"])

    answers = stored(asked.select("block", "hash", "word").join(counted.mapInArrow(walked, "word string, c long, logp double"), "word").select("block", "hash", "c", "logp"), "answers")
    forget(asked, counted)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers of a block come before its texts."""
        now, parts, known = None, [], None
        for batch in batches:
            for a, b in _runs(batch, "block", "kind") if batch.num_rows else ():
                rows = batch.slice(a, b - a)
                block, kind = rows.column(0)[0].as_py(), rows.column(1)[0].as_py()
                if block != now:
                    now, parts, known = block, [], None
                if kind == 0:
                    parts.append([rows.column(k).to_numpy() for k in (2, 3, 4)])
                    continue
                if known is None:
                    h, c, p = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
                    order = np.argsort(h.view(np.uint64))
                    known, parts = (h.view(np.uint64)[order], c[order], np.log10(c[order] + 0.5) - scale, p[order]), []
                data, offsets = buffers(rows.column(6))
                for i, j in chunks(offsets, 4 << 20):
                    yield from _scored(words_of(data, offsets[i : j + 1], lower=True), rows.slice(i, j - i), known)

    def _scored(w, rows: pa.RecordBatch, known: tuple) -> Iterator[pa.RecordBatch]:
        hashes, c, base, p = known
        found, which = np.unique(w.hashes, return_inverse=True)
        at = np.searchsorted(hashes, found)[which]
        doc, m = w.doc_of_word(), rows.num_rows
        add = lambda x: np.bincount(doc, x, m) if len(doc) else np.zeros(m)
        n_known = add((c[at] > 0).astype(float)).astype(np.int64) + (1 if ends else 0)
        yield pa.RecordBatch.from_arrays([rows.column(5), pc.invert(rows.column(7)), pa.array(w.counts + 1), pa.array(n_known), pa.array(np.full(m, n_train)), pa.array(add(base[at]) + base_end), pa.array(add(p[at]) + of_end)], names=names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = source.schema[0].dataType.simpleString()
    nothing = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    told = answers.select("block", F.lit(0).alias("kind"), "hash", "c", "logp", *nothing(id=kind, text="string", trains="boolean"))
    texts = dealt.select("block", F.lit(1).alias("kind"), *nothing(hash="long", c="long", logp="double"), "id", "text", "trains")
    both = told.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(tidy(scored), f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def fitted(counted: DataFrame, vocabulary: str, ends: int, rounds: int) -> np.ndarray:
    """Piece log probabilities after expectation maximisation on distinct words with counts; the last is the end piece's."""
    vocab = pieces(vocabulary)
    logp = vocab.first
    for _ in range(rounds):

        def expected(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            vocab = pieces(vocabulary)
            lattice, counts = Lattice(vocab, logp), np.zeros(vocab.size)
            for batch in batches:
                lattice.walk([MARK + w for w in batch.column(0).to_pylist()], counts, batch.column(1).to_numpy().astype(float))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["piece", "uses"])

        uses = np.where(vocab.usable, SMOOTHING, 0.0)
        for r in counted.select("word", "c").mapInArrow(expected, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"]] += r["uses"]
        uses[vocab.end] += ends
        logp = np.log(np.maximum(uses / uses.sum(), 1e-300))
    return logp
