"""Ranked lexical search by Fagin's threshold algorithm over impact-sorted lists.

The queries are a stated set; blocks of them of bounded size (MOST_ITEMS, MOST_TERMS) are taken to all documents.  Tasks tokenise the
whole texts once and store a forward index: for each document its length and its (term, occurrences) among the terms of the block.
Counts over all documents give the weights.  Then tasks take the forward index in blocks of bounded size (POSTINGS), sort each term's
list by impact and run the threshold algorithm for each item: entries are read round-robin from its lists, each document met for the
first time is scored in full by random lookups in the forward index, and reading stops when the threshold, the score that a document
just behind all read entries could have, falls strictly below the k-th score.  A task carries its k best from block to block, so later
blocks stop sooner; the best of all tasks are merged by rank, partially before the shuffle.  No list, and no document's or item's
candidates, are gathered in one task.

Terms are equal by 128 bits.  Null texts and texts without terms are in no count and never found; an item that is null, or has no term of
weight above 0 in any document, gives no rows.  Rows of documents are ranked one by one, so repeated rows take ranks of their own, ties
by document id (null ids first); repeated items are answered each.  Extra columns are ignored, an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.arrays import buffers, chunks, ragged, tidy, words
from quire.llm.tables import forget, stored

MOST_ITEMS, MOST_TERMS = 1024, 1 << 18  # of a block of queries
POSTINGS = 1 << 21  # of a block of the forward index
LOOKUPS = 1 << 18  # entries of the forward index that are looked up together
STEP = 64  # entries that the first round reads of each list
_TERM_BYTES = np.full(256, 0x20, np.uint8)  # what is in no term separates terms
for _low, _high, _shift in ((0x30, 0x39, 0), (0x41, 0x5A, 0x20), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    _TERM_BYTES[_low : _high + 1] = np.arange(_low, _high + 1) + _shift
_KEY = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, 128-bit key of each term, terms by text), chunk by chunk."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        w = words(_TERM_BYTES[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], twice=True)
        keys = np.empty(len(w.hashes), _KEY)
        keys["a"], keys["b"] = w.hashes, w.others
        yield i, j, keys, w.counts


class Items:
    """A block of queries: ids, the distinct terms of all (sorted keys), and each item's places among them."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, keys, of = ids, [], []
        for i, _, k, counts in _terms(pa.array(texts, pa.large_string())):
            keys.append(k)
            of.append(i + np.repeat(np.arange(len(counts)), counts))
        keys, of = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, _KEY), (of, np.int64)))
        self.keys, place = np.unique(keys, return_inverse=True)
        pairs = np.unique(of * max(1, len(self.keys)) + place)
        of, place = np.divmod(pairs, max(1, len(self.keys)))
        self.terms = np.split(place, np.searchsorted(of, np.arange(1, len(ids)))) if ids else []


def _forward(vocabulary: np.ndarray):
    """(id, n, terms, tf) of each document with a term; terms are places in the vocabulary, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, size = np.ascontiguousarray(vocabulary["a"]), vocabulary["b"], max(1, len(vocabulary))
        for batch in batches:
            for i, j, keys, counts in _terms(batch.column(1)):
                at = np.searchsorted(first, keys["a"])
                at[at == len(first)] = 0
                known = (first[at] == keys["a"]) & (second[at] == keys["b"]) if len(first) else np.zeros(len(keys), bool)
                pairs, tf = np.unique(np.repeat(np.arange(j - i), counts)[known] * size + at[known], return_counts=True)
                doc, term = np.divmod(pairs, size)
                bounds = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (term, tf)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts.astype(np.int64)), *lists], names=["id", "n", "terms", "tf"])
                yield rows.filter(pa.array(counts > 0))

    return run


def _holders(size: int):
    """(term, documents that hold it), one row for each term that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["term", "df"])

    return run


class Block:
    """Part of the forward index with its impact-sorted lists."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int):
        self.ids, self.counts, self.terms, self.impacts = ids, counts, terms, impacts
        self.entry = np.cumsum(counts) - counts  # of each document in the forward index
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((doc, -impacts, terms))
        self.list_doc, self.list_impact = doc[order], impacts[order]
        self.first = np.searchsorted(terms[order], np.arange(size + 1))
        self.seen, self.weight = np.zeros(len(ids), bool), np.zeros(size, np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores, by random lookups of the documents' entries in the forward index; each has a term."""
        out = [np.zeros(0, np.int64)]
        for i, j in chunks(np.concatenate([[0], np.cumsum(self.counts[docs])]), LOOKUPS):
            part = docs[i:j]
            at = ragged(self.entry[part], self.counts[part])
            first = np.cumsum(self.counts[part]) - self.counts[part]
            out.append(np.add.reduceat(self.weight[self.terms[at]] * self.impacts[at], first))
        return np.concatenate(out)

    def best(self, terms: np.ndarray, weights: np.ndarray, held: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of held and this block, best first."""
        at, end = self.first[terms], self.first[terms + 1]
        some = at < end
        terms, weights, at, end = terms[some], weights[some], at[some], end[some]
        (score, ids), step, met = held, STEP, []
        self.weight[terms] = weights
        bound = lambda: int(weights @ np.where(at < end, self.list_impact[np.minimum(at, end - 1)], 0))  # noqa: E731  what is unread
        while (at < end).any() and (len(score) < k or bound() >= score[-1]):
            upto = np.minimum(at + step, end)
            docs = np.unique(self.list_doc[ragged(at, upto - at)])
            docs, at, step = docs[~self.seen[docs]], upto, 2 * step
            self.seen[docs] = True
            met.append(docs)
            found = self.scores(docs)
            good = found >= (score[-1] if len(score) == k else 1)
            score, ids = np.concatenate([score, found[good]]), np.concatenate([ids, self.ids[docs[good]]])
            order = np.lexsort((ids, -score))[:k]
            score, ids = score[order], ids[order]
        for docs in met:
            self.seen[docs] = False
        self.weight[terms] = 0
        return score, ids


def _threshold(wanted: list[np.ndarray], weights: np.ndarray, k: int):
    """The k best (item, id, score) of each item among the documents of a task; wanted: the items' terms."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            bounds, at = batch.column(2).offsets.to_numpy(), 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + POSTINGS - size, side="right")) - 1)
                held.append(batch.slice(at, upto - at))
                size, at = size + int(bounds[min(upto, batch.num_rows)] - bounds[at]), upto
                if size >= POSTINGS or at < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        useful = [t[weights[t] > 0] for t in wanted]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in wanted]
        for table in blocks(batches):
            part = table.combine_chunks().to_batches()[0]
            counts = np.diff(part.column(2).offsets.to_numpy())
            terms, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(part.column(1).to_numpy(), counts))
            if len(terms):
                block = Block(part.column(0).to_numpy(), counts, terms, impact, len(weights))
                for q, t in enumerate(useful):
                    best[q] = block.best(t, weights[t], best[q], k)
        sizes = np.array([len(s) for s, _ in best], np.int64)
        item = np.repeat(np.arange(len(best), dtype=np.int32), sizes)
        scores, ids = (np.concatenate([b[i] for b in best]) if best else np.zeros(0, np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids), pa.array(scores)], names=["item", "id", "score"])

    return run


def _blocks_of_items(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items that are not null in blocks of at most MOST_ITEMS, and MOST_TERMS bytes of text for each term's worth, or one item."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        if ids and (len(ids) == MOST_ITEMS or size + len(row[1]) > 4 * MOST_TERMS):
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    if ids:
        yield Items(ids, texts)


def _answers(docs: DataFrame, items: Items, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, id, score, rank) of a block of items."""
    spark, size = docs.sparkSession, max(1, len(items.keys))
    # the least long stands for a null id: it sorts first, too
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col)).where(F.col(text_col).isNotNull())
    forward = stored(source.mapInArrow(tidy(_forward(items.keys)), "id long, n long, terms array<int>, tf array<int>"), "forward")
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        forget(forward)
        return spark.createDataFrame([], "item int, id long, score long, rank int")
    weights = np.zeros(size, np.int64)
    for term, df in forward.select("terms").mapInArrow(tidy(_holders(size)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():  # a row a term of the block
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    m = F.expr(f"50 + cast((cast(50 as decimal(20, 0)) * n * {n_docs}) div {n_terms} as bigint)")  # beyond 64 bits on the way
    lists = forward.where(F.size("terms") > 0).select("id", m.alias("m"), "terms", "tf")
    found = lists.mapInArrow(tidy(_threshold(items.terms, weights, k)), "item int, id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    out = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "answers")
    forget(forward)
    return out


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per item its k documents of highest score above 0: item id, rank (from 1), document id (a long), score."""
    spark, kind = docs.sparkSession, items.schema[item_col].dataType
    out = None
    for block in _blocks_of_items(items, item_col, item_text_col):
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind.simpleString()}")
        found = _answers(docs, block, k, id_col, text_col).join(F.broadcast(names), "item")  # at most MOST_ITEMS rows
        part = found.select(F.col("item_id").alias(item_col), "rank", F.when(F.col("id") != -(1 << 63), F.col("id")).alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, `{id_col}` long, score long") if out is None else out
