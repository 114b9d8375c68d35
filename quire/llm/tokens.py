"""BPE encoding and decoding of whole texts through a pair occurrence index.

Null texts count as empty.  Rows are independent: repeated rows and ids repeat their results, there are no ties, null ids are kept,
other columns are ignored, an empty table gives an empty result.  Texts are encoded whole, however long; a task holds the texts of
an Arrow batch, and the ids of 1 MiB of them or of one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.arrays import buffers, tidy
from quire.llm.bytebpe import Spelling, encoder, vocabulary


def encoded(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, first in encoder(tokenizer, "pair_index").encode_all(*buffers(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], names=[id_col, "ids"])

    source = df.select(F.col(id_col), F.col(text_col))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def decoded(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids, special tokens included; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(tokenizer).bytes_of
        for batch in batches:
            texts = [b"".join(map(of.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    source = df.select(F.col(id_col), F.col(ids_col))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, ids_sha256 and decoded_sha256, from ids that were encoded and then decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(tokenizer).bytes_of
        every = [of.get(i, b"") for i in range(max(of) + 1)]
        spelt, counted = Spelling(every), Spelling([b"%d," % i for i in range(len(every))])
        for batch in batches:
            for i, j, ids, first in encoder(tokenizer, "pair_index").encode_all(*buffers(batch.column(1))):
                (numbers, at), (text, place) = counted(ids, first), spelt(ids, first)
                shas = [hashlib.sha256(numbers[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                back = (text[a:b].decode("utf-8", "replace") for a, b in zip(place[:-1], place[1:], strict=True))
                texts = [hashlib.sha256(t.encode()).hexdigest() for t in back]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    source = df.select(F.col(id_col), F.col(text_col))
    return source.mapInArrow(tidy(run), f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
