"""A corpus pipeline of the llm operators: quality, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of documents, and works on all that the stage before it kept.  All but
the last return those columns and any others, whatever their names, with texts as they then are and n_chars to match.  An empty table
gives an empty result at every stage; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import minhash, packing, quality, secrets, substrings
from quire.llm.queries import END_ID, tokenizer_path
from quire.llm.tables import forget, read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the classifier reject go.

    Null and empty texts fail the rules and go. Rows are judged by their texts alone, so null ids do not matter and repeated rows stay or
    go together; a probability of just the threshold stays. Labels that are null or neither 0 nor 1 are ignored."""
    return quality.only_kept(docs, quality.classifier(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Of rows alike in id and text one stays (that of least hash of all columns); rows that share an id but not the text are documents of
    their own. Of a group the least id stays, null ids last, ties by a hash of the text. Null and empty texts are copies of nothing."""
    return minhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words or more go from the texts, wherever they stand, so there are no ties.

    All rows stay: a text that is all repeats becomes the empty text, null texts stay null, null ids are kept, and repeated rows lose
    what they share with each other."""
    return substrings.cut_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark.

    All rows stay; overlapping secrets get one mark, null texts stay null, empty ones empty, and repeated rows change alike."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences of 1024: one row for each piece.

    Null and empty texts give one piece, the end id. Null ids are kept, repeated rows give their pieces again; which of alike pieces
    takes which place is open."""
    return packing.packed(docs, tokenizer_path(), seq_len=1024, end_id=END_ID)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Tokens, signatures and a fitted model have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written and read again, and deleted when the next is written."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir), name.replace(" ", "-")), last
        last = docs
        if before is not None:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
