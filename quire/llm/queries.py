"""The corpus operators as queries over whole tables."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import lattice, lattice_lm, lexical, licenses, minhash, negatives, oracles, packing, personal, quality, rans, secrets, substrings, tokens
from quire.llm.tables import fresh_path, read, stored

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(read(spark, sf_dir, "documents"), min_words=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), tokenizer_path(), seq_len=1024, end_id=END_ID)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), similarity=75, shingle=5)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.quality(docs, quality.classifier(docs, read(spark, sf_dir, "labels")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    rans.write_token_files(read(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return rans.read_token_files(spark, path)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(read(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lm_scores(read(spark, sf_dir, "documents"), tokenizer_path(PIECES), fold=1, folds=5)


def op11_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_spans(read(spark, sf_dir, "documents"))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), anchors=F.col("id") % 100 == 0, label=label)


# what SQL can say of the operators that it can't express


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that no model decides."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op9."""
    return op9_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _plants() -> list[tuple[str, str]]:
    """(kind, text) of structures that op9 confirms, and of ones that only look alike (kind "")."""
    number = lambda n: bytes([0x02, n]) + b"\x01" * n
    body = b"".join(map(number, (1, 120, 3, 64, 64, 64, 64, 64, 64)))
    key = b"\x30\x82" + len(body).to_bytes(2, "big") + body
    b64 = base64.b64encode(key).decode()
    lines = "\n".join(b64[k : k + 30] for k in range(0, len(b64), 30))
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = base64.b64encode(b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 120)).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'none'})}.{part({'sub': 'x'})}."
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
    return [("pem", pem), ("der", b64), ("der", lines), ("openssh", ssh), ("jwt", token), ("", b64[:-8]), ("", f"{part({'typ': 1})}.{part({})}.x"), ("", pem.replace("END", "FIN").replace("M", "N"))]


def planted_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sources with a structure planted after each: where op9 finds it, apart from what stands in it."""
    plants = F.array(*[F.lit(t) for _, t in _plants()])
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit(" is\n"), F.get(plants, F.pmod("doc_id", F.lit(len(_plants()))).cast("int")), F.lit("\n.")).alias("text"))
    found = secrets.secret_spans(docs).select("doc_id", F.filter(F.split("spans", ","), lambda x: x.rlike("^(pem|openssh|jwt|der)")).alias("spans"))
    outer = F.filter("spans", lambda x: ~F.get("spans", F.lit(0)).startswith("pem") | x.startswith("pem"))  # a PEM key's lines are a DER key, too
    return found.select("doc_id", F.array_join(outer, ",").alias("spans"))


def planted_secrets_sql() -> str:
    rows = ", ".join(f"({k}, '{kind}', {len(text)})" for k, (kind, text) in enumerate(_plants()))
    return f"""SELECT doc_id, CASE WHEN kind = '' THEN '' ELSE kind || ':' || (length(coalesce(source, '')) + 4) || ':' || (length(coalesce(source, '')) + 4 + n) END AS spans
FROM documents JOIN (VALUES {rows}) p(k, kind, n) ON doc_id % {len(_plants())} = k"""


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op11."""
    return personal.base_counts(read(spark, sf_dir, "documents"))


def lm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word model of op10."""
    return op10_lattice_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def bpe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 decodes is the text."""
    return op5_bpe_round_trip(spark, sf_dir).select("doc_id", "decoded_sha256")


def packing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents of op3, pieces that lack, sequences over 1024 tokens, sequences with gaps."""
    made = stored(op3_best_fit_packing(spark, sf_dir), "packed")
    docs = made.groupBy("doc_id").agg((F.max("piece") + 1 - F.count("*")).alias("lost")).agg(F.count("*").alias("documents"), F.sum("lost").cast("long").alias("lost_pieces"))
    bins = made.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("k"), F.countDistinct("offset").alias("places"))
    return docs.crossJoin(bins.agg(F.count_if(F.col("n") > 1024).alias("long_sequences"), F.count_if(F.expr("n <> end or k <> places")).alias("gaps")))  # one row each


def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents of op7, how many are followed by another without a gap, and by one of a greater id."""
    made = stored(op7_token_files(spark, sf_dir), "placed")
    after = made.select((F.col("start") + F.col("n_tokens")).alias("start"), F.col("doc_id").alias("before"))
    pairs = made.select("doc_id", "start").join(after, "start").agg(F.count("*").alias("followed"), F.count_if(F.expr("before < doc_id")).alias("ascending"))
    return made.agg(F.count("*").alias("documents")).crossJoin(pairs)  # one row each


def license_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that op8 finds; SQL counts those that stand in the text word for word."""
    return op8_license_scans(spark, sf_dir).select("doc_id", "n_licenses")


def queries() -> dict:
    found = (op1_substring_dedup, op2_lattice_near_dedup, op3_best_fit_packing, op4_minhash_near_dedup, op5_bpe_round_trip, op6_quality_rules, op7_token_files, op8_license_scans, op9_secret_scans, op10_lattice_lm, op11_weak_supervision_pii, op12_threshold_search, op13_hard_negatives)
    checks = (quality_counts, secret_counts, planted_secrets, pii_counts, lm_counts, bpe_texts, packing_checks, token_places, license_counts)
    return {f.__name__: f for f in (*found, *checks)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op2_lattice_near_dedup": oracles.LATTICE_NEAR_DEDUP,
        "op4_minhash_near_dedup": oracles.MINHASH_NEAR_DEDUP,
        "op12_threshold_search": oracles.LEXICAL,
        "op13_hard_negatives": oracles.HARD_NEGATIVES,
        "planted_secrets": planted_secrets_sql(),
        "pii_counts": oracles.PERSONAL_COUNTS,
        "quality_counts": oracles.QUALITY_COUNTS,
        "secret_counts": oracles.SECRET_COUNTS,
        "lm_counts": oracles.LM_COUNTS,
        "bpe_texts": oracles.BPE_TEXTS,
        "packing_checks": oracles.PACKING_CHECKS,
        "token_places": oracles.TOKEN_PLACES,
        "license_counts": oracles.license_counts({k: licenses.words(t)[0] for k, t in licenses.TEMPLATES.items()}),
    }
