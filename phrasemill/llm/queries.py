"""The thin queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, ngram_lm, packing, secrets_scan, simhash, token_count, token_records, vector_dedup
from .chunks import ranges
from .common import crc_mod, materialize, spread

#: Sequence lengths that packing may use, in tokens.
SEQUENCE_SIZES = (2048, 4096, 8192, 16384, 32768)
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def byte_vocabulary(path: str | None = None) -> bpe.Vocabulary:
    """The vocabulary of a rank file, by default the public byte-level one."""
    import public_tokenizers

    return bpe.Vocabulary.from_tiktoken(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start, bytes) of the numbers below n, each with a space after it."""
    if n not in _DECIMALS:
        words = [b"%d " % i for i in range(n)]
        size = np.fromiter(map(len, words), np.int64, n)
        _DECIMALS[n] = size, np.cumsum(size) - size, np.frombuffer(b"".join(words), np.uint8)
    return _DECIMALS[n]


_DECIMALS: dict = {}


def token_digests(ids: np.ndarray, edges: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Of each text: number of ids, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded bytes."""
    size, start, text = decimals(1 << 16 if not len(ids) or ids.max() < 1 << 16 else int(ids.max()) + 1)
    flat = text[ranges(start[ids], size[ids])]
    at = np.concatenate([[0], np.cumsum(size[ids])])[edges].tolist()
    digest = lambda x, a, b: hashlib.sha256(x[a:b]).hexdigest()
    bounds = bounds.tolist()
    return [
        pa.array(np.diff(edges)),
        pa.array([digest(flat, a, max(a, b - 1)) for a, b in zip(at[:-1], at[1:], strict=True)]),
        pa.array([digest(data, a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
    ]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return bpe.encode(table(spark, sf_dir, "documents"), byte_vocabulary(), finish=(token_digests, schema))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    found = langid.identify(docs, net)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets_scan.joined(F.col("spans"), ("assign", "access", "hex")), 256).alias("base_sha256"),
        secrets_scan.joined(F.col("spans")).alias("spans"),
    )


def op5_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ngram_lm.train_and_score(docs, crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame, keep: bool = True) -> DataFrame:
    """Every document as its tokens and one end token, packed into sequences. `keep`: see bpe.count_tokens."""
    counts = bpe.count_tokens(docs, byte_vocabulary(), keep=keep)
    # Written in between: two Python operators in one plan would keep two workers a core, with their memory.
    lengths = materialize(counts.select("doc_id", (F.col("n_tokens") + 1).alias("length")), "lengths")
    return packing.pack(lengths, SEQUENCE_SIZES)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"), exact_dedup.fresh_index(spark))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def sample_edits(text: F.Column, key: F.Column) -> F.Column:
    """Three edits of every text at places that its id fixes: some words come in, some characters go, one passage is replaced."""
    size = F.greatest(F.char_length(F.coalesce(text, F.lit(""))), F.lit(1))
    at = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), size.cast("bigint"))
    edit = lambda salt, removed, added: F.struct(at(salt).alias("pos"), F.lit(removed).cast("bigint").alias("removed"), F.lit(added).alias("added"))
    return F.array(edit(1, 0, " new words come in here"), edit(2, 17, ""), edit(3, 5, "it's"))


def op9_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    given = docs.select("doc_id", "text", sample_edits(F.col("text"), F.col("doc_id")).alias("edits"))
    return token_count.edited_counts(given, byte_vocabulary())


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_records.token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, added=True)


def queries() -> dict:
    ops = (op1_byte_bpe, op2_simhash_near_dedup, op3_language_id, op4_secret_scan, op5_ngram_score, op6_vector_near_dedup, op7_best_fit_packing, op8_exact_dedup, op9_edit_token_counts, op10_token_records)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_vector_near_dedup": """
            WITH RECURSIVE good AS (
                SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            link AS (
                SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
                WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
            reach AS (
                SELECT vec_id AS a, vec_id AS b FROM good
                UNION
                SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
            least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
            n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
            SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
                   e.vec_id = coalesce(l.component_id, e.vec_id) AS kept
            FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN least l ON e.vec_id = l.a""",
        "op8_exact_dedup": r"""
            WITH hashed AS (
                SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM hashed WINDOW w AS (PARTITION BY text_sha256)""",
    }
