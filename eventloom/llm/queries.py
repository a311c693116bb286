"""Registered queries of the corpus operators, with oracles where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, exact, media, mixing, neardup, packing, quality, substring, tokenfiles, warc
from .shared import crc_mod, documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.stored_tokens(documents(spark, sf_dir))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(documents(spark, sf_dir), 85)


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = ctw.scores(docs, ctw.training_rows(docs))
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_media, op3_warc, op4_substring, op5_quality, op6_tokens, op7_neardup, op8_ctw, op9_exact, op10_packing)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hexadecimal digits are four of base 32.
_DIGITS = f"[[substr('{_BASE32}', CAST((CAST('0x' || substr(x, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1) for s in [15, 10, 5, 0]] for g in range(0, 8)]"

ORACLES: dict[str, str] = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS chief FROM p)
        SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, array_to_string(flatten({_DIGITS}), '') AS payload_digest,
            CASE WHEN page_id = chief THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < chief THEN chief END AS refers_to FROM g""",
    "op7_neardup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a),
        k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)""",
    "op4_substring": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, len(w) AS n, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d),
        win AS (SELECT s.doc_id, i, md5(array_to_string(list_slice(d.w, i, i + 49), ' ')) AS h FROM s JOIN d USING (doc_id) WHERE n >= 50),
        lo AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
        hit AS (SELECT win.doc_id, win.i FROM win JOIN lo USING (h) WHERE least < win.doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY k) FILTER (WHERE gone.k IS NULL) AS t, count(gone.k) AS n_removed
                 FROM word LEFT JOIN gone USING (doc_id, k) GROUP BY word.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_exact": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS n FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS c FROM d)
        SELECT doc_id, keep_id, CAST(c AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
}
