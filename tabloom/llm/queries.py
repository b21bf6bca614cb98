"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import byte_pairs, decontaminate, jaccard_join, lattice_lm, license_scan, line_rules, sentence_pieces, source_audit, spelling, suffix_dedup, toxicity, twins, url_reputation, warc
from tabloom.llm.base import table
from tabloom.llm.registry import register


# The round trip in SQL: each text comes back, so its id, length and hash are those of the input.
@register(
    "op1_sentencepiece",
    """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS decoded_sha256, true AS round_trip
    FROM documents""",
)
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, its ids decoded, and the decoded text held against the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = sentence_pieces.encode_and_decode(docs)
    return decoded.select(
        "doc_id",
        F.octet_length("decoded").cast("long").alias("n_bytes"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@register("op9_line_rules", twins.LINE_RULES)
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the line-first rules for every document."""
    judged = line_rules.line_rules(table(spark, sf_dir, "documents"), cleaned=None, keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@register("op4_decontamination", twins.DECONTAMINATION)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items, and which items occur."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, items, keep=["doc_id"])
    hit = decontaminate.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@register("op8_toxicity")
def toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model fitted on a bounded sample of labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    rejected = F.col("expected_severity") >= toxicity.THRESHOLD
    return scored.withColumn("rejected", rejected)


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of pages whose document (the number that ends the path) has labels; good is fair quality and not toxic."""
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"/(\d{1,18})(?:\.html|/)?$", 1)
    pages = table(spark, sf_dir, "pages").select("url", number.try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return pages.join(labels, "doc_id").select("url", "good")


@register("op7_url_reputation", twins.URL_REPUTATION)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; outcomes are the labels of the documents that pages show."""
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), page_outcomes(spark, sf_dir))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@register(
    "op10_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, d.payload_digest,
      CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest""",
)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and assembled from its records."""
    captures = warc.round_trip(table(spark, sf_dir, "pages"))
    stated = F.col("metadata")[0]["fields"]
    return captures.select(
        stated["page-id"].cast("long").alias("page_id"),
        F.coalesce(F.col("response.payload_bytes"), stated["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        stated["refers-to-page-id"].cast("long").alias("refers_to"),
    )


@register("op3_jaccard_join", twins.JACCARD)
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and number of links of every document under Jaccard 0.85 of its sets of four-word shingles."""
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


@register("op5_suffix_dedup")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by a 100-byte string that starts earlier in the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, kept=False, keep=["doc_id"])


@register("op6_lattice_lm")
def lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice log10 probability of every document; both learn from the documents that are not held out."""
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"))


@register("op2_license_scan", twins.LICENSES)
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that a run of words of every document is like, over line ends too."""
    found = license_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"], windows=True)
    return found.select("doc_id", "license", "dice", F.array_join("licenses", ",").alias("licenses"), "n_lines")


@register("op13_source_audit", twins.SOURCE_AUDIT)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source's term shares lie from the other sources of its language, and its foremost terms."""
    return source_audit.audit(table(spark, sf_dir, "documents"))


@register("op12_spelling_groups")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words, the form it is a variant of, and the root of its chain of forms."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@register("op11_byte_pairs")
def byte_pair_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of the text that they give back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = byte_pairs.encode_and_decode(docs, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
