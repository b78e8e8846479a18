"""The registered queries of the training-data operators. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import (
    alignment,
    chat,
    decontam,
    filter_audit,
    jaccard,
    line_crf,
    line_dedup,
    mixing,
    pii,
    quality_rules,
    secrets,
    tokens,
    urls,
)
from catalith.llm.common import read
from catalith.session import scratch_path, settle

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(read(spark, sf, "documents").select("doc_id", "text"))
    base = tuple(kind.name for kind in pii.KINDS if kind.base)

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(pii.spans(F.col("findings"), base), 256).alias("base_sha256"),
        pii.spans(F.col("findings")).alias("spans"),
    )


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.find(
        read(spark, sf, "documents").select("doc_id", "text"),
        read(spark, sf, "benchmark"),
        keep_text=False,
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    measured = settle(quality_rules.measure(docs).drop("text"), "measured")
    good = read(spark, sf, "labels").where("quality = 1")
    return quality_rules.judge(measured, good).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    like = jaccard.Likeness(size=3, num=90, den=100)
    linked = jaccard.join(read(spark, sf, "documents").select("doc_id", "text"), like)
    return linked.select("doc_id", "n_shingles", "component_id")


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write all texts as token ids, read them back, and say what was read."""
    folder = scratch_path(spark, "tokens")
    tokens.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokens.read(spark, folder).select(
        "doc_id",
        "start",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op5_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_digests(spark, read(spark, sf, "documents").select("doc_id", "text"))


def op6_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    spans = F.transform(
        "secrets", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))
    )
    return secrets.scan(docs).select(
        "doc_id",
        "n_proposed",
        F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(spans, ",").alias("spans"),
    )


#: The rules of the query, host and path.
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op7_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url", "html")
    return urls.judge(pages, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "alias_of"
    )


def op8_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    stored = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(trap).alias("text"),
    )
    events = stored.unionByName(extra).select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.lit("message").alias("kind"),
        F.lit(None).cast("long").alias("target"),
        "role",
        "text",
    )
    written = settle(chat.format_chats(events), "chats")
    whole = chat.formatted(F.col("segments"))
    back = written.select(
        "conv_id",
        chat.loss_text(F.col("segments")).alias("loss"),
        whole.alias("whole"),
    ).select("conv_id", "loss", "whole", chat.parse(F.col("whole")).alias("turns"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("whole").cast("long").alias("formatted_chars"),
    )


def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labelled = read(spark, sf, "labels").where(~held_out)
    chain = line_crf.learn(docs, labelled.select("doc_id", F.col("quality").alias("label")))
    scored = line_crf.score(docs, chain, keep_text=False)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


#: Domains of labelled documents, and the shares of tokens they are to have.
MIX_TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}


def labelled_domains(spark: SparkSession, sf: str) -> DataFrame:
    domain = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic")
    return read(spark, sf, "labels").select("doc_id", domain.otherwise("good").alias("domain"))


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, labelled_domains(spark, sf), MIX_TARGETS, keep_text=False)
    return mixed.select(
        "doc_id",
        "n_tokens",
        *(F.get("posterior", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(MIX_TARGETS)),
        "rate",
        "copies",
    )


def op11_cross_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align_documents(read(spark, sf, "documents").select("doc_id", "text"), *paths)
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, read(spark, sf, "labels"))


def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    judged = line_dedup.dedup(read(spark, sf, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(line_dedup.apply_keep(F.col("text"), F.col("keep")), 256).alias("kept_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_decontamination": op2_decontamination,
        "op3_quality_rules": op3_quality_rules,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_token_ids": op5_token_ids,
        "op6_secret_scans": op6_secret_scans,
        "op7_url_filters": op7_url_filters,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_mixing": op10_mixing,
        "op11_cross_tokenizer": op11_cross_tokenizer,
        "op12_filter_audit": op12_filter_audit,
        "op13_line_dedup": op13_line_dedup,
    }
