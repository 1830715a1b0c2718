"""The registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlog.llm import oracles
from answerlog.llm.chat_format import formatted_digests
from answerlog.llm.classifier import classify, train
from answerlog.llm.fill_in_middle import fill_in_middle, restored
from answerlog.llm.jaccard_join import jaccard_join
from answerlog.llm.packing import packing
from answerlog.llm.prefix_trie import Rebuild, prefix_trie
from answerlog.llm.quality_rules import quality_rules
from answerlog.llm.registry import query, table
from answerlog.llm.secret_scans import BASE, listing, secret_scans
from answerlog.llm.sentencepiece_codec import sentencepiece_codec
from answerlog.llm.substring_dedup import substring_dedup
from answerlog.llm.suffix_dedup import suffix_dedup
from answerlog.llm.topk_search import top_k
from answerlog.llm.url_filters import host_and_path, url_filters

# Rules (action, host and path) of the url query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
# A domain whose first label has one of these words is put on the list of the url query.
LISTED_WORDS = ["casino", "adult", "free-bets", "ads-track", "spam-farm"]


@query("op1_quality_rules", oracles.quality_rules())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[f"quality.{name}" for name in names])


@query("op2_substring_dedup", oracles.substring_dedup())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "dedup.n_sentences", "dedup.n_removed",
        F.sha2(F.coalesce("dedup.text", F.lit("")), 256).alias("kept_sha256"),
    )


def listed_domains(pages: DataFrame) -> DataFrame:
    """Domains of the corpus to block: those whose first label holds a listed word."""
    labels = F.split(host_and_path(F.col("url"))[0], r"\.")
    domains = pages.select(labels.alias("labels")).distinct().select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("labels") - 1, F.lit(1))),
                lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."),
            )
        ).alias("key")
    )
    first = F.split_part("key", F.lit("."), F.lit(1))
    return domains.filter(first.rlike("|".join(LISTED_WORDS))).distinct()


@query("op3_url_filters", oracles.url_filters(URL_RULES, LISTED_WORDS))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters(pages, listed_domains(pages), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), payload=F.sha2("kept", 256).alias("kept_sha256"))


def byte_bpe() -> dict[str, str]:
    """Files of the byte-level tokenizer that sequences are packed with."""
    return {
        "path": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing(table(spark, sf_dir, "documents"), **byte_bpe(), payload=F.crc32("ids").alias("ids_crc32"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def hash_fifth(doc_id: str = "doc_id") -> Column:
    """Remainder by five of the CRC-32 of an id as text; that of '' for a null."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


@query("op7_byte_cnn_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = train(docs, table(spark, sf_dir, "labels"), "quality", hash_fifth() != 0)
    scored = classify(docs, network)
    return scored.select(
        "doc_id", (hash_fifth() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op8_secret_scans", oracles.secret_scans())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE
    ]
    return scanned.select(
        "doc_id", *counts, F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans")
    )


@query("op9_sentencepiece_codec")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_codec(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op10_topk_search", oracles.topk_search())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_fill_in_middle", oracles.fill_in_middle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ["n", "form", "prefix_chars", "middle_chars"]
    back = restored(F.col("fim.output"), F.col("fim.form"))
    return made.select(
        "doc_id", *[f"fim.{name}" for name in fields],
        F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one, number -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select(*probe.columns).unionByName(probe)


@query("op12_chat_format", oracles.chat_format())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatted_digests(with_probe(table(spark, sf_dir, "conversations")))
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "state"]
    return found.select("conv_id", *names)


def id_remainder(number: int) -> Callable[[Column], Column]:
    """Remainder of the unsigned CRC-32 of an id in decimal."""
    return lambda c: F.crc32(c.cast("string").cast("binary")) % number


@query("op13_prefix_trie", oracles.prefix_trie())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuild = Rebuild(borrowed=id_remainder(9), source=lambda c: c - c % 5)
    return prefix_trie(table(spark, sf_dir, "conversations"), rebuild)
