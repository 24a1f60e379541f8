"""Registered queries: each applies one operator to its whole table and returns the rows its contract asks for."""

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from usagelens.llm import (
    bpe, decontaminate, langid, merkle, pii, quality, rules, secrets, sharding, simhash, trie, vectors, warc)
from usagelens.llm.common import stage

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text_crc(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_bpe(spark, sf_dir):
    """Token counts and digests of ids and decoded bytes."""
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), bpe.load_ranks(VOCABULARY), public_tokenizers.PATTERN,
                          answer="digests")


def op2_simhash(spark, sf_dir):
    """Fingerprints and groups of near copies."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op3_vectors(spark, sf_dir):
    """Links and groups of near-equal vectors."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_decontaminate(spark, sf_dir):
    """Words and items that each document shares with the benchmark."""
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("hits", F.lit(0).cast("long"),
                      lambda total, hit: total + hit["last_word"] - hit["first_word"] + 1)
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_warc(spark, sf_dir):
    """What each page became in the archives."""
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op6_quality(spark, sf_dir):
    """Quality of each document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(_text_crc("doc_id") % 5 == 0, F.lit(False)).alias("held_out"))
    network = quality.train(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    return quality.score(docs, network, keep=["doc_id", "held_out"]).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_pii(spark, sf_dir):
    """Counts and places of personal data."""
    found = pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def number(kind):
        return F.size(F.filter("pii_spans", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda span: F.concat_ws(
            ":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))), ",")

    base = F.filter("pii_spans", lambda span: span["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *[number(kind) for kind in pii.BASE_KINDS],
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("pii_spans")).alias("spans"))


def op8_sharding(spark, sf_dir):
    """Shard and slot of each document under the law of equal row counts."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return sharding.shuffle_to_shards(sized, 16, bytes_col="size").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_secrets(spark, sf_dir):
    """Every candidate of every document with the forest's score; values only as digests."""
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "end", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "secret")


def op10_langid(spark, sf_dir):
    """Language of each document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = _text_crc("doc_id") % 4 == 2
    model = langid.train(docs.filter(~F.coalesce(held_out, F.lit(False))))
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return langid.identify(marked, model, keep=["doc_id", "held_out"], spans=False)


def op11_trie(spark, sf_dir):
    """Prefix trie of all conversations, rebuilt to start with turns of every twentieth one."""
    turns, _ = stage(trie.turn_rows(table(spark, sf_dir, "conversations")), "turns")
    base = F.col("conv_id") - F.col("conv_id") % 20
    return trie.trie(trie.rebranched(turns, base, _text_crc("conv_id") % 4, 3))


def op12_rules(spark, sf_dir):
    """Measurements of each document, and what the base rules and the current policy say."""
    kept = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    base = F.col("failed").bitwiseAND(F.lit(rules.BASE)) != 0
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed")


def op13_merkle(spark, sf_dir):
    """Digests and proofs of all documents, and whether texts without their line feeds still fold to the root."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(_text_crc("doc_id") % 2 == 0, F.lit(False))
    changed = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.leaf_digest(fields).alias("leaf"), "lang", "n_chars", changed.alias("text"))
    shown = leaves.select("doc_id", "source", "leaf", merkle.leaf_digest(fields).alias("shown"))
    return merkle.verify(merkle.build(shown, "source", ["doc_id"], ["doc_id", "shown"]), "shown").select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {query.__name__: query for query in (
    op1_bpe, op2_simhash, op3_vectors, op4_decontaminate, op5_warc, op6_quality, op7_pii, op8_sharding, op9_secrets,
    op10_langid, op11_trie, op12_rules, op13_merkle)}
