"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from foldsmith.llm import decontamination, hpyp, language, lines, pieces, preference, rans, repetition, search, simhash, toxicity, trie, urls
from foldsmith.session import table


def op1_simhash(spark, sf_dir):
    """SimHash near-duplicates of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_repetition(spark, sf_dir):
    """Quality rules on repetition over all documents."""
    out = repetition.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_rans(spark, sf_dir):
    """Token ids of all documents, written in rANS blocks and read back."""
    return rans.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_decontamination(spark, sf_dir):
    """Test items held by any document."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark, sf_dir):
    """Toxicity of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_model(toxicity.sampled_rows(docs, table(spark, sf_dir, "labels")))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "spans")


def op10_language(spark, sf_dir):
    """Language of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.train_model(language.learning_rows(docs))
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_pieces(spark, sf_dir):
    """SentencePiece ids of all documents by the max-plus scan, decoded again."""
    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_urls(spark, sf_dir):
    """Verdict on every page's URL."""
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op8_preference(spark, sf_dir):
    """Preference pairs of all conversations 2k and 2k + 1; spans as start-end,start-end."""
    turns = table(spark, sf_dir, "conversations")
    out = preference.format_pairs(preference.neighbour_pairs(turns), turns)
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",") for c in ("chosen_loss", "rejected_loss")}
    return out.withColumns(spans)


def op3_hpyp(spark, sf_dir):
    """Language-model scores of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("train", ~hpyp.held_out())
    out = hpyp.score(docs)
    return out.select("doc_id", hpyp.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op11_trie(spark, sf_dir):
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie.prefix_nodes(table(spark, sf_dir, "conversations")).drop("slot")


def op12_search(spark, sf_dir):
    """The twenty best documents for every benchmark item."""
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lines(spark, sf_dir):
    """Line dedup of all documents through the reversible index."""
    out = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
