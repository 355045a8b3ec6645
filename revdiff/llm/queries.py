"""The registered queries of the training-data operators over the test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from revdiff.llm import bag_search, chat, exact_dedup, langid, licenses, mixing, near_dup, oracle, packing, periodic, pii, quality, search, token_counts
from revdiff.llm.common import read

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), WORD_BPE)


def op2_source_mix(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).drop("sources")


def op3_personal_data(spark, sf_dir):
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op5_language_id(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_chat_trees(spark, sf_dir):
    marked = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    convs = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes, ends = chat.format_conversations(convs.union(spark.createDataFrame(marked, convs.schema)))
    return ends.join(chat.read_back(nodes), ["sequence_id", "start"]).drop("sequence_id", "start")


def op7_top_k(spark, sf_dir):
    return search.top_k(read(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(read(spark, sf_dir, "documents")).drop("h1", "h2")


def op9_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), WORD_BPE)


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op12_bag_search(spark, sf_dir):
    return bag_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def looped(docs):
    """``docs`` where the words of a tenth of the texts, by checksum of their id, repeat from some place on."""
    check = "crc32(cast(doc_id AS string))"
    words = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
    text = f"""transform(transform(array(named_struct('w', {words}, 'g', {check} div 10)), x -> named_struct('w', x.w, 'a', x.g % size(x.w), 'd', 3 + x.g % 8)),
      x -> concat_ws(' ', transform(x.w, (word, i) -> IF(i < x.a, word, x.w[int(x.a + (i - x.a) % (1 + (size(x.w) - x.a) div x.d))]))))[0]"""
    return docs.select("doc_id", F.expr(f"CASE WHEN {check} % 10 = 0 AND text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]' THEN {text} ELSE text END").alias("text"))


def op13_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(looped(read(spark, sf_dir, "documents")))
    longest = "array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))"
    return found.select("doc_id", "runs", "collapsed", F.expr(longest).alias("m")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.start")).alias("start"), "m.length", (-F.col("m.period")).alias("period"),
        F.expr("1000 * m.length div -m.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), '\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_source_mix, op3_personal_data, op4_packing, op5_language_id, op6_chat_trees, op7_top_k, op8_near_duplicates,
    op9_license_scan, op10_quality_rules, op11_exact_dedup, op12_bag_search, op13_periodic_runs,
)}
SQL = dict(oracle.SQL)
