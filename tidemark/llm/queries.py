"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import lines, merkle, middle, mixing, near, packing, quality, search, substrings, tiers, toxicity, urls
from .common import table


def op1_line_dedup(spark, sf_dir):
    return lines.digest(table(spark, sf_dir, "documents"))


def op2_pack_sequences(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark, sf_dir):
    return search.exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_nearest_neighbours(spark, sf_dir):
    return search.nearest(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op6_repeated_strings(spark, sf_dir):
    return substrings.digest(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark, sf_dir):
    return middle.digest(table(spark, sf_dir, "documents"))


def op12_tiered_packing(spark, sf_dir):
    return tiers.pack_documents(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.digest(table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    return {"op1_line_dedup": lines.SQL, "op3_exact_top_k": search.EXACT_SQL, "op8_mix_sources": mixing.SQL, "op11_fill_in_middle": middle.SQL, "op13_merkle_manifest": merkle.SQL}
