"""The registered query of each operator of this subpackage, with production parameters over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, exact_dedup, html_extract, langid, lm_score, mixing, packing, quality, simhash, substring
from .common import table


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_collinear_chaining(spark, sf_dir):
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op8_attention_lm(spark, sf_dir):
    return lm_score.score_corpus(table(spark, sf_dir, "documents"))


def op9_simhash_tiles(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_entropy_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op1_main_text(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality_fm(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_projection_forest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language_profiles(spark, sf_dir):
    return langid.predict_languages(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_quality_fm": op2_quality_fm,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_projection_forest": op4_projection_forest,
    "op5_language_profiles": op5_language_profiles,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_collinear_chaining": op7_collinear_chaining,
    "op8_attention_lm": op8_attention_lm,
    "op9_simhash_tiles": op9_simhash_tiles,
    "op10_entropy_mix": op10_entropy_mix,
}

ORACLE_SQL = {
    "op6_exact_dedup": r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents),
g as (select bare, count(*) as group_size, arg_min(doc_id, (-length(text), doc_id)) as keep_id from t group by bare)
select t.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, t.doc_id = g.keep_id as kept, sha256(t.bare) as text_sha256
from t join g using (bare)""",
}
