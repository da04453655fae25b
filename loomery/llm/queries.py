"""The registered queries of this subpackage, with the parameters they run by, and their SQL."""

from __future__ import annotations

from . import ann, centroids, fill_middle, minhash_dedup, mixing, packing, quality, quality_classifier, sharding, substring_dedup, suffix_dedup, token_counts, toxicity
from .common import table


def _over(name, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES = {
    "op1_histogram_sort": _over("documents", sharding.assign),
    "op2_ivf_pq": _over("embeddings", ann.nearest),
    "op3_suffix_array_dedup": _over("documents", suffix_dedup.repeat_digest),
    "op4_tensored_minhash": _over("documents", minhash_dedup.component_digest),
    "op5_tfidf_neighbours": lambda spark, sf_dir: toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_edit_aware_tokens": _over("documents", token_counts.edited_counts),
    "op7_suffix_tree_dedup": _over("documents", substring_dedup.repeat_digest),
    "op8_quality_rules": _over("documents", quality.quality_digest),
    "op9_length_buckets": _over("documents", packing.pack_digest),
    "op10_source_mixing": _over("documents", mixing.mix_digest),
    "op11_centroid_clustering": _over("embeddings", centroids.cluster_digest),
    "op12_quality_classifier": lambda spark, sf_dir: quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_fill_in_middle": _over("documents", fill_middle.fill_digest),
}

ORACLE_SQL = {"op10_source_mixing": mixing.ORACLE, "op11_centroid_clustering": centroids.ORACLE, "op13_fill_in_middle": fill_middle.ORACLE}
