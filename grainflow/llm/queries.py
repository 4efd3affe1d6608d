"""The operators of this subpackage, bound to the standard tables, and their SQL."""

from __future__ import annotations

from grainflow.llm import boilerplate, compression, covertree, crf, decontamination, kmeans, mixture, neardup, reputation, tokens, vafile, warc, whitening

QUERIES = {
    "op1_va_file_search": vafile.query,
    "op2_token_counts": tokens.query,
    "op3_curriculum_mix": mixture.query,
    "op4_line_dedup": boilerplate.query,
    "op5_warc_derivatives": warc.query,
    "op6_language_crf": crf.query,
    "op7_host_reputation": reputation.query,
    "op8_compression_quality": compression.query,
    "op9_superminhash_groups": neardup.query,
    "op10_benchmark_qgrams": decontamination.query,
    "op11_cover_tree_groups": covertree.query,
    "op12_residue_whitening": whitening.query,
    "op13_elkan_centroids": kmeans.query,
}
SQL = {"op1_va_file_search": vafile.SQL, "op3_curriculum_mix": mixture.SQL, "op4_line_dedup": boilerplate.SQL, "op7_host_reputation": reputation.SQL}
