"""The queries of this folder, each over its whole tables, and SQL where it can say the same."""

from __future__ import annotations

from . import backoff, clusters, decontaminate, language, media, minhash, pieces, resampling, sharding, token_counts, token_file, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_minhash": minhash.query,
    "op3_decontaminate": decontaminate.query,
    "op4_backoff": backoff.query,
    "op5_warc": warc.query,
    "op6_media": media.query,
    "op7_language": language.query,
    "op8_pieces": pieces.query,
    "op9_shards": sharding.query,
    "op10_token_file": token_file.query,
    "op11_clusters": clusters.query,
    "op12_resampling": resampling.query,
    "op13_token_counts": token_counts.query,
}
ORACLES = {"op3_decontaminate": decontaminate.ORACLE, "op4_backoff": backoff.ORACLE, "op11_clusters": clusters.ORACLE, "op12_resampling": resampling.ORACLE}
