"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, centroids, decontaminate, line_dedup, lm_score, quality, secrets, simhash, substring, token_counts, toxicity, turns, winnow

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_quality": quality.query,
    "op3_lm_score": lm_score.query,
    "op4_substring": substring.query,
    "op5_winnowing": winnow.query,
    "op6_token_counts": token_counts.query,
    "op7_decontamination": decontaminate.query,
    "op8_simhash": simhash.query,
    "op9_bpe": bpe.query,
    "op10_secrets": secrets.query,
    "op11_centroids": centroids.query,
    "op12_toxicity": toxicity.query,
    "op13_turns": turns.query,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op13_turns": turns.ORACLE,
}
