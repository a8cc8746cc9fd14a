"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from . import bpe, embeddings, fingerprint, hosts, minhash, mixing, phrases, preferences, quality, secrets, separators, toxicity, whitening

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_secrets": secrets.op3_secrets,
    "op4_preferences": preferences.op4_preferences,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_token_counts": separators.op6_token_counts,
    "op7_bpe": bpe.op7_bpe,
    "op8_minhash": minhash.op8_minhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_embeddings": embeddings.op10_embeddings,
    "op11_phrases": phrases.op11_phrases,
    "op12_whitening": whitening.op12_whitening,
    "op13_host_rules": hosts.op13_host_rules,
}

ORACLES = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "op4_preferences": preferences.OP4_SQL,
    "op8_minhash": minhash.OP8_SQL,
    "op10_embeddings": embeddings.OP10_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op13_host_rules": hosts.OP13_SQL,
}
