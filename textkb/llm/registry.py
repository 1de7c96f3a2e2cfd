"""The queries of the training-data operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from . import collocations, decontamination, hard_negatives, language_id, mixing, nearest, ngram_jaccard, packing, quality, quality_rules, secrets, toxicity, warc

QUERIES = {
    "op7_nearest": nearest.op7_nearest,
    "op6_decontamination": decontamination.op6_decontamination,
    "op2_packing": packing.op2_packing,
    "op1_language_id": language_id.op1_language_id,
    "op5_toxicity": toxicity.op5_toxicity,
    "op9_quality": quality.op9_quality,
    "op3_warc": warc.op3_warc,
    "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
    "op8_mixing": mixing.op8_mixing,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES: dict[str, str] = {
    "op3_warc": warc.OP3_SQL,
    "op4_ngram_jaccard": ngram_jaccard.OP4_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_quality_rules": quality_rules.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
