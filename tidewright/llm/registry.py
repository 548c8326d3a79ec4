"""Queries of the training-data operators and, where SQL can say it, their DuckDB SQL."""

from . import ann, decontaminate, hardneg, hmm, langid, licenses, packing, periods, quotes, simhash, substring, tokens, toxicity

QUERIES = {
    "op1_simhash_dedup": simhash.op1_simhash_dedup,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_nearest_neighbours": ann.op3_nearest_neighbours,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_quotation_linking": quotes.op6_quotation_linking,
    "quoted_replies": quotes.quoted_replies,
    "op7_lm_scoring": hmm.op7_lm_scoring,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_language_id": langid.op9_language_id,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_license_scan": licenses.op11_license_scan,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

ORACLE = {
    "op12_hard_negatives": hardneg.OP12_SQL,
    "op11_license_scan": licenses.OP11_SQL,
    "op2_substring_dedup": substring.OP2_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op6_quotation_linking": quotes.OP6_SQL,
    "quoted_replies": quotes.QUOTED_SQL,
}
