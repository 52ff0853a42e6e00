"""Registry of the operators' queries and their SQL."""

from helixframe.llm import fingerprints, jaccard_join, languages, licenses, mixing, neighbors, phrases, quality, sentence_pieces, sharding, token_counts, web_archives, whitening


def queries() -> dict:
    return {
        "op1_kd_sharding": sharding.op1_kd_sharding,
        "op2_hd_language_id": languages.op2_hd_language_id,
        "op3_exact_digest": fingerprints.op3_exact_digest,
        "op4_diagonal_voting": licenses.op4_diagonal_voting,
        "op5_golden_schedule": mixing.op5_golden_schedule,
        "op6_additive_quantisation": neighbors.op6_additive_quantisation,
        "op8_separator_scan": token_counts.op8_separator_scan,
        "op9_sentencepiece_wfst": sentence_pieces.op9_sentencepiece_wfst,
        "op10_metric_jaccard": jaccard_join.op10_metric_jaccard,
        "op7_ftrl_quality": quality.op7_ftrl_quality,
        "op11_zip_warc": web_archives.op11_zip_warc,
        "op12_svd_whitening": whitening.op12_svd_whitening,
        "op13_apriori_phrases": phrases.op13_apriori_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_zip_warc": web_archives.SQL, "op13_apriori_phrases": phrases.SQL}
