"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from ostinato.llm import divergence, langid, lexical, licenses, lm_scoring, metric_join, mixing, ngram_join, pieces, pii, secrets, tiff, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_warc_archives": warc.op3_warc_archives,
    "op4_media_tiff": tiff.op4_media_tiff,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_metric_join": metric_join.op6_metric_join,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_language_id": langid.op8_language_id,
    "op9_pii_pseudonyms": pii.op9_pii_pseudonyms,
    "op10_piece_segmentation": pieces.op10_piece_segmentation,
    "op11_divergence_audit": divergence.op11_divergence_audit,
    "op12_lm_scoring": lm_scoring.op12_lm_scoring,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op3_warc_archives": warc.OP3_SQL,
    "op6_metric_join": metric_join.OP6_SQL,
    "op11_divergence_audit": divergence.OP11_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
