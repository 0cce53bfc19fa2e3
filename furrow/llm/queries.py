"""The training-data queries and their SQL."""

from __future__ import annotations

from . import ann, decontam, langid, licences, packing, pii, simhash, tokenfile, warc, wordpiece

QUERIES = {
    f.__name__: f
    for f in (
        licences.op1_licence_scan,
        packing.op2_best_fit_packing,
        warc.op3_warc,
        tokenfile.op4_token_files,
        decontam.op5_decontamination,
        wordpiece.op6_token_counts,
        pii.op7_pii,
        langid.op8_language_id,
        simhash.op9_simhash,
        ann.op10_anisotropic_search,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_licence_scan": licences.OP1_SQL, "op3_warc": warc.OP3_SQL, "op5_decontamination": decontam.OP5_SQL}
