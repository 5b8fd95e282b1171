"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, embeddings, html, language, licenses, mixing, mpeg, pieces, repair, resample, sharding, simhash, whitening

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_html": html.op2_html,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_mpeg": mpeg.op4_mpeg,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_mixing": mixing.op6_mixing,
    "op7_licenses": licenses.op7_licenses,
    "op8_simhash": simhash.op8_simhash,
    "op9_language": language.op9_language,
    "op10_repair": repair.op10_repair,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_whitening": whitening.op12_whitening,
    "op13_resample": resample.op13_resample,
}

SQL = {"op6_mixing": mixing.OP6_SQL, "op11_decontaminate": decontaminate.OP11_SQL}
