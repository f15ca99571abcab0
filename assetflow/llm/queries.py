"""The queries of this package and, where SQL can state them, the same result as DuckDB SQL."""

from __future__ import annotations

from assetflow.llm import (
    alignment,
    bpe,
    decontam,
    hardneg,
    htmltree,
    langmodel,
    neardup,
    quality,
    sharding,
    tokenfiles,
    toxicity,
    urlrules,
    warc,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_odd_sketches": neardup.op2_odd_sketches,
    "op3_archive": warc.op3_archive,
    "op4_pitman_yor": langmodel.op4_pitman_yor,
    "op5_url_rules": urlrules.op5_url_rules,
    "op6_kd_shards": sharding.op6_kd_shards,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_main_text": htmltree.op8_main_text,
    "op9_bpe": bpe.op9_bpe,
    "op10_repetition": quality.op10_repetition,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_token_files": tokenfiles.op12_token_files,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op3_archive": warc.sql(),
    "op7_decontaminate": decontam.sql(),
    "op10_repetition": quality.sql(),
    "op11_hard_negatives": hardneg.sql(),
}
