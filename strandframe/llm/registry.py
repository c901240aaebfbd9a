"""The queries opN_<name> over the driver's tables, each with SQL where SQL can express it."""

from __future__ import annotations

from strandframe.llm import katz, lines, mixing, packing, quality, secrets_scan, simhash, substrings, transport, warc

#: A module has query(spark, sf_dir) and ORACLE_SQL (None where SQL can't express it).
MODULES = {
    "op1_katz_backoff": katz,
    "op2_substring_dedup": substrings,
    "op3_simhash": simhash,
    "op4_quality_rules": quality,
    "op5_secret_scan": secrets_scan,
    "op6_line_dedup": lines,
    "op7_mix_sources": mixing,
    "op8_warc_packages": warc,
    "op9_transport_streams": transport,
    "op10_best_fit_packing": packing,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if module.ORACLE_SQL}
