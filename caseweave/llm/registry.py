"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language, licenses, mixing, pii, sharding, simhash, token_counts, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_language_id": language.op4_language_id,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_mixing": mixing.op7_mixing,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_sharding": sharding.op9_sharding,
    "op10_pii": pii.op10_pii,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
}
