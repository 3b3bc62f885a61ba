"""Queries of the operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkwake.llm.alignment import op13_token_alignment
from sparkwake.llm.ann import ORACLE_SQL as NEAREST_SQL
from sparkwake.llm.ann import op4_nearest_neighbours
from sparkwake.llm.bpe import op3_byte_bpe
from sparkwake.llm.decontaminate import ORACLE_SQL as DECONTAMINATION_SQL
from sparkwake.llm.decontaminate import op12_decontamination
from sparkwake.llm.hmm import op10_hmm_scores
from sparkwake.llm.language_id import op1_language_id
from sparkwake.llm.license_scan import op5_license_scans
from sparkwake.llm.packing import op9_best_fit_packing
from sparkwake.llm.pii import op7_pii
from sparkwake.llm.secret_scan import op8_secret_scans
from sparkwake.llm.simhash import op2_simhash
from sparkwake.llm.sort_means import ORACLE_SQL as SORT_MEANS_SQL
from sparkwake.llm.sort_means import op11_sort_means
from sparkwake.llm.syncmers import op6_syncmers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_license_scans": op5_license_scans,
    "op6_syncmers": op6_syncmers,
    "op7_pii": op7_pii,
    "op8_secret_scans": op8_secret_scans,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_hmm_scores": op10_hmm_scores,
    "op11_sort_means": op11_sort_means,
    "op12_decontamination": op12_decontamination,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op4_nearest_neighbours": NEAREST_SQL,
    "op11_sort_means": SORT_MEANS_SQL,
    "op12_decontamination": DECONTAMINATION_SQL,
}
