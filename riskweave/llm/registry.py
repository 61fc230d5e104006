"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from riskweave.llm.decontaminate import OP3_SQL, op3_decontaminate
from riskweave.llm.fair_mix import OP4_SQL, op4_fair_mix
from riskweave.llm.license_scan import OP2_SQL, op2_license_scan
from riskweave.llm.line_templates import OP7_SQL, op7_line_templates
from riskweave.llm.minhash import OP10_SQL, op10_minhash
from riskweave.llm.periodic_runs import OP11_SQL, op11_periodic_runs
from riskweave.llm.pu_quality import op1_pu_quality
from riskweave.llm.quality_rules import OP9_SQL, op9_quality_rules
from riskweave.llm.substring_dedup import OP12_SQL, op12_substring_dedup
from riskweave.llm.suffix_dedup import op5_suffix_dedup
from riskweave.llm.toxicity import op6_toxicity
from riskweave.llm.url_filter import OP8_SQL, op8_url_filter
from riskweave.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_pu_quality": op1_pu_quality,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_fair_mix": op4_fair_mix,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_line_templates": op7_line_templates,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash": op10_minhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {
    "op2_license_scan": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_fair_mix": OP4_SQL,
    "op7_line_templates": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_minhash": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
