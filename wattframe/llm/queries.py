"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from wattframe.llm.contamination import op10_decontamination
from wattframe.llm.conversations import OP13_SQL, op13_conversation_repair
from wattframe.llm.language import op7_language_id
from wattframe.llm.licenses import op6_license_scan, oracle as op6_sql
from wattframe.llm.minhash import OP2_SQL, op2_minhash_near_dedup
from wattframe.llm.mixing import op8_source_mixing
from wattframe.llm.passages import op5_substring_dedup
from wattframe.llm.quality import op1_quality_rules
from wattframe.llm.scoring import op3_lm_scoring
from wattframe.llm.search import OP11_SQL, op11_lexical_search
from wattframe.llm.suffixes import op12_suffix_array_dedup
from wattframe.llm.urls import OP4_SQL, op4_url_filters
from wattframe.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_url_filters": op4_url_filters,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

#: The others are trained, iterate, or hash in ways that SQL lacks; tests hold them to brute force.
ORACLE = {
    "op2_minhash_near_dedup": OP2_SQL,
    "op4_url_filters": OP4_SQL,
    "op6_license_scan": op6_sql(),
    "op9_warc": OP9_SQL,
    "op11_lexical_search": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
}
