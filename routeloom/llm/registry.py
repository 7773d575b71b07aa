"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from routeloom.llm.decontamination import OP4_SQL, op4_decontamination
from routeloom.llm.html import op9_html
from routeloom.llm.merkle import OP3_SQL, op3_merkle
from routeloom.llm.mixing import OP2_SQL, op2_mixing
from routeloom.llm.pii import op10_pii
from routeloom.llm.quality import op6_quality
from routeloom.llm.sharding import op7_sharding
from routeloom.llm.simhash import op5_simhash
from routeloom.llm.substrings import OP8_SQL, op8_substrings
from routeloom.llm.urls import OP1_SQL, op1_urls

QUERIES = {
    "op1_urls": op1_urls,
    "op2_mixing": op2_mixing,
    "op3_merkle": op3_merkle,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_substrings": op8_substrings,
    "op9_html": op9_html,
    "op10_pii": op10_pii,
}

ORACLE_SQL = {
    "op1_urls": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op3_merkle": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op8_substrings": OP8_SQL,
}
