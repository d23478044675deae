"""Registry of this subpackage's queries and of the SQL that states the same results."""

from __future__ import annotations

from lodestar.llm import op1_mix as op1
from lodestar.llm import op10_simhash as op10
from lodestar.llm import op2_exact_dedup as op2
from lodestar.llm import op3_license as op3
from lodestar.llm import op4_suffix_dedup as op4
from lodestar.llm import op5_lm_score as op5
from lodestar.llm import op6_decontaminate as op6
from lodestar.llm import op7_shard as op7
from lodestar.llm import op8_language as op8
from lodestar.llm import op9_secrets as op9

QUERIES = {
    "op1_mix": op1.op1_mix,
    "op2_exact_dedup": op2.op2_exact_dedup,
    "op3_license": op3.op3_license,
    "op4_suffix_dedup": op4.op4_suffix_dedup,
    "op5_lm_score": op5.op5_lm_score,
    "op6_decontaminate": op6.op6_decontaminate,
    "op7_shard": op7.op7_shard,
    "op8_language": op8.op8_language,
    "op9_secrets": op9.op9_secrets,
    "op10_simhash": op10.op10_simhash,
}
ORACLE = {"op2_exact_dedup": op2.SQL, "op4_suffix_dedup": op4.SQL, "op5_lm_score": op5.SQL, "op9_secrets": op9.SQL}
