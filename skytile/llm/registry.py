"""The queries of this subpackage by name, and the SQL that DuckDB can run for the same rows."""

from __future__ import annotations

from skytile.llm.alignment import op13_token_alignment
from skytile.llm.fingerprint import op1_improbable_digest
from skytile.llm.jaccard import op7_jaccard_components
from skytile.llm.language import op10_language_id
from skytile.llm.lines import OP11_SQL, op11_line_dedup
from skytile.llm.mixing import OP8_SQL, op8_temperature_mix
from skytile.llm.negatives import OP12_SQL, op12_lemp_negatives
from skytile.llm.packing import op9_lexical_packing
from skytile.llm.permutation_index import op6_permutation_index
from skytile.llm.simple8b import op4_simple8b
from skytile.llm.suffixes import op3_suffix_dedup
from skytile.llm.surrogates import op2_surrogates
from skytile.llm.warc import OP5_SQL, op5_warc_chunks

QUERIES = {
    "op1_improbable_digest": op1_improbable_digest,
    "op2_surrogates": op2_surrogates,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simple8b": op4_simple8b,
    "op5_warc_chunks": op5_warc_chunks,
    "op6_permutation_index": op6_permutation_index,
    "op7_jaccard_components": op7_jaccard_components,
    "op8_temperature_mix": op8_temperature_mix,
    "op9_lexical_packing": op9_lexical_packing,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_lemp_negatives": op12_lemp_negatives,
    "op13_token_alignment": op13_token_alignment,
}
SQL = {"op5_warc_chunks": OP5_SQL, "op8_temperature_mix": OP8_SQL, "op11_line_dedup": OP11_SQL, "op12_lemp_negatives": OP12_SQL}
