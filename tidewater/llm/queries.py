"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontam import op6_cgk_decontamination
from .media import op1_media_sniffing
from .minhash import OP4_SQL, op4_circulant_minhash
from .mixing import op10_source_mixing
from .quality import op8_nbsvm_quality
from .quotes import OP7_SQL, op7_quote_linking
from .sharding import op2_jump_sharding
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .toxicity import op5_string_kernel_toxicity
from .warc import OP9_SQL, op9_warc_reassembly

QUERIES = {
    f.__name__: f
    for f in (
        op1_media_sniffing,
        op2_jump_sharding,
        op3_substring_dedup,
        op4_circulant_minhash,
        op5_string_kernel_toxicity,
        op6_cgk_decontamination,
        op7_quote_linking,
        op8_nbsvm_quality,
        op9_warc_reassembly,
        op10_source_mixing,
    )
}
SQL = {"op3_substring_dedup": OP3_SQL, "op4_circulant_minhash": OP4_SQL, "op7_quote_linking": OP7_SQL, "op9_warc_reassembly": OP9_SQL}
