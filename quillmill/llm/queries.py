"""The runnable queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from quillmill.llm import oracles
from quillmill.llm.alignment import op13_tokenizer_alignment
from quillmill.llm.bpe import op7_byte_bpe
from quillmill.llm.decontaminate import op11_decontamination
from quillmill.llm.fingerprints import op1_document_fingerprints
from quillmill.llm.line_dedup import op10_line_dedup
from quillmill.llm.line_quality import op3_line_quality
from quillmill.llm.mixing import op5_mixing
from quillmill.llm.pii import op2_personal_data
from quillmill.llm.quality import op6_quality_classifier
from quillmill.llm.resample import op12_importance_resampling
from quillmill.llm.simhash import op9_simhash_dedup
from quillmill.llm.token_counts import op8_token_counts
from quillmill.llm.warc import op4_warc_index

QUERIES = {
    run.__name__: run
    for run in (
        op1_document_fingerprints,
        op2_personal_data,
        op3_line_quality,
        op4_warc_index,
        op5_mixing,
        op6_quality_classifier,
        op7_byte_bpe,
        op8_token_counts,
        op9_simhash_dedup,
        op10_line_dedup,
        op11_decontamination,
        op12_importance_resampling,
        op13_tokenizer_alignment,
    )
}
ORACLES = {
    "op3_line_quality": oracles.OP3,
    "op4_warc_index": oracles.OP4,
    "op5_mixing": oracles.OP5,
    "op10_line_dedup": oracles.OP10,
    "op11_decontamination": oracles.OP11,
    "op12_importance_resampling": oracles.OP12,
}
