"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from frameflow.llm.audit import OP13_SQL, op13_filter_audit
from frameflow.llm.chat import OP1_SQL, op1_chat_prefix_target
from frameflow.llm.decontaminate import OP5_SQL, op5_benchmark_decontamination
from frameflow.llm.fingerprints import op8_canonical_digest
from frameflow.llm.licenses import op6_license_scan
from frameflow.llm.lines import OP9_SQL, op9_line_dedup
from frameflow.llm.mixing import OP4_SQL, op4_mix_curriculum
from frameflow.llm.paragraphs import OP3_SQL, op3_paragraph_dedup
from frameflow.llm.partenum import OP10_SQL, op10_partenum_jaccard
from frameflow.llm.pii import op2_pii_spans
from frameflow.llm.resampling import OP11_SQL, op11_importance_resampling
from frameflow.llm.topk import OP12_SQL, op12_exact_topk
from frameflow.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_prefix_target, op2_pii_spans, op3_paragraph_dedup, op4_mix_curriculum, op5_benchmark_decontamination, op6_license_scan,
        op7_toxicity, op8_canonical_digest, op9_line_dedup, op10_partenum_jaccard, op11_importance_resampling, op12_exact_topk, op13_filter_audit,
    )
}
SQL = {
    "op1_chat_prefix_target": OP1_SQL, "op3_paragraph_dedup": OP3_SQL, "op4_mix_curriculum": OP4_SQL, "op5_benchmark_decontamination": OP5_SQL, "op9_line_dedup": OP9_SQL, "op10_partenum_jaccard": OP10_SQL,
    "op11_importance_resampling": OP11_SQL, "op12_exact_topk": OP12_SQL, "op13_filter_audit": OP13_SQL,
}
