"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import collocations, conversations, decontaminate, exact_dedup, html_text, language, mixing, near_dedup, passages, pii, quality, token_store, toxicity

QUERIES = {
    "op5_passages": passages.op5_passages,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op3_html_text": html_text.op3_html_text,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op1_language": language.op1_language,
    "op2_pii": pii.op2_pii,
    "op4_token_store": token_store.op4_token_store,
    "op8_mixing": mixing.op8_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op11_quality": quality.op11_quality,
    "op12_collocations": collocations.op12_collocations,
    "op13_conversations": conversations.op13_conversations,
}
ORACLE = {
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_conversations": conversations.ORACLE,
}
