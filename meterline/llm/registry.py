"""The queries of this subpackage, for ``__spark_entry__.py``."""

from meterline.llm import byte_bpe, chat_format, exact_topk, html_text, lm_score, near_dedup, packing, periodic, preference, quality, secrets, token_links, token_output


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_lm_score": lm_score.op2_lm_score,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_secrets": secrets.op4_secrets,
        "op5_quality": quality.op5_quality,
        "op6_exact_topk": exact_topk.op6_exact_topk,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_html_text": html_text.op9_html_text,
        "op10_token_output": token_output.op10_token_output,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_token_links": token_links.op12_token_links,
        "op13_preference": preference.op13_preference,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": secrets.ORACLE, "op6_exact_topk": exact_topk.ORACLE}
