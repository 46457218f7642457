"""The operators' queries by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from quarry.llm import bpe, chat, html, leaks, lexical, lines, mixing, nearest, prefixes, quality, simhash, substring, warc


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_substring": substring.op2_substring,
        "op3_lines": lines.op3_lines,
        "op4_leaks": leaks.op4_leaks,
        "op5_nearest": nearest.op5_nearest,
        "op6_warc": warc.op6_warc,
        "op7_quality": quality.op7_quality,
        "op8_simhash": simhash.op8_simhash,
        "op9_chat": chat.op9_chat,
        "op10_html": html.op10_html,
        "op11_mixing": mixing.op11_mixing,
        "op12_lexical": lexical.op12_lexical,
        "op13_prefixes": prefixes.op13_prefixes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_lines": lines.OP3_SQL,
        "op6_warc": warc.OP6_SQL,
        "op9_chat": chat.OP9_SQL,
        "op11_mixing": mixing.OP11_SQL,
        "op12_lexical": lexical.OP12_SQL,
        "op13_prefixes": prefixes.OP13_SQL,
    }
