"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import chat, langid, line_blocks, media, mixing, packing, pii, quality, simhash, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_chat_snapshots": chat.op1_chat_snapshots,
        "op2_url_filter": urls.op2_url_filter,
        "op3_length_buckets": packing.op3_length_buckets,
        "op4_language_spans": langid.op4_language_spans,
        "op5_line_frequency": quality.op5_line_frequency,
        "op6_line_blocks": line_blocks.op6_line_blocks,
        "op7_disclosure": pii.op7_disclosure,
        "op8_pareto_mix": mixing.op8_pareto_mix,
        "op9_mpeg_audio": media.op9_mpeg_audio,
        "op10_simhash_ball": simhash.op10_simhash_ball,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_snapshots": chat.OP1_SQL, "op2_url_filter": urls.OP2_SQL, "op5_line_frequency": quality.OP5_SQL, "op8_pareto_mix": mixing.OP8_SQL}
