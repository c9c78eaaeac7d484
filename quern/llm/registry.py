"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, chat, langid, licenses, line_dedup, matroska, packing, quality, simhash, winnow
from quern.llm.common import read


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_texts(read(spark, sf_dir, "documents"), with_media=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality_resample": quality.op2_quality_resample,
        "op3_language_id": langid.op3_language_id,
        "op4_matroska": op4_matroska,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_packing": packing.op7_packing,
        "op8_chat_format": chat.op8_chat_format,
        "op9_simhash": simhash.op9_simhash,
        "op10_winnowing": winnow.op10_winnowing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op6_license_scan": licenses.op6_sql(),
        "op8_chat_format": chat.OP8_SQL,
    }
