"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import infill, late, substrings
from sparkloom.llm.bitplanes import op8_token_files
from sparkloom.llm.bpe import op10_bpe
from sparkloom.llm.decontaminate import op6_suffix_arrays
from sparkloom.llm.histsort import op2_histogram_sort
from sparkloom.llm.langid import op5_language
from sparkloom.llm.neardup import op7_near_duplicates
from sparkloom.llm.ordermin import op3_order_minhash
from sparkloom.llm.pii import op4_personal_data
from sparkloom.llm.toxicity import op1_toxicity
from sparkloom.llm.warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_histogram_sort": op2_histogram_sort,
        "op3_order_minhash": op3_order_minhash,
        "op4_personal_data": op4_personal_data,
        "op5_language": op5_language,
        "op6_suffix_arrays": op6_suffix_arrays,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_token_files": op8_token_files,
        "op9_warc": op9_warc,
        "op10_bpe": op10_bpe,
        "op11_fill_in_middle": infill.op11_fill_in_middle,
        "op12_late_overwrite": late.op12_late_overwrite,
        "op13_repeated_passages": substrings.op13_repeated_passages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": infill.ORACLE_SQL}
