"""Functions that SQL text may name and Spark lacks, by their PostgreSQL names; all are SQL expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, body)
FUNCTIONS = {
    "json_extract_path_text": ("j STRING, k STRING", "STRING", "get_json_object(j, concat('$.', k))"),
    "to_number": ("s STRING", "DOUBLE", "CAST(replace(s, ',', '') AS DOUBLE)"),
    "btrim": ("s STRING", "STRING", "trim(s)"),
    "strpos": ("s STRING, t STRING", "INT", "instr(s, t)"),
    "quote_literal": ("s STRING", "STRING", "concat('''', replace(s, '''', ''''''), '''')"),
    "to_ascii": ("s STRING", "STRING", "regexp_replace(s, '[^\\\\x00-\\\\x7F]', '')"),
    "xor": ("a BIGINT, b BIGINT", "BIGINT", "a ^ b"),
    "regexp_matches_any": ("s STRING, p STRING", "BOOLEAN", "s RLIKE p"),
    "age_days": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "INT", "datediff(a, b)"),
}
_INSTALLED = "spanisle.functions"


def install(spark: SparkSession) -> None:
    """Makes the functions known to the session, once."""
    if spark.conf.get(_INSTALLED, "") == "1":
        return
    for name, (params, result, body) in FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    spark.conf.set(_INSTALLED, "1")
