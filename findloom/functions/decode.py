"""Percent-decoding round after round, which built-in functions cannot express."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPE = re.compile(rb"%[0-9a-fA-F]{2}")
ROUNDS = 500
_DECODED = T.StructType().add("text", T.StringType()).add("rounds", T.IntegerType()).add("valid", T.BooleanType())


def decode_once_and_more(text: str) -> tuple[str, int, bool]:
    """(decoded text, rounds after the first, whether all bytes were UTF-8)."""
    data, done = text.encode("utf-8", "surrogatepass"), 0
    while done < ROUNDS and _ESCAPE.search(data):
        data = unquote_to_bytes(data)
        done += 1
    plain = data.decode("utf-8", "ignore")
    return plain, max(0, done - 1), plain.encode("utf-8", "ignore") == data


@F.pandas_udf(_DECODED)
def _decoded(texts: pd.Series) -> pd.DataFrame:
    rows = [decode_once_and_more(t) for t in texts]
    return pd.DataFrame(rows, columns=["text", "rounds", "valid"])


def decoded(query: Column) -> Column:
    """Struct ``(text, rounds, valid)``."""
    return _decoded(F.coalesce(query, F.lit("")))


def with_decoded(table: DataFrame, column: str, into: str) -> DataFrame:
    """``table`` with the struct of ``decoded``; only rows with a percent sign go through Python."""
    value = F.coalesce(F.col(column), F.lit(""))
    plain = F.struct(value.alias("text"), F.lit(0).alias("rounds"), F.lit(True).alias("valid"))
    encoded = F.contains(value, F.lit("%"))
    some = table.where(encoded).withColumn(into, _decoded(F.coalesce(F.col(column), F.lit(""))))
    return table.where(~encoded).withColumn(into, plain).unionByName(some)
