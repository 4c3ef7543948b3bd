"""A join for keys that very many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def spread_join(rows: DataFrame, one: DataFrame, on: str, row: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with ``one``, which has one row for each value of column ``on``.

    Rows are dealt out by key and a salt from column ``row``, and ``one`` goes to all salts, so that a hot key's rows meet it in
    as many tasks. Adaptive execution can't split such a key by itself where ``one`` is an aggregate on it.
    """
    dealt = rows.withColumn("join_salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    everywhere = one.withColumn("join_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(everywhere, [on, "join_salt"], how).drop("join_salt")
