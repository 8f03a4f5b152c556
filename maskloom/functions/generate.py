"""Synthetic identifiers with right checksums, from integer keys (PRE11-12).

Plain arithmetic and string functions, so that any SQL engine can build the same text
and knows where the identifier lies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import vocab as V


def number(key: Column, width: int) -> Column:
    return F.lpad(F.pmod(key, F.lit(10**width)).cast("string"), width, "0")


def mobile(key: Column, separator: str = "-") -> Column:
    return F.concat_ws(separator, F.lit("010"), (F.lit(2000) + F.pmod(key, F.lit(8000))).cast("string"), number(key * 7, 4))


def _digits(value: Column, count: int) -> list[Column]:
    return [F.substring(value, i + 1, 1).cast("int") for i in range(count)]


def registration(key: Column, seventh: int = 1, dash: bool = True) -> Column:
    """A registration number with a right checksum; 5 to 8 as seventh digit make it a foreigner's."""
    born = F.concat(F.lpad((50 + F.pmod(key, F.lit(50))).cast("string"), 2, "0"), F.lpad((1 + F.pmod(key, F.lit(12))).cast("string"), 2, "0"),
                    F.lpad((1 + F.pmod(key, F.lit(28))).cast("string"), 2, "0"))
    body = F.concat(born, F.lit(str(seventh)), F.lpad(F.pmod(key, F.lit(96)).cast("string"), 2, "0"), number(key, 3))
    total = reduce(lambda a, b: a + b, (d * w for d, w in zip(_digits(body, 12), V.RRN_WEIGHTS)))
    shift = 13 if seventh in (5, 6, 7, 8) else 11
    full = F.concat(body, (F.pmod(F.lit(shift) - total % 11, F.lit(10))).cast("string"))
    return F.concat(F.substring(full, 1, 6), F.lit("-"), F.substring(full, 7, 7)) if dash else full


def business(key: Column, dash: bool = True) -> Column:
    body = number(key * 37, 9)
    parts = _digits(body, 9)
    total = reduce(lambda a, b: a + b, (d * w for d, w in zip(parts[:8], V.BRN_WEIGHTS))) + F.floor(parts[8] * 5 / 10).cast("int") + parts[8] * 5
    full = F.concat(body, (F.pmod(F.lit(10) - total % 10, F.lit(10))).cast("string"))
    return F.concat_ws("-", F.substring(full, 1, 3), F.substring(full, 4, 2), F.substring(full, 6, 5)) if dash else full


def card(key: Column, separator: str = "-") -> Column:
    body = F.concat(F.lit("4"), number(key * 7919, 14))
    doubled = [d * 2 if i % 2 == 0 else d for i, d in enumerate(_digits(body, 15))]
    total = reduce(lambda a, b: a + b, (F.when(d > 9, d - 9).otherwise(d) for d in doubled))
    full = F.concat(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))
    return F.concat_ws(separator, *(F.substring(full, i, 4) for i in (1, 5, 9, 13)))


def passport(key: Column) -> Column:
    return F.concat(F.lit("M"), number(key, 3), F.substring(F.lit("ABCDEFGHJK"), (F.pmod(key, F.lit(10)) + 1).cast("int"), F.lit(1)), number(key * 3, 4))


def license_number(key: Column) -> Column:
    return F.concat_ws("-", (F.lit(11) + F.pmod(key, F.lit(16))).cast("string"), number(key, 2), number(key * 11, 6), number(key * 5, 2))


def account(key: Column, prefix: str = "110") -> Column:
    return F.concat_ws("-", F.lit(prefix), number(key * 13, 3), number(key * 17, 6))


def email(key: Column) -> Column:
    return F.concat(F.lit("user"), key.cast("string"), F.lit("@example.co.kr"))


def csv_load(spark: SparkSession, rows: int) -> DataFrame:
    """The four-column load table: customer name, mobile number, e-mail, order number."""
    key = F.col("id")
    return spark.range(rows).select(
        F.concat(F.lit("김"), F.element_at(F.array(*map(F.lit, "민서 지우 하준 서연 도윤".split())), (F.pmod(key, F.lit(5)) + 1).cast("int"))).alias("고객명"),
        mobile(key).alias("휴대폰번호"), email(key).alias("이메일주소"), F.concat(F.lit("ORD-"), F.lpad(F.pmod(key, F.lit(100000)).cast("string"), 5, "0")).alias("주문번호"))
