"""Check digits and other conditions on matches, as Spark expressions and as SQL that DuckDB shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.patterns import SPACE_JAVA

# The weights of an individual number's first eleven digits.
MY_NUMBER_WEIGHTS = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)


def luhn(text: Column) -> Column:
    """Digits only; every second from the right doubled; sum divisible by ten."""
    return F.call_function("luhn_check", F.regexp_replace(text, "[^0-9]", ""))


def iban(text: Column) -> Column:
    """White space goes, hyphens don't; shape; first four characters last; remainder 1 by 97."""
    plain = F.upper(F.regexp_replace(text, f"[{SPACE_JAVA}]", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    rest = F.aggregate(values, F.lit(0), lambda r, v: F.when(v < 10, (r * 10 + v) % 97).otherwise((r * 100 + v) % 97).cast("int"))
    return plain.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & (rest == 1)


def my_number(text: Column) -> Column:
    """Twelve digits whose last is the weighted check digit of the rest."""
    digits = F.regexp_replace(text, f"[-{SPACE_JAVA}]", "")
    total = sum((F.substring(digits, k + 1, 1).cast("int") * w for k, w in enumerate(MY_NUMBER_WEIGHTS)), F.lit(0))
    rest = total % 11
    check = F.when(rest <= 1, 0).otherwise(11 - rest)
    return F.when(digits.rlike(r"^[0-9]{12}\z"), check == F.substring(digits, 12, 1).cast("int")).otherwise(False)


def phone(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[-{SPACE_JAVA}]", "")) >= 10


CHECKS = {"luhn": luhn, "iban": iban, "my_number": my_number, "phone": phone}
