"""Division and rounding that give the same digits in every engine.

``round(double, 2)`` differs between engines for values whose shortest
decimal form ends in 5 (Spark rounds the decimal text 0.285 up to 0.29, an
engine that scales the binary double gets 0.28).  Casting to a wide decimal
first fixes the value at 10 places, after which HALF_UP rounding is exact.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_DECIMAL = "decimal(38,10)"


@cache
def compatibility_digits() -> tuple[str, str]:
    """(characters, what each becomes): all that NFKD turns into one ASCII
    digit, sign, separator or space, such as full-width and superscript digits."""
    plain = "0123456789+-., "
    forms = ((chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(128, sys.maxunicode + 1))
    pairs = [(c, form) for c, form in forms if len(form) == 1 and form in plain]
    return "".join(c for c, _ in pairs), "".join(form for _, form in pairs)


def ascii_digits(text: Column) -> Column:
    """Text with the characters of :func:`compatibility_digits` replaced (a
    character map of the engine)."""
    return F.translate(text, *compatibility_digits())


def round_money(col: Column | str, digits: int = 2) -> Column:
    """Round HALF_UP to ``digits`` places via a decimal; return a double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast(WIDE_DECIMAL), digits).cast("double")


def round_decimal(col: Column | str, digits: int = 2) -> Column:
    """As :func:`round_money` but keep an exact ``decimal(38, digits)``, for
    values that are summed again afterwards."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast(WIDE_DECIMAL), digits)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator`` as a double, NULL when the denominator is
    0 or NULL.

    Sums stay exact decimals; only the final ratio is a double division
    (the same IEEE operation in any engine, and no decimal precision loss
    for wide sums).  Spark 4 runs with ANSI mode on, where ``x / 0``
    raises; a relational database returns NULL, which ``try_divide`` does.
    """
    n = F.col(numerator) if isinstance(numerator, str) else numerator
    d = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(n.cast("double"), d.cast("double"))
