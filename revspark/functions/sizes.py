"""Size-string normalisation as one native Column expression (no Python UDF)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, largest_number_string, nonempty

# Fixed rule patterns; (?U) gives Unicode \d, \w and \b as in Python 3 regexes.
R_BRACKET = r"(?U)\((\d+)\)"
R_RANGE = r"(\d+)~\d+"
R_NUMBER = r"(?U)\b\d+(\.\d+)?\b"
R_ALPHA = r"(?iuU)\b(M|L|S|XS|XL|XXL)\b"
R_PURCHASE = r"(?U)(\d{2,3})\s*구매"
R_DIGITS = r"(?U)\d{2,3}"
NO_SIZE = "-"


def normalise_size(size) -> Column:
    """First rule that hits: largest bracketed number; first of a~b; a number with
    optional decimals; a letter size (upper-cased); 2-3 digits before the purchase
    word; the largest 2-3 digit run; else '-'."""
    s = col(size)
    brackets = F.regexp_extract_all(s, F.lit(R_BRACKET), 1)
    digits = F.regexp_extract_all(s, F.lit(R_DIGITS), 0)
    return (F.when(s.isNull(), F.lit(None))
            .when(F.size(brackets) > 0, largest_number_string(brackets))
            .otherwise(F.coalesce(
                nonempty(F.regexp_extract(s, R_RANGE, 1)),
                nonempty(F.regexp_extract(s, R_NUMBER, 0)),
                F.upper(nonempty(F.regexp_extract(s, R_ALPHA, 0))),
                nonempty(F.regexp_extract(s, R_PURCHASE, 1)),
                F.when(F.size(digits) > 0, largest_number_string(digits)),
                F.lit(NO_SIZE))))
