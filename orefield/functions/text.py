"""Text functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_AND_GAPS = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"


def title_case(text: Column) -> Column:
    """Capitalise each run of letters and digits: o'neil-smith -> O'Neil-Smith.

    The built-in initcap starts words after blanks only, so it serves texts without other marks.
    """
    pieces = F.regexp_extract_all(F.lower(text), F.lit(WORDS_AND_GAPS), F.lit(1))
    capital = F.transform(
        pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.right(w, F.length(w) - 1))
    )
    marked = text.rlike(r"[^\p{L}\p{N}\s]")
    return F.when(marked, F.array_join(capital, "")).otherwise(F.initcap(text))
