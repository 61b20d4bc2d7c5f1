"""Column functions on text. Lengths and positions count code points."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|\n|\r"
STRIP = r"^[\p{javaWhitespace}]+|[\p{javaWhitespace}]+$"
TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, STRIP, "")


def trim_ascii(text: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(text, TRIM, "")


def lines(text: Column) -> Column:
    """Lines of a text, which end at LF, CRLF or CR; a final line end opens no further line. Null gives null."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tail(text: Column, n: int) -> Column:
    """The last ``n`` characters."""
    return F.when(F.length(text) <= n, text).otherwise(F.substring(text, -n, n))


def token_count(text: Column, per_char: float = 1.5) -> Column:
    """Estimated tokens, 0 for null or empty text."""
    return tokens_of(F.length(text), per_char)


def tokens_of(size: Column, per_char: float = 1.5) -> Column:
    """Estimated tokens of a text of so many characters."""
    return F.coalesce(F.ceil(size * F.lit(per_char)), F.lit(0)).cast("int")


def web_token_estimate(text: Column) -> Column:
    """0.6 a Han character and 0.3 any other, rounded up."""
    han = F.regexp_count(text, F.lit("[一-龥]"))
    return F.coalesce(F.ceil(han * F.lit(0.6) + (F.length(text) - han) * F.lit(0.3)), F.lit(0)).cast("int")


def keywords(question: Column) -> Column:
    """Latin words and numbers, then pairs of neighbouring Han characters; duplicates stay. Null gives an empty array.

    A single Han character counts only in a question of at most two characters.
    """
    words = F.regexp_extract_all(question, F.lit("([a-zA-Z0-9]+)"), 1)
    runs = F.regexp_extract_all(question, F.lit("([一-龥]+)"), 1)
    pairs = F.transform(
        runs,
        lambda r: F.when(F.length(r) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
        .when(F.length(question) <= 2, F.array(r))
        .otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.concat(words, F.flatten(pairs)), F.array().cast("array<string>"))
