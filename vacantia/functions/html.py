"""Text as displayed: tags removed, block tags as breaks, character references resolved. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that begin a new line when displayed.
BLOCK_TAGS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|"
    "section|table|tbody|td|tfoot|th|thead|tr|ul"
)
#: Named character references that feeds use.
ENTITIES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "rsquo": "’", "lsquo": "‘", "ldquo": "“",
    "rdquo": "”", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•", "middot": "·", "euro": "€", "pound": "£",
}
_ANY_TAG = r"(?s)<!--.*?-->|</?[A-Za-z][^<>]*>"


def decode_numeric(text: Column) -> Column:
    """Numeric character references, decimal and hexadecimal, by splitting at their mark and decoding UTF-32."""
    parts = F.split(text, "&#(?=[0-9]{1,7};|[xX][0-9a-fA-F]{1,6};)")

    def one(x: Column, i: Column) -> Column:
        digits = F.regexp_extract(x, r"^([xX]?[0-9a-fA-F]+);", 1)
        code = F.when(
            F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 9), 16, 10).cast("long")
        ).otherwise(F.expr("0L") + F.conv(digits, 10, 10).cast("long"))
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(i == 0, x).otherwise(F.concat(char, F.regexp_replace(x, r"^[xX]?[0-9a-fA-F]+;", "")))

    return F.when(text.contains("&#"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def decode_entities(text: Column) -> Column:
    out = text
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    out = F.when(text.contains("&"), F.replace(decode_numeric(out), F.lit("&amp;"), F.lit("&"))).otherwise(text)
    return out


def untagged(text: Column, block: str = "\n\n") -> Column:
    """Block tags become `block`, other tags vanish."""
    tagged = F.regexp_replace(F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^<>]*)?/?>", block), _ANY_TAG, "")
    return F.when(text.contains("<"), tagged).otherwise(text)


def displayed(text: Column, block: str = "\n\n") -> Column:
    """What a reader sees. Block tags become `block`, other tags vanish; null stays null."""
    return decode_entities(untagged(text, block))


def with_displayed(df: DataFrame, name: str, block: str = "\n\n") -> DataFrame:
    """Column `name` as displayed, in steps of one projection each, so that no step is evaluated twice a row."""
    return df.withColumn(name, untagged(F.col(name), block)).withColumn(name, decode_entities(F.col(name)))


def letters_digits(text: Column) -> Column:
    """How many letters and digits are displayed."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
