"""Fields of JSON payloads, as numbers and texts in the sense of a web form.

A payload is parsed once, to a VARIANT. A field counts as given if it is there and not
null; the first given one of two places decides, even if it cannot be read.

Numbers: a JSON number is itself, true is 1, false is 0. A text is read without white space
at its ends: empty is 0, decimal with sign, point and exponent, ``Infinity``, or an unsigned
hexadecimal, octal or binary number behind ``0x``, ``0o``, ``0b`` (as long as it has at most
60 bits). An empty array is 0, and an array of one number or text is read as that. Anything
else, such as ``5d`` or an object, is unknown (null). Only a payload without the field, or no
valid JSON at all (a key given twice counts as such), gives 0.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The number grammar.
# ---------------------------------------------------------------------------

WHITE_SPACE = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Empty texts, and those whose first and last character are visible ASCII ones.
PLAIN = r"(?s)\A([!-~](.*[!-~])?)?\z"
DECIMAL = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$"
#: Pattern and base of numbers behind a prefix of two characters.
PREFIXED = ((r"^0[xX][0-9a-fA-F]{1,15}$", 16), (r"^0[oO][0-7]{1,20}$", 8), (r"^0[bB][01]{1,60}$", 2))


def trimmed(text: Column) -> Column:
    """Without white space at its ends, line ends and Unicode spaces included."""
    # nearly all texts begin and end without a space, which is cheaper to see than to search for spaces
    return F.when(text.rlike(PLAIN), text).otherwise(F.regexp_replace(text, f"^{WHITE_SPACE}|{WHITE_SPACE}$", ""))


def number_of_plain(plain: Column) -> Column:
    """Number that a trimmed text stands for, null if none. Best on a stored column, as it is looked at repeatedly."""
    number = F.when(plain == "", F.lit(0.0)).when(plain.rlike(DECIMAL), plain.try_cast("double"))
    for pattern, base in PREFIXED:
        number = number.when(plain.rlike(pattern), F.conv(F.substring(plain, 3, 60), base, 10).try_cast("double"))
    return number


def given(payload: Column, *paths: str) -> Column:
    """The first of the fields of a VARIANT that is there and not null."""
    fields = [F.try_variant_get(payload, f"$.{path}", "variant") for path in paths]
    return F.coalesce(*[F.when(~F.is_variant_null(f), f) for f in fields])


def number_text_of(field: Column, kind: Column | None = None) -> Column:
    """The trimmed text by which a VARIANT field is read as a number; ``kind`` may give its stored schema, which is looked at repeatedly."""
    kind = F.schema_of_variant(field) if kind is None else kind
    items = F.try_variant_get(field, "$", "array<string>")
    texts = (
        F.when(field.isNull(), "0")
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(field, "$", "boolean"), "1").otherwise("0"))
        .when(kind.startswith("ARRAY"), F.when(F.size(items) < 2, F.coalesce(F.get(items, F.lit(0)), F.lit(""))))
        .when(~kind.startswith("OBJECT"), F.try_variant_get(field, "$", "string"))
    )
    return trimmed(texts)


def number(field: Column) -> Column:
    """Number of a VARIANT field: 0 if it is not given, null if it is none."""
    return number_of_plain(number_text_of(field))


def text(field: Column) -> Column:
    """Text of a VARIANT field without white space at its ends, empty if it is not given."""
    return trimmed(F.coalesce(F.try_variant_get(field, "$", "string"), F.lit("")))


def number_field(payload: Column, name: str) -> Column:
    """The field at top level or else under ``body``."""
    return given(payload, name, f"body.{name}")


def text_field(payload: Column, name: str) -> Column:
    """The field under ``body`` or else at top level."""
    return given(payload, f"body.{name}", name)
