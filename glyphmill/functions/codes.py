"""The 16-bit code space, as constants and column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the code format.
LITERAL_START, LITERAL_END, CAPITALIZED, UPPERCASE = 0, 1, 2, 3
TAB, LF, CR, SPACE = 9, 10, 13, 32
DIRECT_LAST, RESERVED_FIRST, RESERVED_LAST, LEXICAL_FIRST, LEXICAL_LAST = 255, 256, 535, 536, 65535
SLOTS = 65000
CONTROL_LAST = 15
FUTURE_CONTROLS = (4, 5, 6, 7, 8, 11, 12, 14, 15)
SINGLE_LETTERS = ("a", "e", "o", "u", "y")
TYPOGRAPHY = {128: "€", 133: "…", 137: "‰", 139: "‹", 145: "‘", 146: "’", 147: "“", 148: "”", 149: "•", 150: "–", 151: "—", 153: "™", 155: "›"}
# End of the fixed values.


def is_valid(code: Column) -> Column:
    return code.between(0, LEXICAL_LAST)


def is_direct(code: Column) -> Column:
    return code.between(0, DIRECT_LAST)


def is_control(code: Column) -> Column:
    return code.between(0, CONTROL_LAST)


def is_future_control(code: Column) -> Column:
    return code.isin(*FUTURE_CONTROLS)


def is_reserved(code: Column) -> Column:
    return code.between(RESERVED_FIRST, RESERVED_LAST)


def is_lexical(code: Column) -> Column:
    return code.between(LEXICAL_FIRST, LEXICAL_LAST)


def code_class(code: Column) -> Column:
    """control, direct, reserved, lexical or invalid."""
    return F.when(is_control(code), "control").when(is_direct(code), "direct").when(is_reserved(code), "reserved").when(is_lexical(code), "lexical").otherwise("invalid")


def guarded(value: Column, ok: Column, message: str) -> Column:
    """value where ok holds; the job fails with message elsewhere."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(value.cast("string"), F.lit("null")))).cast("int"))


def rank_to_token(rank: Column) -> Column:
    return guarded(rank, rank.between(1, SLOTS), "rank outside 1..65000") + (LEXICAL_FIRST - 1)


def token_to_rank(token: Column) -> Column:
    return guarded(token, is_lexical(token), "token outside 536..65535") - (LEXICAL_FIRST - 1)


def code_hex(code: Column) -> Column:
    """Four upper-case hex digits: the big-endian two bytes."""
    return F.lpad(F.hex(code), 4, "0")


def code_bytes(code: Column) -> Column:
    return F.unhex(code_hex(guarded(code, is_valid(code), "code outside 16 bits")))


def bytes_code(data: Column) -> Column:
    return F.conv(F.hex(F.when(F.length(data) == 2, data).otherwise(F.raise_error(F.lit("a code has two bytes")).cast("binary"))), 16, 10).cast("int")


def direct_code(char: Column) -> Column:
    """Code of a single character: ASCII, typography, or Latin-1 from 160; null if it has none."""
    point = F.ascii(char)
    typography = F.create_map(*[F.lit(x) for pair in ((c, k) for k, c in TYPOGRAPHY.items()) for x in pair])
    return F.when(F.char_length(char) != 1, None).when((point < 128) | point.between(160, 255), point).otherwise(F.try_element_at(typography, char))


def direct_char(code: Column) -> Column:
    """Inverse of direct_code; null for codes that have no character."""
    typography = F.create_map(*[F.lit(x) for pair in TYPOGRAPHY.items() for x in pair])
    return F.when(code.between(0, 127) | code.between(160, 255), F.char(code)).otherwise(F.try_element_at(typography, code))
