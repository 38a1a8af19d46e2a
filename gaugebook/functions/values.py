"""Text, decimal and instant expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugebook.schemas import MASS

# The characters the contract strips from both ends of an id.
TRIMMED = (
    "\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Accepted spellings. \z rather than $, which would let a trailing
# line break through.
MASS_TEXT = r"^\d{1,10}(\.\d{1,4})?\z"
LIMIT_TEXT = r"^\d{1,11}(\.\d{1,3})?\z"
INSTANT_TEXT = (
    r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?"
    r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z"
)
UUID_TEXT = (
    r"^([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"
    r"|00000000-0000-0000-0000-000000000000|[fF]{8}-[fF]{4}-[fF]{4}-[fF]{4}-[fF]{12})\z"
)


# The next functions take and return SQL text, so that they also serve inside array
# lambdas: a lambda given as text is parsed once, a Python lambda costs a driver
# round trip per node. At the top level use F.expr(...).


def stripped(text: str) -> str:
    return f"trim(BOTH '{TRIMMED}' FROM {text})"


def fits(text: str, limit: int) -> str:
    """Between 1 and `limit` UTF-16 units, the unit the contract counts in.

    A UTF-8 spelling never has fewer bytes than UTF-16 units, so the encoding is
    only paid for on long text.
    """
    return (
        f"(octet_length({text}) >= 1 AND CASE WHEN octet_length({text}) <= {limit} THEN true "
        f"ELSE octet_length(encode({text}, 'UTF-16BE')) <= {2 * limit} END)"
    )


def canonical_decimal(text: str) -> str:
    """Drop trailing zeros after a point; leading zeros are kept."""
    bare = f"regexp_replace(regexp_replace({text}, '0+$', ''), '[.]$', '')"
    return f"CASE WHEN instr({text}, '.') > 0 THEN {bare} ELSE {text} END"


def parse_instant(text: str) -> str:
    """ISO-8601 text with a mandatory offset, cut to milliseconds; NULL if not one."""
    with_seconds = (
        f"CASE WHEN substring({text}, 17, 1) = ':' THEN {text} "
        f"ELSE concat(substring({text}, 1, 16), ':00', substring({text}, 17)) END"
    )
    return (
        f"CASE WHEN {text} RLIKE r'{INSTANT_TEXT}' "
        f"THEN date_trunc('MILLISECOND', try_cast({with_seconds} AS timestamp)) END"
    )


def parse_mass(text: str) -> str:
    return f"CASE WHEN {text} RLIKE r'{MASS_TEXT}' THEN CAST({text} AS {MASS.simpleString()}) END"


def grams_to_kilograms(grams: Column) -> Column:
    """Exact shift by three places: a decimal product, never a float division."""
    return grams * F.expr("0.001BD")


def stored_mass(kilograms: Column) -> Column:
    """The mass as the tables hold it; NULL where it does not fit."""
    return F.round(kilograms, 4).try_cast(MASS)


def to_millis(ts: Column) -> Column:
    """Finer digits than a millisecond never reach an identity."""
    return F.date_trunc("MILLISECOND", ts)


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def mass_text(amount: Column) -> Column:
    """How an accepted amount is shown: nothing accepted reads "0"."""
    return F.when(amount == 0, F.lit("0")).otherwise(amount.cast("string"))


def derived_uuid(*parts: Column) -> Column:
    """A name-based id (UUID version 8): stable when a task is run again."""
    h = F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"),
        F.substring(h, 13, 3), F.lit("-a"), F.substring(h, 16, 3), F.lit("-"),
        F.substring(h, 19, 12),
    )


# ---- ids in fewer bytes, with nothing lost ----

DIGEST = r"^[0-9a-f]{64}\z"
#: Longer than a digest's 32 bytes, so that other texts never look like one.
_PLAIN = "\u001f" * 33


def packed_digest(text: Column) -> Column:
    """A sha256 in hexadecimal as its 32 bytes; any other text as its own bytes, marked."""
    plain = F.concat(F.lit(_PLAIN), text).cast("binary")
    return F.when(text.rlike(DIGEST), F.unhex(text)).otherwise(plain)


def unpacked_digest(packed: Column) -> Column:
    plain = F.substring(packed.cast("string"), len(_PLAIN) + 1, 2**31 - 1)
    return F.when(F.octet_length(packed) == 32, F.lower(F.hex(packed))).otherwise(plain)


def unless(text: Column, derived: Column) -> Column:
    """The text where it is not `derived`, and NULL where it is; see `or_else`."""
    told = F.when(text.isNull(), F.lit("-")).when(text.startswith("-"), F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(text.eqNullSafe(derived), F.lit(None)).otherwise(told)


def or_else(kept: Column, derived: Column) -> Column:
    """The text that `unless` was given. Texts that begin with no "-" are kept as they are."""
    return (
        F.when(kept.isNull(), derived)
        .when(kept == "-", F.lit(None))
        .when(kept.startswith("-"), F.substring(kept, 2, 2**31 - 1))
        .otherwise(kept)
    )
