"""Column to column: what a policy may do to a value.

All but keyed hashes with a secret key are expressions of Spark's own, so that they fold
into one projection. Null stays null everywhere.
"""

from __future__ import annotations

import hashlib
import hmac
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.columns import text
from veilframe.errors import PolicyError
from veilframe.functions.dates import periods

HASH_LENGTH = 16
TOKEN_LENGTH = 12


def mask(s: Column, keep_prefix: int = 0, keep_suffix: int = 0, mask_char: str = "*") -> Column:
    """Keeps both ends and replaces each character between; one at least is replaced."""
    if keep_prefix < 0 or keep_suffix < 0:
        raise PolicyError("mask keeps a negative number of characters")
    if not mask_char:
        raise PolicyError("mask has no character to write")
    n, both = F.length(s), keep_prefix + keep_suffix
    scale = (n - 1) / F.lit(float(both or 1))
    tight = F.lit(both) >= n
    p = F.least(F.when(tight, F.floor(F.lit(keep_prefix) * scale)).otherwise(keep_prefix), n).cast("int")
    q = F.least(F.when(tight, F.floor(F.lit(keep_suffix) * scale)).otherwise(keep_suffix), n - p).cast("int")
    return F.when(n == 0, s).otherwise(F.concat(F.left(s, p), F.repeat(F.lit(mask_char), n - p - q), F.right(s, q)))


def truncate(s: Column, keep: int = 3, pad_char: str = "*") -> Column:
    """Keeps the first characters and pads to the old length; one at least is padded."""
    if keep < 0:
        raise PolicyError("truncation keeps a negative number of characters")
    if len(pad_char) != 1:
        raise PolicyError("truncation pads with one character")
    n = F.length(s)
    return F.when(n == 0, s).otherwise(F.rpad(F.left(s, F.least(F.lit(keep), n - 1)), n, F.lit(pad_char)))


def redact(c: Column, replacement: str = "[REDACTED]") -> Column:
    return F.when(c.isNotNull(), F.lit(replacement))


def hmac_native(s: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal by Spark's functions. The key shows in plans: only for public ones."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, s.cast("binary")), 256))), 256)


def hmac_secret(s: Column, key: bytes) -> Column:
    """The same in Arrow batches; the key travels with the code and not in the plan."""

    @F.pandas_udf(T.StringType())
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: hmac.new(key, v.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return keyed(s)


def pseudonym(s: Column, key: bytes, public: bool = False) -> Column:
    return F.left((hmac_native if public else hmac_secret)(s, key), F.lit(HASH_LENGTH))


def token(s: Column, key: bytes, prefix: str = "tok_", public: bool = False) -> Column:
    return F.concat(F.lit(prefix), F.left((hmac_native if public else hmac_secret)(s, key), F.lit(TOKEN_LENGTH)))


def _label(d: Column, scale: int) -> Column:
    """A decimal of so many places, without zeros at its end."""
    s = d.cast(f"decimal(38,{scale})").cast("string")
    return F.rtrim(F.rtrim(s, F.lit("0")), F.lit(".")) if scale else s


def _floor_decimal(s: Column, width: Decimal) -> tuple[Column, Column]:
    """(multiple of the width at or below the number in the text, whether it is a number), exactly.

    What stands behind the 18th place is cut off; a number below 0 that is a multiple only
    for that belongs one bin lower.
    """
    w = F.lit(format(width, "f")).cast("decimal(38,18)")
    long = s.rlike(r"\.[0-9]{19}")
    cut = F.when(long, F.regexp_replace(s, r"(\.[0-9]{18})[0-9]+", "$1")).otherwise(s)
    d = cut.try_cast("decimal(38,18)")
    over = F.pmod(d, w)
    below = long & s.startswith("-") & s.rlike(r"\.[0-9]{18}[0-9]*[1-9]")
    # With an exponent the cast rounds: the number as a double tells the side.
    below = below | (s.rlike("[eE]") & (s.try_cast("double") < d.cast("double")))
    return F.when((over == 0) & below, d - w).otherwise(d - over), d.isNotNull()


def numeric_bin(c: Column, kind: T.DataType, bin_width) -> Column:
    """``[lo, hi)`` with lo the multiple of the width at or below the value, in exact decimals.

    Not a number: null; text that is no number, and numbers of 1e20 or more: an error
    that does not quote them. Numbers that lie clear of a bin's edge, and whole ones, are
    binned in machine arithmetic; what lies at an edge, and text, in decimals.
    """
    if isinstance(kind, T.BooleanType):
        raise PolicyError("a boolean column has no bins")
    try:
        width = Decimal(str(bin_width))
    except InvalidOperation:
        raise PolicyError("bin_width is not a number") from None
    if not width.is_finite() or width <= 0:
        raise PolicyError("bin_width must be above 0")
    width = width.normalize()
    scale = max(0, -width.as_tuple().exponent)
    if scale > 18 or width >= Decimal(10) ** 19:
        raise PolicyError("bin_width is too fine or too wide")
    w = F.lit(format(width, "f")).cast(f"decimal(38,{scale})")

    def exact(v: Column) -> Column:
        s = F.trim(v.cast("string"))
        lo, known = _floor_decimal(s, width)
        odd = F.lower(s).isin("nan", "inf", "-inf", "+inf", "infinity", "-infinity", "+infinity")
        bad = F.raise_error(F.lit("a value is not a number that can be binned")).cast("string")
        label = F.concat(F.lit("["), _label(lo, scale), F.lit(", "), _label(lo.cast(f"decimal(38,{scale})") + w, scale), F.lit(")"))
        return F.when(s.isNull() | odd, F.lit(None).cast("string")).when(~known, bad).otherwise(label)

    if not isinstance(kind, (T.IntegralType, T.DoubleType, T.FloatType)) or not 1e-6 <= width <= 10**9:
        return exact(c)
    # The bin's number, as long as it and its edges are small enough to be exact.
    edge = F.lit(float(width))
    q = c.cast("double") / edge
    clear = (F.abs(q) < 1e8) & (F.abs(q - F.round(q)) > 1e-6)
    number = F.floor(q)
    if not scale:
        whole = (F.abs(q) < 1e8) & (c == F.floor(c))
        n = c.cast("long")
        number = F.when(whole, ((n - F.pmod(n, F.lit(int(width)))) / F.lit(int(width))).cast("long")).otherwise(number)
        clear = clear | whole
        low = number * F.lit(int(width))
        quick = F.concat(F.lit("["), low.cast("string"), F.lit(", "), (low + F.lit(int(width))).cast("string"), F.lit(")"))
    else:
        units = number * F.lit(int(width.scaleb(scale)))
        one = F.lit(Decimal(1).scaleb(-scale))
        part = lambda u: _label(u.cast("decimal(19,0)") * one, scale)
        quick = F.concat(F.lit("["), part(units), F.lit(", "), part(units + F.lit(int(width.scaleb(scale)))), F.lit(")"))
    # Within transform() the long way stays out of the generated code, which is compiled only while short.
    rare = F.transform(F.array(c), exact)[0]
    return F.when(c.isNull(), F.lit(None).cast("string")).when(clear, quick).otherwise(rare)


#: Formats of granularities, and of dates in text in the order they are tried.
GRANULARITY = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^(0?[1-9]|1[0-2])-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^(0?[1-9]|1[0-2])\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
)


def date_truncate(c: Column, kind: T.DataType, granularity: str = "month") -> Column:
    """Year, month or day of a date. Text must hold the date down to there; what does not is an error."""
    if granularity not in GRANULARITY:
        raise PolicyError("granularity is year, month or day")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, GRANULARITY[granularity])
    if not isinstance(kind, T.StringType):
        raise PolicyError("only dates, times with a date and text can be cut to a date")
    s = F.trim(c)
    day = F.regexp_replace(s, r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$", "")
    tried = [F.when(day.rlike(shape), F.try_to_timestamp(F.initcap(day), F.lit(form))) for shape, form in DATE_FORMATS]
    found = F.date_format(F.coalesce(*tried), GRANULARITY[granularity])
    # Other forms are read by a grammar, from which the usual ones are kept away.
    found = F.coalesce(found, periods(F.when(found.isNull(), s), list(GRANULARITY).index(granularity) + 1))
    bad = F.raise_error(F.lit("a value is not a date")).cast("string")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(found.isNull(), bad).otherwise(found)


def apply_action(action: str, c: Column, kind: T.DataType, params: dict, key: bytes, public: bool = False) -> tuple[Column, T.DataType]:
    """The column after an action, and its type. ``drop`` and ``dp_laplace`` are not among them."""
    if action == "retain":
        return c, kind
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise PolicyError("a nested column can be kept or dropped only")
    s = text(c, kind)
    try:
        if action == "mask":
            out = mask(s, int(params.get("keep_prefix", 0)), int(params.get("keep_suffix", 0)), str(params.get("mask_char", "*")))
        elif action == "hash":
            out = pseudonym(s, key, public)
        elif action == "tokenize":
            out = token(s, key, str(params.get("prefix", "tok_")), public)
        elif action == "redact":
            out = redact(c, str(params.get("replacement", "[REDACTED]")))
        elif action == "numeric_bin":
            if "bin_width" not in params:
                raise PolicyError("bin_width is missing")
            out = numeric_bin(c, kind, params["bin_width"])
        elif action == "date_truncate":
            out = date_truncate(c, kind, str(params.get("granularity", "month")))
        elif action == "string_truncate":
            out = truncate(s, int(params.get("keep", 3)), str(params.get("pad_char", "*")))
        else:
            raise PolicyError(f"there is no action {action!r}")
    except (TypeError, ValueError):
        raise PolicyError(f"the parameters of {action} are wrong") from None
    return out, T.StringType()
