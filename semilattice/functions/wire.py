"""Values as they travel and as they are stored: canonical JSON, hashes, typed codecs, text order."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Wire = None | bool | int | float | str | list | dict


def number_text(x: float) -> str:
    """A number as ECMAScript writes it: no fraction on whole numbers, exponents from 1e21 and below 1e-6."""
    if isinstance(x, int):
        if abs(x) < 10**21:
            return str(x)
        x = float(x)
    if not math.isfinite(x):
        raise ValueError(f"not a finite number: {x}")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        out = text[:point].ljust(point, "0") + ("." + text[point:] if point < len(text) else "")
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + out


def utf16(text: str) -> bytes:
    """A sort key by UTF-16 code units."""
    return text.encode("utf-16-be", "surrogatepass")


def canonical(value: Wire) -> str:
    """JSON with keys in code-unit order at every depth and no spaces; refuses what JSON cannot say."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict) and all(isinstance(k, str) for k in value):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=utf16)) + "}"
    raise TypeError(f"not a wire value: {value!r}")


def is_wire(value: object) -> bool:
    try:
        canonical(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return False
    return True


def wire_hash(value: Wire) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def wire_text(value: Wire) -> str:
    """A string is itself, everything else its canonical JSON."""
    return value if isinstance(value, str) else canonical(value)


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """Canonical text of JSON text; null stays null, text that is not JSON becomes null."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return canonical(json.loads(text))
        except (ValueError, TypeError):
            return None

    return values.map(one)


def hash_canonical(text: Column) -> Column:
    """The hash of a value from its canonical JSON text."""
    return F.sha2(text, 256)


def json_string(text: Column) -> Column:
    """A string column as a JSON string: quotes, backslashes and control characters escaped and nothing else; null stays null."""
    def controls(escaped: Column) -> Column:
        for c in map(chr, range(0x20)):
            escaped = F.replace(escaped, F.lit(c), F.lit(json.dumps(c)[1:-1]))
        return escaped

    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F]"), _let(plain, controls)).otherwise(plain), F.lit('"'))


def number_json(x: Column) -> Column:
    """A double's canonical text, as ``number_text`` gives it, in built-in functions; null gives ``null``.

    The digits of the shortest text that reads back as the number are split at its exponent and the point is set
    anew. A number that is not finite raises an error. Where two shortest texts read back as the number, Java takes
    the upper one and ``number_text`` the nearer one: about one in 2,000 random numbers of 16 digits and none of fewer,
    but for numbers below 1e-307, whose digits are Java's.
    """
    number, size = x.cast("double"), F.abs(x).cast("double")
    short = number.cast("string")
    # whole numbers and short decimals, nearly all there are, stand as they are
    is_whole = (number == F.floor(number)) & (size < 2**53)
    is_short = ~short.contains("E") & (F.length(short) <= 16)
    finite = ~F.isnan(number) & (size != float("inf"))
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(x.isNull(), F.lit("null"))
        .when(~finite, F.raise_error(F.lit("not a finite number")).cast("string"))
        .when(is_whole, number.cast("long").cast("string"))
        .when(is_short, short)
        .otherwise(F.concat(sign, _let(size, lambda v: _let(_shortest(v), _placed))))
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shortest(size: Column) -> Column:
    """A positive number's text; Java may give more digits than are needed to read it back."""

    def pick(text: Column) -> Column:
        tries = [F.format_string(f"%.{digits - 1}e", size) for digits in (15, 16, 17)]
        fewer = [F.when(t.cast("double") == size, F.replace(F.upper(t), F.lit("E+"), F.lit("E"))) for t in tries]
        return F.when(F.length(text) > 16, F.coalesce(*fewer, text)).otherwise(text)

    return _let(size.cast("string"), pick)


def _placed(text: Column) -> Column:
    """A positive number's text with the point, or the exponent, where canonical JSON has it."""
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.when(F.instr(text, "E") > 0, F.substring_index(text, "E", -1).cast("int")).otherwise(0)
    # places before the point, counted from the first digit that is not zero
    before = F.length(F.substring_index(mantissa, ".", 1)) + exponent
    parts = _let(F.replace(mantissa, F.lit("."), F.lit("")), lambda p: F.struct(F.trim(p, F.lit("0")).alias("digits"), (before - F.length(p) + F.length(F.ltrim(p, F.lit("0")))).alias("point")))

    def place(x: Column) -> Column:
        digits, point, n = x["digits"], x["point"], F.length(x["digits"])
        zeros = lambda k: F.repeat(F.lit("0"), k)
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit(""))
        scientific = F.concat(F.substring(digits, 1, 1), tail, F.when(point > 0, "e+").otherwise("e-"), F.abs(point - 1).cast("string"))
        return (
            F.when((point >= n) & (point <= 21), F.concat(digits, zeros(point - n)))
            .when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
            .otherwise(scientific)
        )

    return _let(parts, place)


def key_json(df: DataFrame, name: str) -> Column:
    """A column's value as text: a number as canonical JSON has it, everything else as Spark does; null stays null."""
    c = F.col(name)
    return F.when(c.isNotNull(), number_json(c)) if df.schema[name].dataType in (T.DoubleType(), T.FloatType()) else c.cast("string")


def text_order(text: Column) -> Column:
    """A sort key that orders text by UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


# The declared types with what a reader gets where a value is absent or of another type.
DEFAULTS: dict[str, Wire] = {"string": "", "number": 0, "boolean": False, "date": "", "json": ""}


def decode_field(text: Column, kind: str, nullable: bool = False, values: tuple[str, ...] = ()) -> Column:
    """A typed column from canonical JSON text.

    A value of another type than the declared one reads as the type's default, or as null where nullable; so does
    an enum's value outside its set.
    """
    quoted = text.startswith('"')
    string = F.when(quoted, F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"))
    none = F.lit(None)
    if kind in ("string", "date"):
        return F.coalesce(string, none.cast("string") if nullable else F.lit(""))
    if kind == "enum":
        known = F.when(string.isin(*values), string)
        return known if nullable or not values else F.coalesce(known, F.lit(values[0]))
    if kind == "number":
        number = F.when(text.rlike(r"^-?[0-9]"), text.try_cast("double"))
        return number if nullable else F.coalesce(number, F.lit(0.0))
    if kind == "boolean":
        value = F.when(text == "true", True).when(text == "false", False)
        return value if nullable else F.coalesce(value, F.lit(False))
    if kind == "json":
        return text if nullable else F.coalesce(text, F.lit('""'))
    raise ValueError(f"unknown type {kind!r}")


def encode_value(c: Column, kind: str) -> Column:
    """A typed column as canonical JSON text; null gives ``null``. The inverse of ``decode_field`` for values of the type.

    ``kind`` is a declared type; a ``json`` column holds JSON text already and gets its canonical form.
    """
    if kind in ("string", "date", "enum"):
        return F.when(c.isNull(), F.lit("null")).otherwise(json_string(c.cast("string")))
    if kind == "number":
        return number_json(c.cast("double"))
    if kind == "boolean":
        return F.when(c.isNull(), F.lit("null")).otherwise(c.cast("boolean").cast("string"))
    if kind == "json":
        return F.coalesce(canonical_json(c), F.lit("null"))
    raise ValueError(f"unknown type {kind!r}")


def store_value(value: Wire, kind: str) -> object:
    """A wire value as a database column of its declared type holds it.

    A value of the type is kept plain (a boolean as 0 or 1, json as its text); any other becomes canonical JSON text,
    so that it reads back unchanged. Raises ValueError for numbers that are not finite.
    """
    if value is None:
        return None
    plain = {"string": str, "date": str, "enum": str, "number": (int, float), "boolean": bool}.get(kind, ())
    if isinstance(value, plain) and (kind == "boolean" or not isinstance(value, bool)):
        if kind == "number" and not math.isfinite(value):
            raise ValueError(f"not a finite number: {value}")
        return int(value) if kind == "boolean" else value
    return canonical(value)


def read_value(stored: object, kind: str) -> Wire:
    """What ``store_value`` stored; text in a column of numbers or booleans is JSON."""
    if stored is None or (kind in ("string", "date", "enum") and isinstance(stored, str)):
        return stored
    if kind == "boolean" and isinstance(stored, (int, bool)):
        return bool(stored)
    return json.loads(stored) if isinstance(stored, str) else stored


def present(values: dict[str, object], absent: object = ...) -> dict[str, object]:
    """A mutation's values without those left out (``...``); an explicit None stays."""
    return {k: v for k, v in values.items() if v is not absent}


def epoch_ms(value: Column) -> Column:
    """Milliseconds from a number's text or an ISO date's, else 0."""
    number = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value.try_cast("double").cast("long"))
    return F.coalesce(number, F.unix_millis(F.try_to_timestamp(value)), F.lit(0))


def auto_delete_days(value: Column, fallback: Column) -> Column:
    """A finite, non-negative number of days, else the fallback."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf")), value).otherwise(fallback)


def database_key(scope: Column, namespace: Column) -> Column:
    """One key for a namespace and a scope that no other two give."""
    return F.concat_ws(":", F.length(namespace).cast("string"), namespace, scope)


def fold_name(name: str) -> str:
    """ASCII letters lower-cased, nothing else."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)


def quote_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_literal(value: Wire) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (int, float)):
        return number_text(value)
    if "\0" in (text := wire_text(value)):
        raise ValueError("text with a NUL cannot be written")
    return "'" + text.replace("'", "''") + "'"


def split_sql(script: str) -> list[str]:
    """Statements of a script, split at semicolons outside quotes."""
    out, start, quote = [], 0, ""
    for i, c in enumerate(script):
        if quote:
            quote = "" if c == quote else quote  # a doubled quote closes and opens again
        elif c in "'\"":
            quote = c
        elif c == ";":
            out.append(script[start:i].strip())
            start = i + 1
    return [s for s in [*out, script[start:].strip()] if s]


def bind(value: object) -> object:
    """A parameter for SQL: booleans as 0 and 1; refuses what a database column cannot hold."""
    if isinstance(value, bool):
        return int(value)
    if value is None or isinstance(value, (str, int, float, bytes)):
        return value
    raise TypeError(f"cannot bind {type(value).__name__}")
