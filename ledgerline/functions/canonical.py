"""Canonical JSON text of nested values as column expressions.

The text is that of Python's ``json.dumps(value, sort_keys=True)``: keys in
code point order, ``", "`` and ``": "`` between parts, everything beyond
printable ASCII escaped, floating-point numbers in their shortest form.  The
writer follows the declared type (struct, map with string keys, array, strings,
numbers, booleans) and stays in Spark's expressions; a text of unknown shape is
read with ``from_json`` and a schema first.

Dates and timestamps are strings in ISO form (timestamps with six decimals);
a decimal is a number with the digits of its scale; a null is ``null``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_MAP = T.MapType(T.StringType(), T.StringType())
_PAIR = "\x01"  # stands for an escaped backslash; no JSON text holds it raw


def escaped(c: Column) -> Column:
    """JSON string escapes with all control and non-ASCII characters beyond
    the short ones as ``\\uxxxx`` (surrogate pairs beyond the basic plane).
    Spark's JSON writer escapes so but for capital digits and character 127;
    only texts with such characters go through it."""
    text = F.to_json(F.array(c), {"writeNonAsciiCharacterAsCodePoint": "true"})
    units = F.split(F.replace(F.substring(text, F.lit(3), F.length(text) - 4), F.lit("\\\\"), F.lit(_PAIR)), r"\\u")
    lower = F.concat(F.element_at(units, 1), F.array_join(F.transform(
        F.slice(units, 2, F.size(units) - 1), lambda u: F.concat(F.lit("\\u"), F.lower(F.left(u, F.lit(4))), F.substring(u, 5, 2**31 - 1))), ""))
    lower = F.replace(F.replace(lower, F.lit(_PAIR), F.lit("\\\\")), F.lit("\x7f"), F.lit("\\u007f"))
    simple = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(c.rlike(r"[^ -~]"), lower).otherwise(simple)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), escaped(c), F.lit('"'))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fewer_digits(number: Column, size: Column) -> Column:
    """``digits, exponent`` with one digit less if that still names the double
    ``size`` (Java up to version 18 writes some doubles with digits too many)."""
    digits, exponent = number["digits"], number["exponent"]
    less = F.length(digits) - 1

    def shorter(down: Column) -> Column:
        up = (down.cast("decimal(20,0)") + 1).cast("string")

        def named(d: Column) -> Column:  # 99 + 1 has a digit more and counts from the next power
            same = F.concat(d, F.lit("E"), exponent - less + 1).try_cast("double") == size
            return F.when(same, F.struct(F.rtrim(d, F.lit("0")).alias("digits"), (exponent + F.length(d) - less).alias("exponent")))

        upper = F.right(digits, F.lit(1)) >= "5"
        return F.coalesce(F.when(upper, named(up)), named(down), named(up), number)

    return F.when(less < 1, number).otherwise(_let(F.left(digits, less), shorter))


def _placed(digits: Column, exponent: Column) -> Column:
    """Digits (of which the first counts 10 to the ``exponent``) as Python
    places the point."""
    whole, power = exponent + 1, F.abs(exponent).cast("string")
    rest = F.substring(digits, F.lit(2), F.length(digits))
    return (F.when((exponent >= 16) | (exponent < -4), F.concat(
                F.left(digits, F.lit(1)), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""),
                F.when(exponent < 0, "e-").otherwise("e+"), F.when(F.length(power) < 2, "0").otherwise(""), power))
            .when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
            .when(F.length(digits) <= whole, F.concat(F.rpad(digits, whole, F.lit("0")), F.lit(".0")))
            .otherwise(F.concat(F.left(digits, whole), F.lit("."), F.substring(digits, whole + 1, F.length(digits)))))


def float_text(c: Column) -> Column:
    """A double as Python writes it: shortest digits, positional from 1e-4 to
    below 1e16, else with an exponent of at least two digits."""

    def parts(value: Column, text: Column) -> Column:
        body = F.ltrim(text, F.lit("-"))
        mantissa = F.substring_index(body, "E", 1)
        behind = F.substring_index(mantissa, ".", -1)
        exponent = (F.when(F.contains(body, F.lit("E")), F.substring_index(body, "E", -1).try_cast("int"))
                    .when(F.startswith(body, F.lit("0.")), F.length(F.ltrim(behind, F.lit("0"))) - F.length(behind) - 1)
                    .otherwise(F.length(F.substring_index(mantissa, ".", 1)) - 1))
        digits = F.rtrim(F.ltrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0")), F.lit("0"))
        return F.struct(value.alias("value"), text.alias("text"), F.struct(digits.alias("digits"), exponent.alias("exponent")).alias("n"))

    def written(p: Column) -> Column:
        # NaN, the infinities and zeros are written alike
        special = F.isnan(p["value"]) | (F.abs(p["value"]) == float("inf")) | (p["value"] == 0)
        once = _fewer_digits(p["n"], F.abs(p["value"]))
        twice = _let(once, lambda n: _fewer_digits(n, F.abs(p["value"])))
        placed = _let(twice, lambda n: _placed(n["digits"], n["exponent"]))
        return F.when(special, p["text"]).otherwise(F.concat(F.when(p["value"] < 0, "-").otherwise(""), placed))

    value = c.cast("double")
    text = value.cast("string")
    # up to 15 digits are the only ones so short that name the double
    return (F.when(~F.contains(text, F.lit("E")) & (F.length(text) <= 16), text)
            .otherwise(_let(_let(text, lambda t: parts(value, t)), written)))


def canonical_json(value: Column | str, kind: T.DataType = TEXT_MAP) -> Column:
    """JSON text of ``value``, a column of type ``kind``."""
    v = F.col(value) if isinstance(value, str) else value
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(": "), canonical_json(v.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")) if parts else F.lit("{}")
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError(f"keys of {kind.simpleString()} are no strings")
        parts = F.transform(F.array_sort(F.map_keys(v)), lambda k: F.concat(
            _quoted(k), F.lit(": "), canonical_json(F.element_at(v, k), kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        parts = F.transform(v, lambda x: canonical_json(x, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = _quoted(v)
    elif isinstance(kind, T.BooleanType):
        text = F.when(v, "true").otherwise("false")
    elif isinstance(kind, (T.IntegralType, T.DecimalType)):
        text = v.cast("string")
    elif isinstance(kind, T.FractionalType):
        text = float_text(v)
    elif isinstance(kind, T.DateType):
        text = _quoted(F.date_format(v, "yyyy-MM-dd"))
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        text = _quoted(F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON text for {kind.simpleString()}")
    return F.when(v.isNull(), "null").otherwise(text)


def canonical_of(df: DataFrame, name: str) -> Column:
    """JSON text of a column of ``df``."""
    return canonical_json(name, df.schema[name].dataType)


def record_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON text of whole rows of ``df`` (or of some columns)."""
    names = columns or df.columns
    kind = T.StructType([df.schema[n] for n in names])
    return canonical_json(F.struct(*[F.col(n) for n in names]), kind)
