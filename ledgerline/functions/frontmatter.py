"""What is wrong with a block of frontmatter, as a column expression.

The block is a YAML mapping at the left margin.  A fold over its lines keeps a
small state: the open quote, the open brackets, what an indented line would
belong to, the keys so far and the first defect.  Blocks of plain ``key: text``
lines, nearly all of them, are recognised by one pattern and not folded.

Defects: a tab in the indentation, a quote or bracket that is never closed,
text after a closing quote, a bracket closed twice, a character that cannot
begin a value, a second colon in a value, text without a key, keys among list
items (or the other way round), indented lines that belong to nothing, a key
under a value, a repeated key.  What an indented line holds is not looked into.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_A_DICTIONARY = "YAML frontmatter is not a valid dictionary."
CANNOT_PARSE = "Failed to parse YAML frontmatter: "

_PLAIN = r"\A(?:[A-Za-z_]\w*:(?: \w(?:[^:#\t\n]|:(?=\S))*)?(?:\n|\z))+\z"
_PLAIN_KEY = r"(?m)^([A-Za-z_]\w*):"
_KEY = r"^(\S.*?)[ \t]*:(?:[ \t]+(.*))?$"
_CLOSED = {'"': r'^(?:[^"\\]|\\.)*"[ \t]*(?:#.*)?$', "'": r"^(?:[^']|'')*'[ \t]*(?:#.*)?$"}
_UNCLOSED = {'"': r'^(?:[^"\\]|\\.)*\\?$', "'": r"^(?:[^']|'')*$"}
_STATE = "struct<quote:string,depth:int,under:string,kind:string,keys:array<string>,defect:string>"


def _brackets(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _state(s: Column, **changed) -> Column:
    names = ("quote", "depth", "under", "kind", "keys", "defect")
    parts = [(changed[n] if isinstance(changed[n], Column) else F.lit(changed[n])) if n in changed else s[n] for n in names]
    return F.struct(*[p.alias(n) for n, p in zip(names, parts)]).cast(_STATE)


def _bad(s: Column, number: Column, what: str | Column) -> Column:
    text = F.lit(what) if isinstance(what, str) else what
    return _state(s, defect=F.concat(F.lit("line "), number, F.lit(": "), text))


def _quoted(s: Column, number: Column, rest: Column, mark: str, then: Column) -> Column:
    """State after ``rest``, which follows an opening quote ``mark``."""
    return (F.when(rest.rlike(_CLOSED[mark]), then).when(rest.rlike(_UNCLOSED[mark]), _state(then, quote=mark))
            .otherwise(_bad(s, number, "text after a closing quote")))


def _value(s: Column, number: Column, value: Column) -> Column:
    """State after the value of a key (``s`` already has the key)."""
    first, rest = F.left(value, F.lit(1)), F.substring(value, 2, 2**31 - 1)
    depth = _brackets(value)
    inside = _state(s, under="value")
    return (F.when((value == "") | value.startswith("#"), _state(s, under="open"))
            .when(first == '"', _quoted(s, number, rest, '"', inside))
            .when(first == "'", _quoted(s, number, rest, "'", inside))
            .when(first.isin("[", "{"), F.when(depth < 0, _bad(s, number, "a bracket is closed twice")).otherwise(_state(inside, depth=depth)))
            .when(first.isin("|", ">"), _state(s, under="text"))
            .when(first.isin("@", "`", "%"), _bad(s, number, F.concat(F.lit("a value cannot begin with "), first)))
            .when(value.rlike(r"^[^#]*?:(?:[ \t]|$)"), _bad(s, number, "a second colon in a value"))
            .otherwise(inside))


def _line(s: Column, number: Column, line: Column) -> Column:
    key = F.regexp_extract(line, _KEY, 1)
    value = F.trim(F.regexp_extract(line, _KEY, 2), F.lit(" \t"))
    added = _state(s, kind="map", keys=F.array_append(s["keys"], key))
    depth = s["depth"] + _brackets(line)
    margin = (
        F.when(line.rlike(r"^-(?:[ \t]|$)"), F.when((s["kind"] == "map") & (s["under"] != "open"), _bad(s, number, "a list item among keys"))
               .when(s["kind"] == "", _state(s, kind="list")).otherwise(s))
        .when(line.rlike(_KEY), F.when(s["kind"] == "list", _bad(s, number, "a key among list items"))
              .when(s["kind"] == "text", _bad(s, number, "a key after text"))
              .when(F.array_contains(s["keys"], key), _bad(s, number, F.concat(F.lit("key '"), key, F.lit("' is repeated"))))
              .otherwise(_value(added, number, value)))
        .when(s["kind"].isin("", "text"), _state(s, kind="text")).otherwise(_bad(s, number, "text without a key")))
    indented = (
        F.when(s["kind"] == "", _bad(s, number, "an indented line that belongs to nothing"))
        .when((s["kind"] == "map") & (s["under"] == "value") & line.rlike(r":(?:[ \t]|$)"), _bad(s, number, "a key under a value"))
        .otherwise(_state(s, under=F.when(s["under"] == "open", "block").otherwise(s["under"]))))
    return (F.when(s["defect"].isNotNull(), s)
            .when(s["quote"] == '"', _quoted(s, number, line, '"', _state(s, quote="")))
            .when(s["quote"] == "'", _quoted(s, number, line, "'", _state(s, quote="")))
            .when(s["depth"] > 0, F.when(depth < 0, _bad(s, number, "a bracket is closed twice")).otherwise(_state(s, depth=depth)))
            .when(line.rlike(r"^\s*(?:#.*)?$"), s)
            .when(line.rlike(r"^ *\t"), _bad(s, number, "a tab in the indentation"))
            .when(line.startswith(" "), indented).otherwise(margin))


def block_defect(block: Column) -> Column:
    """The violation of a frontmatter block, or NULL if it is a mapping."""
    keys = F.regexp_extract_all(block, F.lit(_PLAIN_KEY), F.lit(1))
    lines = F.transform(F.split(block, r"\r?\n"), lambda line, i: F.struct((i + 1).cast("string").alias("number"), line.alias("line")))
    start = F.struct(F.lit("").alias("quote"), F.lit(0).alias("depth"), F.lit("").alias("under"), F.lit("").alias("kind"),
                     F.array().cast("array<string>").alias("keys"), F.lit(None).cast("string").alias("defect")).cast(_STATE)

    def finish(s: Column) -> Column:
        return (F.when(s["defect"].isNotNull(), F.concat(F.lit(CANNOT_PARSE), s["defect"]))
                .when(s["quote"] != "", F.lit(CANNOT_PARSE + "a quote is not closed"))
                .when(s["depth"] > 0, F.lit(CANNOT_PARSE + "a bracket is not closed"))
                .when(s["kind"] != "map", F.lit(NOT_A_DICTIONARY)))

    folded = F.aggregate(lines, start, lambda s, x: _line(s, x["number"], x["line"]), finish)
    return F.when(~(block.rlike(_PLAIN) & (F.size(keys) == F.size(F.array_distinct(keys)))), folded)
