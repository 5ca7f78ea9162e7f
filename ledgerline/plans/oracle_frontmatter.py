"""DuckDB SQL of the frontmatter check: a reduction over the lines of the block.

Every element of the list and the state are one struct: a line (t, no), and
what is known after it: open quote q, open brackets d, what an indented line
would belong to u, kind of the block k, keys ks, first defect bad."""

from __future__ import annotations

_START = "q: '', d: 0, u: '', k: '', ks: []::varchar[], bad: NULL::varchar"
# After an opening quote: closed on this line, not closed on this line.
_QUOTE = {"dq": (r"""'^(?:[^"\\]|\\.)*"[ \t]*(?:#.*)?$'""", r"""'^(?:[^"\\]|\\.)*\\?$'"""),
          "sq": (r"""'^(?:[^'']|'''')*''[ \t]*(?:#.*)?$'""", r"""'^(?:[^'']|'''')*$'""")}
_KEY = r"'^(\S.*?)[ \t]*:(?:[ \t]+(.*))?$'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _next(**changed: str) -> str:
    fields = {"t": "''", "no": "0", "q": "s.q", "d": "s.d", "u": "s.u", "k": "s.k", "ks": "s.ks", "bad": "s.bad"} | changed
    return "{" + ", ".join(f"{k}: {v}" for k, v in fields.items()) + "}"


def _fails(what: str) -> str:
    return _next(bad=f"'line ' || x.no || ': ' || {what}")


def _brackets(v: str) -> str:
    return rf"(length(regexp_replace({v}, '[^\[{{]', '', 'g')) - length(regexp_replace({v}, '[^\]}}]', '', 'g')))::INTEGER"


def _after_quote(rest: str, mark: str, **then: str) -> str:
    closed, unclosed = _QUOTE[mark]
    return (f"CASE WHEN regexp_matches({rest}, {closed}) THEN {_next(**(then | {'q': _q('')}))} "
            f"WHEN regexp_matches({rest}, {unclosed}) THEN {_next(**(then | {'q': _q(mark)}))} "
            f"ELSE {_fails(_q('text after a closing quote'))} END")


def _of_key() -> str:
    key, value = f"regexp_extract(x.t, {_KEY}, 1)", f"trim(regexp_extract(x.t, {_KEY}, 2), ' ' || chr(9))"
    new = {"k": "'map'", "ks": f"list_append(s.ks, {key})"}
    first, rest, inside = f"left({value}, 1)", f"substr({value}, 2)", new | {"u": "'value'"}
    return f"""CASE WHEN s.k = 'list' THEN {_fails(_q('a key among list items'))}
 WHEN s.k = 'text' THEN {_fails(_q('a key after text'))}
 WHEN list_contains(s.ks, {key}) THEN {_fails("'key ''' || " + key + " || ''' is repeated'")}
 WHEN {value} = '' OR starts_with({value}, '#') THEN {_next(**new, u=_q('open'))}
 WHEN {first} = '"' THEN {_after_quote(rest, 'dq', **inside)}
 WHEN {first} = '''' THEN {_after_quote(rest, 'sq', **inside)}
 WHEN {first} IN ('[', '{{') THEN CASE WHEN {_brackets(value)} < 0 THEN {_fails(_q('a bracket is closed twice'))}
   ELSE {_next(**(inside | {'d': _brackets(value)}))} END
 WHEN {first} IN ('|', '>') THEN {_next(**new, u=_q('text'))}
 WHEN {first} IN ('@', '`', '%') THEN {_fails(_q('a value cannot begin with ') + ' || ' + first)}
 WHEN regexp_matches({value}, '^[^#]*?:(?:[ \\t]|$)') THEN {_fails(_q('a second colon in a value'))}
 ELSE {_next(**inside)} END"""


def _step() -> str:
    margin = f"""CASE WHEN regexp_matches(x.t, '^-(?:[ \\t]|$)') THEN
   CASE WHEN s.k = 'map' AND s.u <> 'open' THEN {_fails(_q('a list item among keys'))}
        WHEN s.k = '' THEN {_next(k=_q('list'))} ELSE {_next()} END
 WHEN regexp_matches(x.t, {_KEY}) THEN {_of_key()}
 WHEN s.k IN ('', 'text') THEN {_next(k=_q('text'))} ELSE {_fails(_q('text without a key'))} END"""
    indented = f"""CASE WHEN s.k = '' THEN {_fails(_q('an indented line that belongs to nothing'))}
 WHEN s.k = 'map' AND s.u = 'value' AND regexp_matches(x.t, ':(?:[ \\t]|$)') THEN {_fails(_q('a key under a value'))}
 ELSE {_next(u="CASE s.u WHEN 'open' THEN 'block' ELSE s.u END")} END"""
    return f"""CASE WHEN s.bad IS NOT NULL THEN {_next()}
 WHEN s.q = 'dq' THEN {_after_quote('x.t', 'dq')}
 WHEN s.q = 'sq' THEN {_after_quote('x.t', 'sq')}
 WHEN s.d > 0 THEN CASE WHEN s.d + {_brackets('x.t')} < 0 THEN {_fails(_q('a bracket is closed twice'))}
   ELSE {_next(d='(s.d + ' + _brackets('x.t') + ')')} END
 WHEN regexp_matches(x.t, '^\\s*(?:#.*)?$') THEN {_next()}
 WHEN regexp_matches(x.t, '^ *\\t') THEN {_fails(_q('a tab in the indentation'))}
 WHEN starts_with(x.t, ' ') THEN {indented} ELSE {margin} END"""


def block_defect(block: str) -> str:
    """SQL list whose only element is the violation of the block, or NULL."""
    lines = (f"list_transform(string_split(replace({block}, chr(13) || chr(10), chr(10)), chr(10)), lambda l, i: "
             f"{{t: l, no: i::INTEGER, {_START}}})")
    end = f"list_reduce({lines}, lambda s, x: {_step()}, {{t: '', no: 0, {_START}}})"
    return f"""list_transform([{end}], lambda e: CASE WHEN e.bad IS NOT NULL THEN 'Failed to parse YAML frontmatter: ' || e.bad
 WHEN e.q <> '' THEN 'Failed to parse YAML frontmatter: a quote is not closed'
 WHEN e.d > 0 THEN 'Failed to parse YAML frontmatter: a bracket is not closed'
 WHEN e.k <> 'map' THEN 'YAML frontmatter is not a valid dictionary.' END)"""
