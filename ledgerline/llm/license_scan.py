"""Licence scan by sentence rules (native).

A text is lower-cased, cut (line ends; full stops, question and exclamation
marks, colons and semicolons before white space) and normalised (anything but
letters and digits becomes one space).  A known sentence is found from cut to
cut and maps to its identifier; it may run on over single line ends (also with
comment marks that hold no letters), colons and semicolons, so hard-wrapped
notices are read whole, but not over lines without letters and digits, full
stops, question and exclamation marks.  Of two known sentences that start at
one place the longer one counts.  The identifiers in text order are the
document's sequence.  The licence rules are tried in order, the longer ones
first: each match of a rule's identifiers, adjacent in the sequence, counts for
its licence and is used up.

All of it is one projection of built-in functions: no shuffle, so neither long
texts nor hot groups gather anywhere; the tables below are fixed.

Defined cases: a null or empty text has no sentence and no licence; repeated
sentences count each time; repeated rows are scanned each; an empty table
gives no rows.  Extra columns are ignored by the query and kept by
:func:`scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence notices.
SENTENCES = {
    "MIT-REF": ["released under the mit license", "licensed under the mit license",
                "this project is licensed under the mit license"],
    "MIT-GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction including "
                  "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                  "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                  "the following conditions"],
    "MIT-NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the software"],
    "MIT-ASIS": ["the software is provided as is without warranty of any kind express or implied including but not "
                 "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "APACHE2-REF": ["licensed under the apache license version 2 0",
                    "licensed under the apache license version 2 0 the license"],
    "APACHE2-USE": ["you may not use this file except in compliance with the license"],
    "APACHE2-COPY": ["you may obtain a copy of the license at"],
    "APACHE2-ASIS": ["unless required by applicable law or agreed to in writing software distributed under the license "
                     "is distributed on an as is basis without warranties or conditions of any kind either express or "
                     "implied"],
    "APACHE2-SEE": ["see the license for the specific language governing permissions and limitations under the license"],
    "GPL3-REF": ["this work is licensed under the gnu general public license version 3",
                 "licensed under the gnu general public license version 3"],
    "GPL2-REF": ["this work is licensed under the gnu general public license version 2",
                 "licensed under the gnu general public license version 2"],
    "GPL-FREE3": ["this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "general public license as published by the free software foundation either version 3 of the license "
                  "or at your option any later version"],
    "GPL-FREE2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "general public license as published by the free software foundation either version 2 of the license "
                  "or at your option any later version"],
    "GPL-HOPE": ["this program is distributed in the hope that it will be useful but without any warranty without even "
                 "the implied warranty of merchantability or fitness for a particular purpose"],
    "GPL-SEE": ["see the gnu general public license for more details"],
    "BSD-REDIST": ["redistribution and use in source and binary forms with or without modification are permitted "
                   "provided that the following conditions are met"],
    "BSD-SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and "
                   "the following disclaimer"],
    "BSD-BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions "
                   "and the following disclaimer in the documentation and or other materials provided with the "
                   "distribution"],
    "CCBYNC4-REF": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "CCBY4-REF": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0",
                  "this work is licensed under a creative commons attribution 4 0 international license"],
    "ALL-RIGHTS": ["all rights reserved"],
}

# Ordered rules, licence and adjacent sentence identifiers.
RULES = [
    ("Apache-2.0", ["APACHE2-REF", "APACHE2-USE", "APACHE2-COPY", "APACHE2-ASIS", "APACHE2-SEE"]),
    ("GPL-3.0-or-later", ["GPL-FREE3", "GPL-HOPE", "GPL-SEE"]),
    ("GPL-2.0-or-later", ["GPL-FREE2", "GPL-HOPE", "GPL-SEE"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE", "MIT-ASIS"]),
    ("BSD-2-Clause", ["BSD-REDIST", "BSD-SOURCE", "BSD-BINARY"]),
    ("GPL-3.0-or-later", ["GPL-FREE3"]),
    ("GPL-2.0-or-later", ["GPL-FREE2"]),
    ("MIT", ["MIT-REF"]),
    ("MIT", ["MIT-GRANT"]),
    ("Apache-2.0", ["APACHE2-REF"]),
    ("GPL-3.0", ["GPL3-REF"]),
    ("GPL-2.0", ["GPL2-REF"]),
    ("CC-BY-NC-4.0", ["CCBYNC4-REF"]),
    ("CC-BY-4.0", ["CCBY4-REF"]),
    ("Proprietary", ["ALL-RIGHTS"]),
]

# Cuts in a lower-case text become capitals.  F: a sentence ends (punctuation
# with a full stop, question or exclamation mark before white space; lines
# without letters and digits).  L: it may run on (other punctuation before
# white space; line ends).
_FULL = (r"(?<![.!?:;])[:;]*+[.!?][.!?:;]*+(?=[ \t\n\r\f]|$)"
         r"|(?>\r\n|[\n\r])(?>[^a-z0-9\n\r]*+(?>\r\n|[\n\r]))++")
_LIGHT = r"(?<![.!?:;])[:;]++(?=[ \t\n\r\f]|$)|[\n\r]"
_NOISE = r"[^a-z0-9FL]+"
_KNOWN = ("[FL] ?(" + "|".join(s.replace(" ", "[ L]++") for s in sorted(
    (s for sentences in SENTENCES.values() for s in sentences), key=len, reverse=True)) + ")(?= ?[FL])")


def _identifiers(text: Column) -> Column:
    """Identifiers of the known sentences, in text order."""
    known = [x for name, sentences in SENTENCES.items() for s in sentences for x in (F.lit(s), F.lit(name))]
    table = F.create_map(*known)
    cut = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _FULL, "F"), _LIGHT, "L")
    normal = F.concat(F.lit("F"), F.regexp_replace(cut, _NOISE, " "), F.lit("F"))
    found = F.regexp_extract_all(normal, F.lit(_KNOWN), F.lit(1))
    return F.transform(found, lambda s: F.element_at(table, F.regexp_replace(s, "[ L]+", " ")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the input row), ``sentence_ids`` (array), ``matches`` (array
    of licence and count per rule, rules in order), ``rest`` (identifiers that
    no rule used)."""
    out = docs.select(F.struct("*").alias("row"), _identifiers(F.col(text)).alias("sentence_ids"))
    left = F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    out = out.withColumn("left0", left)
    for i, (_, ids) in enumerate(RULES):
        rule = "".join(f"<{x}>" for x in ids)
        out = out.withColumn(f"left{i + 1}", F.replace(F.col(f"left{i}"), F.lit(rule), F.lit("|")))
    # Every use shortens the sequence by the rule's length less the mark.
    counts = [F.struct(F.lit(name).alias("licence"),
                       ((F.length(f"left{i}") - F.length(f"left{i + 1}")) / (sum(len(x) + 2 for x in ids) - 1)).cast("int").alias("n"))
              for i, (name, ids) in enumerate(RULES)]
    return out.select("row", "sentence_ids", F.filter(F.array(*counts), lambda m: m["n"] > 0).alias("matches"),
                      F.replace(F.col(f"left{len(RULES)}"), F.lit("|"), F.lit("")).alias("rest"))


# --- query ---------------------------------------------------------------

def op1_license_scan(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.col("matches.licence")), ",").alias("licences"),
        F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["n"]).alias("n_matches"),
        F.col("rest").alias("unmatched"))


def _sql() -> str:
    known = ", ".join(f"'{s}': '{name}'" for name, sentences in SENTENCES.items() for s in sentences)
    steps, left = [], "seq0"
    for i, (_, ids) in enumerate(RULES):
        rule = "".join(f"<{x}>" for x in ids)
        steps.append(f"r{i} AS (SELECT *, replace(seq{i}, '{rule}', '|') AS seq{i + 1} FROM {'s' if i == 0 else f'r{i - 1}'})")
    use = [f"((length(seq{i}) - length(seq{i + 1})) // {sum(len(x) + 2 for x in ids) - 1})" for i, (_, ids) in enumerate(RULES)]
    names = list(dict.fromkeys(name for name, _ in RULES))
    # Distinct licences in the order of their first rule that matched.
    first = {n: "least(" + ", ".join(f"CASE WHEN {use[i]} > 0 THEN {i} ELSE 999 END" for i, (m, _) in enumerate(RULES) if m == n) + ", 999)" for n in names}
    ranked = ", ".join(f"{{'i': {first[n]}, 'n': '{n}'}}" for n in names)
    return f"""
WITH k AS (SELECT MAP {{{known}}} AS m),
s AS (
  SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS seq0 FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')),
      '[.!?:;]+([ \\t\\n\\r\\f]|$)|[\\n\\r]+', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)),
      lambda x: m[trim(x)]), lambda x: x IS NOT NULL) AS ids FROM documents, k)),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_transform(list_filter(list_sort([{ranked}]), lambda x: x.i < 999), lambda x: x.n), ','), '') AS licences,
  ({" + ".join(use)})::BIGINT AS n_matches, replace(seq{len(RULES)}, '|', '') AS unmatched
FROM r{len(RULES) - 1}
"""


SQL = _sql()
