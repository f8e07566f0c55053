"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each is normalised, and those of the sentence tables are replaced by their
identifiers. A sentence may be wrapped over several lines. The identifiers in text order are then matched with ordered rules: a rule is a
run of identifiers, earlier (longer) rules take their identifiers first. All is one narrow pass
over whole texts: no shuffle, nothing broadcast but the constants below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ascii_lower, documents, read_documents

#: Identifier and normalised sentence.
SENTENCES = {
    "apache-grant": "licensed under the apache license version 2 0",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-grant": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "as-is": "the software is provided as is without warranty of any kind",
    "gpl3-grant": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted",
    "reserved": "all rights reserved",
}
#: Licence and the run of identifiers that states it, in the order of matching.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-compliance", "apache-copy")),
    ("MIT", ("mit-permission", "as-is")),
    ("Apache-2.0", ("apache-grant", "apache-compliance")),
    ("BSD", ("reserved", "bsd-redistribution")),
    ("Apache-2.0", ("apache-grant",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-permission",)),
    ("GPL-3.0", ("gpl3-grant",)),
    ("GPL", ("gpl-redistribute",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD", ("bsd-redistribution",)),
    ("Proprietary", ("reserved",)),
)
_GNU = "{} is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version 3 of the license or at your option any later version"
_CC = "this work is licensed under {} creative commons attribution {}4 0 international license"
_WAIVED = "to the extent possible under law {} has waived all copyright and related or neighboring rights to this work"
#: Identifier and normalised sentences of the published notices. The blank line before its address ends the Apache sentence.
NOTICES = {
    "apache-grant": ("licensed under the apache license version 2 0 the license",),
    "apache-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache-basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache-limits": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit-permission": (SENTENCES["mit-permission"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as-is": (SENTENCES["as-is"] + " express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "bsd-redistribution": tuple(SENTENCES["bsd-redistribution"] + " provided that the following conditions are met" + x for x in ("", " 1")),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "gpl-version-3": (_GNU.format("this program", "general public license"), _GNU.format("this file", "general public license")),
    "gpl-version-2-part": ("either version 2 of the license or at your option any later version",),
    "gpl-version-3-part": ("either version 3 of the license or at your option any later version",),
    "agpl-version-3": (_GNU.format("this program", "affero general public license"),),
    "lgpl-version-3": (_GNU.format("this program", "lesser general public license"), _GNU.format("this library", "lesser general public license")),
    "cc-by-nc-4": (_CC.format("a", "noncommercial "), _CC.format("the", "noncommercial ")),
    "cc-by-4": (_CC.format("a", ""), _CC.format("the", "")),
    "cc0": (_WAIVED.format("the author"), _WAIVED.format("the person who associated cc0 with this work"), "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
}
#: Rules that are matched after the first four of RULES and before the others.
NOTICE_RULES = (
    ("Apache-2.0", ("apache-compliance", "apache-copy")),
    ("Apache-2.0", ("apache-basis", "apache-limits")),
    ("MIT", ("mit-permission", "mit-notice", "as-is")),
    ("MIT", ("mit-notice", "as-is", "mit-liability")),
    ("BSD", ("bsd-source", "bsd-binary")),
    ("GPL-2.0", ("gpl-redistribute", "gpl-version-2-part")),
    ("GPL-3.0", ("gpl-redistribute", "gpl-version-3-part")),
    ("GPL-3.0", ("gpl-version-3",)),
    ("AGPL-3.0", ("agpl-version-3",)),
    ("LGPL-3.0", ("lgpl-version-3",)),
)
#: Licences by their published identifiers, and the names, normalised, by which statements call them.
NAMES = {
    "MIT": ("mit license", "mit licence", "mit"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0 only", "gpl 3 0 or later", "gpl 3 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0 only", "gpl 2 0 or later", "gpl 2 0"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl v3", "lgplv3", "lgpl 3 0 only", "lgpl 3 0 or later", "lgpl 3 0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl v3", "agplv3", "agpl 3 0 only", "agpl 3 0 or later", "agpl 3 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "ISC": ("isc license", "isc"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "bsd 3 clause"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"),
    "BSD": ("bsd license",),
    "CC-BY-4.0": ("creative commons attribution 4 0 international license", "creative commons attribution 4 0 license", "cc by 4 0 license", "cc by 4 0"),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 license", "cc by sa 4 0 license", "cc by sa 4 0"),
    "CC-BY-NC-4.0": ("creative commons attribution noncommercial 4 0 international license", "cc by nc 4 0 license", "cc by nc 4 0"),
    "CC0-1.0": ("cc0 1 0 universal", "cc0 1 0", "cc0"),
    "Unlicense": ("unlicense",),
}
#: Sentences that the texts of further licences have, with the licence each states.
OWN_SENTENCES = {
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL-2.0",
    # The point behind the abbreviation ends the sentence where white space follows.
    "this source code form is subject to the terms of the mozilla public license v": "MPL-2.0",
    "this is free and unencumbered software released into the public domain": "Unlicense",
}
_SUBJECT = "(?:(?:this|the) (?:project|software|program|work|file|code|source code|library|package|module|material|document|content|repository) (?:is |are |has been )?)?"
_VERB = "(?:dual |also )?(?:licensed|released|distributed|available|made available|provided|published|offered) under (?:the terms of )?(?:either )?(?:the )?(?:a )?"
_TAIL = "(?: see (?:the )?(?:license|licence|copying)(?: file| md| txt)*(?: for (?:more |the full )?(?:details|information|text|terms))?)?"
_NAME = "(?:" + "|".join(sorted((n for names in NAMES.values() for n in names), key=len, reverse=True)) + ")"
_NAMED = f"{_NAME}(?: (?:and|or) (?:the )?{_NAME})*"
#: Statements that name licences: a grant, with who grants and where the text is, or an identifier line.
STATEMENTS = (f"{_SUBJECT}{_VERB}{_NAMED}{_TAIL}", f"(?:spdx license identifier|license|licence) {_NAMED}")
_ALL_RULES = RULES[:4] + NOTICE_RULES + RULES[4:] + tuple((name, (f"named-{name.lower()}",)) for name in NAMES)
_IDS = {s: i for i, s in SENTENCES.items()} | {s: i for i, many in NOTICES.items() for s in many} | {s: f"named-{name.lower()}" for s, name in OWN_SENTENCES.items()}
_NAMED_IDS = {n: f"named-{name.lower()}" for name, names in NAMES.items() for n in names}
#: A known sentence from the start of a line to the end of one, single line breaks between its words; the longest first, and statements last.
_KNOWN = "(?md)^ ?(" + "|".join(s.replace(" ", "(?: | ?\n ?)") for s in (*sorted(_IDS, key=len, reverse=True), *STATEMENTS)) + ")(?= ?$)"


def normalized(text: Column) -> Column:
    """Lower-case words with one blank or line break between them; a sentence ends at . ! ? ; before white space, which
    becomes an empty line, and at empty lines of the text."""
    ended = F.regexp_replace(text, r"([.!?;])[ \t\r\n]+", "$1\n\n")
    return F.regexp_replace(ascii_lower(ended), r"[^a-z0-9\n]+", " ")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in text order."""
    known = F.regexp_extract_all(normalized(text), F.lit(_KNOWN), F.lit(1))
    table, named = (F.create_map(*(F.lit(x) for pair in ids.items() for x in pair)) for ids in (_IDS, _NAMED_IDS))

    def ids(s: Column) -> Column:
        names = F.regexp_extract_all(s, F.lit(rf"\b{_NAME}\b(?! (?:clause|0))"), F.lit(0))
        return F.when(F.map_contains_key(table, s), F.array(F.try_element_at(table, s))).otherwise(F.transform(names, lambda n: F.element_at(named, n)))

    return F.flatten(F.transform(F.transform(known, lambda s: F.regexp_replace(s, r" ?\n ?", " ")), ids))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, primary_license), one row per input row.

    n_sentences counts the known sentences; sentence_ids joins their identifiers, in text order, by one space;
    licenses joins the distinct licences, in the order of the rules, by commas; primary_license is the
    first of them, null without any.

    * a sentence is known from its first to its last word; a statement may name its subject, several licences, and the file with the text;
    * where rules overlap, the earlier one takes its identifiers, and later rules match what is left;
    * null and empty texts have no sentence; a very long text is one row of one task, read once from start to end;
    * a null doc_id stays null; repeated rows give repeated rows; an empty table gives an empty result; further columns are ignored.
    """
    rows = documents(docs).select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"))
    # Each identifier has a blank on both sides, so that a run is found as a substring.
    left, found = F.concat(F.lit("  "), F.replace(F.col("sentence_ids"), F.lit(" "), F.lit("  ")), F.lit("  ")), []
    rows = rows.withColumn("left", left)
    for i, (name, run) in enumerate(_ALL_RULES):
        pattern = F.lit(f" {'  '.join(run)} ")
        found.append(F.when(F.col(f"hit{i}"), F.lit(name)))
        rows = rows.select("*", F.contains("left", pattern).alias(f"hit{i}")).withColumn("left", F.replace(F.col("left"), pattern, F.lit(" | ")))
    licenses = F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return rows.select("doc_id", "n_sentences", "sentence_ids", F.array_join(licenses, ",").alias("licenses"), F.try_element_at(licenses, F.lit(1)).alias("primary_license"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_documents(spark, sf_dir))


def op1_sql() -> str:
    """The whole scan: tables, notices, statements and all rules."""
    known, named = (", ".join(f"('{s}', '{i}')" for s, i in ids.items()) for ids in (_IDS, _NAMED_IDS))
    steps, left = [], "s0"
    for i, (_, run) in enumerate(_ALL_RULES):
        pattern = f" {'  '.join(run)} "
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (l), contains(l, '{pattern}') AS hit{i}, replace(l, '{pattern}', ' | ') AS l FROM {left})")
        left = f"s{i + 1}"
    hits = ", ".join(f"CASE WHEN hit{i} THEN '{name}' END" for i, (name, _) in enumerate(_ALL_RULES))
    # No lookahead in this dialect: what follows a sentence is consumed, as the next one starts on another line anyway; and a name can't be followed by
    # " clause" or " 0" in a statement, where the longest name is taken.
    sentence = _KNOWN.replace("(?md)", "(?m)").replace("(?= ?$)", " ?$")
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
named(name, id) AS (VALUES {named}),
cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(translate(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10) || chr(10), 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g') AS plain FROM documents),
parts AS (SELECT r, list_transform(regexp_extract_all(plain, '{sentence}', 1), lambda s: regexp_replace(s, ' ?\\n ?', ' ', 'g')) AS parts FROM cut),
flat AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM parts),
statements AS (SELECT r, k, regexp_extract_all(part, '\\b{_NAME}\\b') AS names FROM flat WHERE part NOT IN (SELECT sentence FROM known)),
every AS (SELECT r, k, 0 AS j, id FROM flat JOIN known ON part = sentence
    UNION ALL SELECT r, k, j, id FROM (SELECT r, k, unnest(names) AS name, generate_subscripts(names, 1) AS j FROM statements) JOIN named USING (name)),
ids AS (SELECT r, count(*) AS n, string_agg(id, ' ' ORDER BY k, j) AS ids FROM every GROUP BY r),
s0 AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, '  ' || replace(coalesce(ids, ''), ' ', '  ') || '  ' AS l FROM cut LEFT JOIN ids USING (r)),
{', '.join(steps)},
found AS (SELECT doc_id, n_sentences, sentence_ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS names FROM {left}),
firsts AS (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i) AS uniq FROM found)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(uniq, ',') AS licenses, uniq[1] AS primary_license FROM firsts
"""
