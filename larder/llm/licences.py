"""Licence scans by sentence rules.

A text is cut into sentences; those with a critical word are normalised and looked up among known licence sentences.
What remains of a document is a sequence of sentence identifiers, and ordered rules turn runs of identifiers
into licences: a rule that comes first takes its run, so a full licence text is not read as the short
reference inside it.  A known sentence may be wrapped, with comment signs before its lines; other text ends a sentence at
every line break.  Sentences with a critical word that no table knows are counted as unknown.

Everything is string and array functions in the row; nothing is exchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of which a sentence needs one to be looked at, in lower case.
CRITICAL = ("licens", "licenc", "copyright", "warrant", "permission", "permitted", "redistribut", "public domain", "spdx", "cc by", "liab")

#: Identifier and normalised sentence: lower case, other signs than letters, digits and dots as one space, no dots or spaces at the end.
#: The wording of the licences themselves.
SENTENCES = (
    ("apache2_ref", "licensed under the apache license version 2.0"),
    ("apache2_ref", "licensed under the apache license version 2.0 the license"),
    ("apache2_ref", "this file is licensed under the apache license version 2.0"),
    ("apache2_ref", "released under the apache license version 2.0"),
    ("apache2_not_except", "you may not use this file except in compliance with the license"),
    ("apache2_obtain", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"),
    ("apache2_unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                       "without warranties or conditions of any kind either express or implied"),
    ("apache2_see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit_ref", "released under the mit license"),
    ("mit_ref", "licensed under the mit license"),
    ("mit_ref", "this project is licensed under the mit license"),
    ("mit_ref", "the mit license mit"),
    ("mit_ref", "mit license"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                  "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
                  "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
                  "subject to the following conditions"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
              "merchantability fitness for a particular purpose and noninfringement"),
    ("no_liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
                     "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl3_ref", "this work is licensed under the gnu general public license version 3"),
    ("gpl3_ref", "licensed under the gnu general public license version 3"),
    ("gpl3_ref", "released under the gnu general public license version 3"),
    ("gpl2_ref", "this work is licensed under the gnu general public license version 2"),
    ("gpl2_ref", "licensed under the gnu general public license version 2"),
    ("gpl3_later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                   "the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2_later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                   "the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
                 "merchantability or fitness for a particular purpose"),
    ("gpl_details", "see the gnu general public license for more details"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl21_ref", "licensed under the gnu lesser general public license version 2.1"),
    ("lgpl3_ref", "licensed under the gnu lesser general public license version 3"),
    ("agpl3_ref", "licensed under the gnu affero general public license version 3"),
    ("bsd_redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                           "conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
                   "documentation and or other materials provided with the distribution"),
    ("bsd_endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                    "from this software without specific prior written permission"),
    ("bsd_ref", "licensed under the bsd license"),
    ("bsd3_ref", "licensed under the bsd 3 clause license"),
    ("bsd2_ref", "licensed under the bsd 2 clause license"),
    ("mpl2_ref", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("mpl2_ref", "licensed under the mozilla public license version 2.0"),
    ("ccby4_ref", "licensed under cc by 4.0"),
    ("ccbysa4_ref", "licensed under cc by sa 4.0"),
    ("ccbync4_ref", "licensed under cc by nc 4.0"),
    ("ccbyncsa4_ref", "licensed under cc by nc sa 4.0"),
    ("ccbynd4_ref", "licensed under cc by nd 4.0"),
    ("ccbyncnd4_ref", "licensed under cc by nc nd 4.0"),
    ("cc0_ref", "licensed under cc0 1.0"),
    ("public_domain", "this work is in the public domain"),
    ("public_domain", "this is free and unencumbered software released into the public domain"),
    ("all_rights", "all rights reserved"),
    ("spdx_mit", "spdx license identifier mit"),
    ("spdx_apache2", "spdx license identifier apache 2.0"),
    ("spdx_gpl3", "spdx license identifier gpl 3.0 only"),
    ("spdx_gpl3_later", "spdx license identifier gpl 3.0 or later"),
    ("spdx_bsd3", "spdx license identifier bsd 3 clause"),
)

#: Licence and the run of sentence identifiers that states it, in the order of trial.
RULES = (
    ("Apache-2.0", ("apache2_ref", "apache2_not_except", "apache2_obtain", "apache2_unless", "apache2_see")),
    ("Apache-2.0", ("apache2_ref", "apache2_not_except", "apache2_unless", "apache2_see")),
    ("Apache-2.0", ("apache2_ref",)),
    ("MIT", ("mit_ref", "mit_grant", "mit_notice", "as_is", "no_liability")),
    ("MIT", ("mit_grant", "mit_notice", "as_is", "no_liability")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_ref",)),
    ("GPL-3.0-or-later", ("gpl3_later", "gpl_hope", "gpl_details", "gpl_copy")),
    ("GPL-3.0-or-later", ("gpl3_later", "gpl_hope", "gpl_details")),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later", "gpl_hope", "gpl_details", "gpl_copy")),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("GPL-3.0", ("gpl3_ref",)),
    ("GPL-2.0", ("gpl2_ref",)),
    ("LGPL-2.1", ("lgpl21_ref",)),
    ("LGPL-3.0", ("lgpl3_ref",)),
    ("AGPL-3.0", ("agpl3_ref",)),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd3_ref",)),
    ("BSD-2-Clause", ("bsd2_ref",)),
    ("BSD", ("bsd_ref",)),
    ("MPL-2.0", ("mpl2_ref",)),
    ("CC-BY-4.0", ("ccby4_ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4_ref",)),
    ("CC-BY-NC-4.0", ("ccbync4_ref",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4_ref",)),
    ("CC-BY-ND-4.0", ("ccbynd4_ref",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd4_ref",)),
    ("CC0-1.0", ("cc0_ref",)),
    ("public-domain", ("public_domain",)),
    ("MIT", ("spdx_mit",)),
    ("Apache-2.0", ("spdx_apache2",)),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("GPL-3.0-or-later", ("spdx_gpl3_later",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
)

#: White space that ends a sentence after its sign, and signs that a normalised sentence keeps.
_ENDS, _OTHER, _TAIL = "[.!?]+[ \\t\\r\\n]+|[;:]?[\\r\\n]+", "[^a-z0-9.]+", "[. ]+$"

#: Of a wrapped sentence: what stands before it (a sentence or line end, comment signs), between its words (line breaks and comment
#: signs too), and after it.
_BEFORE, _BETWEEN = "(^[^a-z0-9.]*|[\\r\\n][^a-z0-9.]*|[.!?][ \\t]+[^a-z0-9.]*)", "[^a-z0-9.!?]+"
_AFTER = "([^a-z0-9.!?\\r\\n]*(?:[.!?]+(?:[ \\t\\r\\n]|$)|[\\r\\n]|$))"


def _wrapped() -> list[tuple[str, str, str]]:
    """(longest word, pattern, line) of every known sentence, longer ones first; the line is what replaces it, in one piece."""
    known = sorted({s for _, s in SENTENCES}, key=lambda s: (-len(s), s))
    # no space after a dot, which would end the sentence
    return [(max(s.split(), key=len), _BEFORE + _BETWEEN.join(re.escape(w) for w in s.split()) + _AFTER, s.replace(". ", "._")) for s in known]


def _unwrapped(text: Column) -> Column:
    """The text with every known sentence, where line breaks and comment signs cut it, on one line of its own; longer ones first."""
    # a fold over a literal array, as so many nested expressions would be too deep for the planner; few patterns are tried on a text
    rows = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(p).alias("pattern"), F.lit(f"$1\n{s}\n$2").alias("line")) for w, p, s in _wrapped()])
    return F.aggregate(rows, text, lambda t, s: F.when(
        F.contains(t, s["word"]), F.regexp_replace(t, s["pattern"], s["line"])).otherwise(t))


def _has_critical(text: Column) -> Column:
    found = F.lit(False)
    for word in CRITICAL:
        found = found | F.contains(text, F.lit(word))
    return found


def _identifier(sentence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for s, i in dict((s, i) for i, s in SENTENCES).items() for x in (s, i)])
    return F.coalesce(F.element_at(table, sentence), F.lit("unknown"))


def scanned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, licences, sentences, n_unknown) for every row.

    ``licences`` are the distinct licences found, sorted and joined by "; ", "" if none; ``sentences`` the identifiers in order
    of the text, joined by one space, "unknown" for a critical sentence that no table knows; ``n_unknown`` the number of critical
    sentences that no rule used.  A null text has none.  Equal rows have equal results.
    """
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id), lower.alias("__t"))
    rows = rows.withColumn("__t", F.when(_has_critical(F.col("__t")) & F.col("__t").rlike("[\\r\\n]"), _unwrapped(F.col("__t"))).otherwise(F.col("__t")))
    parts = F.split(F.regexp_replace("__t", _ENDS, "\n"), "\n")
    normal = F.transform(F.filter(parts, _has_critical),
                         lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, _OTHER, " ")), _TAIL, ""))
    identified = F.when(_has_critical(F.col("__t")), F.transform(normal, _identifier)).otherwise(F.array().cast("array<string>"))
    rows = rows.select(doc_id, F.array_join(identified, " ").alias("sentences"))
    # every identifier between bars of its own, so that a run of them is a plain substring
    run = F.concat(F.lit("|"), F.replace("sentences", F.lit(" "), F.lit("||")), F.lit("|"))
    for licence, needed in RULES:
        run = F.replace(run, F.lit("".join(f"|{i}|" for i in needed)), F.lit(f"<{licence}>"))
    rows = rows.withColumn("__run", F.when(F.col("sentences") == "", F.lit("")).otherwise(run))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("__run", F.lit("<([^>]+)>"), F.lit(1))))
    return rows.select(doc_id, F.array_join(found, "; ").alias("licences"), "sentences",
                       F.regexp_count("__run", F.lit(r"\|[a-z0-9_]+\|")).cast("long").alias("n_unknown"))


def sql() -> str:
    """The scan of ``documents`` in DuckDB, from the same tables."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"
    critical = " OR ".join(f"contains({{0}}, {quoted(w)})" for w in CRITICAL)
    known = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(i)}" for s, i in dict((s, i) for i, s in SENTENCES).items()) + "}"
    run = "'|' || replace(sentences, ' ', '||') || '|'"
    for licence, needed in RULES:
        run = f"replace({run}, {quoted(''.join(f'|{i}|' for i in needed))}, {quoted(f'<{licence}>')})"
    whole = "t"
    for _, pattern, line in _wrapped():
        whole = f"regexp_replace({whole}, {quoted(pattern)}, concat('\\1', chr(10), {quoted(line)}, chr(10), '\\2'), 'g')"
    return f"""
WITH lowered AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
unwrapped AS (SELECT doc_id, CASE WHEN ({critical.format('t')}) AND regexp_matches(t, '[\\r\\n]') THEN {whole} ELSE t END AS t FROM lowered),
parts AS (SELECT doc_id, CASE WHEN {critical.format('t')} THEN list_filter(
    string_split(regexp_replace(t, '[.!?]+[ \\t\\r\\n]+|[;:]?[\\r\\n]+', chr(10), 'g'), chr(10)), lambda s: {critical.format('s')}) ELSE [] END AS p FROM unwrapped),
named AS (SELECT doc_id, array_to_string(list_transform(p, lambda s: coalesce({known}[
    regexp_replace(trim(regexp_replace(s, '[^a-z0-9.]+', ' ', 'g')), '[. ]+$', '')], 'unknown')), ' ') AS sentences FROM parts),
ruled AS (SELECT doc_id, sentences, CASE WHEN sentences = '' THEN '' ELSE {run} END AS run FROM named)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(run, '<([^>]+)>', 1))), '; ') AS licences, sentences,
       CAST(len(regexp_extract_all(run, '\\|[a-z0-9_]+\\|')) AS BIGINT) AS n_unknown
FROM ruled"""
