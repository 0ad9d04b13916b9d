"""Licence recognition by sentence rules, in DataFrame operations alone.

A text is cut into sentences, each is normalised (lower case, letters and digits only, single spaces), and sentences
that are known from licences become identifiers. A known sentence is also found where line breaks and comment signs
stand between its words, and the sentences of full notices stand for all that begin with them; short references must
match whole, as what follows ("or later") can change the licence. n_sentences counts the plain cut. The sequence of a
text's identifiers is then read by ordered rules: a rule names the licence whose identifiers stand in a row, the
rules of most identifiers first, and what a rule has read is not read again. A full licence text is known by its title
and date.

A null or empty text has no sentences; rows that repeat a doc_id, or lack one, are read each; texts are read whole,
whatever their length; an empty table gives no rows; a text of licence words that no rule knows is told apart as
"unknown".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace.llm.common import table

# Normalised sentences of common licences and notices, by identifier.
SENTENCES: dict[str, list[str]] = {
    "APACHE2-REF": ["licensed under the apache license version 2 0", "this project is licensed under the apache license version 2 0", "released under the apache license version 2 0"],
    "APACHE2-GRANT": ["licensed under the apache license version 2 0 the license"],
    "APACHE2-COMPLY": ["you may not use this file except in compliance with the license"],
    "APACHE2-COPY": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "APACHE2-ASIS": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "APACHE2-SEE": ["see the license for the specific language governing permissions and limitations under the license"],
    "MIT-REF": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "this project is licensed under the mit license"],
    "MIT-GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT-NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MIT-ASIS": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "GPL3-REF": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "GPL2-REF": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "GPL3-LATER": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPL2-LATER": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "LGPL21-LATER": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "LGPL3-LATER": [f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version" for what in ("program", "library")],
    "AGPL3-LATER": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "APACHE2-TITLE": ["version 2 0 january 2004", "version 2 0 january 2004 http www apache org licenses", "version 2 0 january 2004 https www apache org licenses"],
    "GPL-TITLE": ["gnu general public license"],
    "LGPL-TITLE": ["gnu lesser general public license"],
    "AGPL-TITLE": ["gnu affero general public license"],
    "GPL2-DATE": ["version 2 june 1991"],
    "LGPL21-DATE": ["version 2 1 february 1999"],
    "GPL3-DATE": ["version 3 29 june 2007"],
    "AGPL3-DATE": ["version 3 19 november 2007"],
    "ISC-GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "UNLICENSE": ["this is free and unencumbered software released into the public domain"],
    "EPL2-REF": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "licensed under the eclipse public license 2 0"],
    "GPL-HOPE": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GPL-SEE": ["see the gnu general public license for more details"],
    "BSD-GRANT": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD-SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD-BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD-ENDORSE": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD3-REF": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "BSD2-REF": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "MPL2-REF": ["this source code form is subject to the terms of the mozilla public license v", "licensed under the mozilla public license version 2 0"],
    "CC-BY-REF": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-SA-REF": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-REF": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC0-REF": ["licensed under cc0 1 0", "released under cc0 1 0"],
    "RIGHTS": ["all rights reserved"],
}
# Ordered rules, identifiers in a row and the licence that they make.
RULES: list[tuple[list[str], str]] = [
    (["APACHE2-GRANT", "APACHE2-COMPLY", "APACHE2-COPY", "APACHE2-ASIS", "APACHE2-SEE"], "Apache-2.0"),
    (["APACHE2-GRANT", "APACHE2-COMPLY", "APACHE2-COPY"], "Apache-2.0"),
    (["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE"], "BSD-3-Clause"),
    (["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"], "BSD-2-Clause"),
    (["GPL3-LATER", "GPL-HOPE", "GPL-SEE"], "GPL-3.0-or-later"),
    (["GPL2-LATER", "GPL-HOPE", "GPL-SEE"], "GPL-2.0-or-later"),
    (["MIT-GRANT", "MIT-NOTICE", "MIT-ASIS"], "MIT"),
    (["MIT-GRANT", "MIT-NOTICE"], "MIT"),
    (["GPL-TITLE", "GPL3-DATE"], "GPL-3.0-only"),
    (["GPL-TITLE", "GPL2-DATE"], "GPL-2.0-only"),
    (["LGPL-TITLE", "GPL3-DATE"], "LGPL-3.0-only"),
    (["LGPL-TITLE", "LGPL21-DATE"], "LGPL-2.1-only"),
    (["AGPL-TITLE", "AGPL3-DATE"], "AGPL-3.0-only"),
    (["GPL3-LATER"], "GPL-3.0-or-later"),
    (["GPL2-LATER"], "GPL-2.0-or-later"),
    (["LGPL21-LATER"], "LGPL-2.1-or-later"),
    (["LGPL3-LATER"], "LGPL-3.0-or-later"),
    (["AGPL3-LATER"], "AGPL-3.0-or-later"),
    (["APACHE2-TITLE"], "Apache-2.0"),
    (["ISC-GRANT"], "ISC"),
    (["UNLICENSE"], "Unlicense"),
    (["EPL2-REF"], "EPL-2.0"),
    (["GPL3-REF"], "GPL-3.0-only"),
    (["GPL2-REF"], "GPL-2.0-only"),
    (["APACHE2-REF"], "Apache-2.0"),
    (["MIT-REF"], "MIT"),
    (["BSD3-REF"], "BSD-3-Clause"),
    (["BSD2-REF"], "BSD-2-Clause"),
    (["MPL2-REF"], "MPL-2.0"),
    (["CC-BY-REF"], "CC-BY-4.0"),
    (["CC-BY-SA-REF"], "CC-BY-SA-4.0"),
    (["CC-BY-NC-REF"], "CC-BY-NC-4.0"),
    (["CC0-REF"], "CC0-1.0"),
    (["RIGHTS"], "All-rights-reserved"),
]

_SPACE = r"[ \t\n\r\f\x0B]"
#: A line that ends inside a sentence goes on in the next one.
_WRAP = rf"([a-z0-9,]){_SPACE}*\n{_SPACE}*([a-z])"
_CUT = rf"[.!?]+{_SPACE}+|{_SPACE}*\n{_SPACE}*"
#: What stands between words of one sentence: anything but letters, digits and the end of a sentence.
_BETWEEN = rf"(?![A-Za-z0-9])[^A-Za-z0-9.!?]*+(?:[.!?]++(?!{_SPACE})[^A-Za-z0-9.!?]*+)*+"
#: Sentences of full notices, whose end may vary.
_OPEN = ("APACHE2-COMPLY", "APACHE2-ASIS", "APACHE2-SEE", "MIT-GRANT", "MIT-NOTICE", "MIT-ASIS", "GPL3-LATER", "GPL2-LATER", "LGPL21-LATER", "LGPL3-LATER", "AGPL3-LATER", "ISC-GRANT", "GPL-HOPE", "GPL-SEE", "BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE")
#: Titles and dates that stand on a line of their own.
_LINES = ("APACHE2-TITLE", "GPL-TITLE", "LGPL-TITLE", "AGPL-TITLE", "GPL2-DATE", "LGPL21-DATE", "GPL3-DATE", "AGPL3-DATE")
#: Every known sentence has one of these; texts without are not searched.
_STEMS = ("licens", "permission", "redistribution", "warrant", "released", "rights")
_KEYWORDS = ("licens", "licenc", "copyright", "rights reserved")


def _known() -> dict[str, str]:
    return {sentence: name for name, sentences in SENTENCES.items() for sentence in sentences}


def sentences(text: Column) -> Column:
    """Normalised sentences of a text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), _WRAP, "$1 $2")
    parts = F.split(F.translate(joined, upper, upper.lower()), _CUT)
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def rejoined(text: Column) -> Column:
    """The text with its known sentences on one line each, whatever line breaks and comment signs stood between their words."""
    out = text
    for sentence in sorted((x for x, name in _known().items() if name not in _LINES), key=lambda x: (-len(x), x)):
        words = sentence.split(" ")
        # the outer words stay as they are, so that nothing around the sentence is joined or cut anew
        end = "" if _known()[sentence] in _OPEN else r"(?![^A-Za-z0-9\n.!?]*[A-Za-z0-9])"
        pattern = rf"(?i)\b({words[0]}){_BETWEEN}{_BETWEEN.join(words[1:-1])}{_BETWEEN}({words[-1]})\b{end}"
        out = F.regexp_replace(out, pattern, f"$1 {' '.join(words[1:-1])} $2")
    return out


def _identifier(sentence: Column, known: Column) -> Column:
    begins = [(s, name) for s, name in _known().items() if name in _OPEN]
    open_ = F.coalesce(*[F.when(F.startswith(sentence, F.lit(s + " ")), F.lit(name)) for s, name in begins])
    return F.coalesce(F.try_element_at(known, sentence), open_)


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences, verdict of every document."""
    known = F.create_map(*[F.lit(x) for pair in _known().items() for x in pair])
    rows = docs.select(F.col(id_col).alias("doc_id"), "text", sentences(F.col("text")).alias("s"))
    rows = rows.withColumn("j", F.when(F.col("text").rlike(rf"(?i){'|'.join(_STEMS)}"), sentences(rejoined(F.col("text")))).otherwise(F.col("s")))
    found = F.filter(F.transform("j", lambda x: _identifier(x, known)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join(found, ">").alias("sentence_ids"), F.exists("s", lambda x: x.rlike("|".join(_KEYWORDS))).alias("hint"))
    # what a rule has read becomes its own mark, which no later rule knows
    left, hits = F.concat(F.lit(">"), F.replace(F.col("sentence_ids"), F.lit(">"), F.lit(">>")), F.lit(">")), []
    for k, (names, licence) in enumerate(RULES):
        rows = rows.withColumn(f"q{k}", left)
        mark = "".join(f">{n}>" for n in names)
        hits.append(F.when(F.contains(F.col(f"q{k}"), F.lit(mark)), F.lit(licence)))
        left = F.replace(F.col(f"q{k}"), F.lit(mark), F.lit("|"))
    licences = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",")
    rows = rows.withColumn("licences", licences)
    verdict = F.when(F.col("licences") != "", "recognised").when(F.col("hint"), "unknown").otherwise("none")
    return rows.select("doc_id", "n_sentences", "sentence_ids", "licences", verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in _known().items())
    steps, last = [], "q0"
    hits = []
    for k, (names, licence) in enumerate(RULES):
        mark = quote("".join(f">{n}>" for n in names))
        hits.append(f"CASE WHEN contains(q{k}, {mark}) THEN {quote(licence)} END")
        steps.append(f"r{k + 1} AS (SELECT *, replace(q{k}, {mark}, '|') AS q{k + 1} FROM r{k})")
        last = f"r{k + 1}"
    space = r"[ \t\n\r\f\v]"
    wrap, cut = rf"([a-z0-9,]){space}*\n{space}*([a-z])", rf"[.!?]+{space}+|{space}*\n{space}*"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH a AS (SELECT doc_id, regexp_split_to_array(translate(regexp_replace(coalesce(text, ''), '{wrap}', '\1 \2', 'g'), '{upper}', '{upper.lower()}'), '{cut}') AS p FROM documents),
b AS (SELECT doc_id, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s FROM a),
c AS (SELECT doc_id, len(s)::BIGINT AS n_sentences, list_filter(list_transform(s, lambda x: (MAP {{{pairs}}})[x]), lambda x: x IS NOT NULL) AS ids,
             len(list_filter(s, lambda x: regexp_matches(x, '{"|".join(_KEYWORDS)}'))) > 0 AS hint FROM b),
r0 AS (SELECT doc_id, n_sentences, coalesce(array_to_string(ids, '>'), '') AS sentence_ids, hint, '>' || coalesce(array_to_string(ids, '>>'), '') || '>' AS q0 FROM c),
{", ".join(steps)},
z AS (SELECT *, coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL))), ','), '') AS licences FROM {last})
SELECT doc_id, n_sentences, sentence_ids, licences, CASE WHEN licences <> '' THEN 'recognised' WHEN hint THEN 'unknown' ELSE 'none' END AS verdict FROM z"""


ORACLE = _oracle()
