"""Licence scans by sentence rules.

A text is normalised and its ends of sentences and lines are marked; known licence sentences are found between any two of
them. The identifiers found, in text order, are matched against ordered rules; what a rule matches is consumed, so later and looser rules don't see it.
Everything is computed inside the row by DataFrame functions: no shuffle and no join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, as normalised() leaves them, and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT-ref",
    "licensed under the mit license": "MIT-ref",
    "this work is licensed under the mit license": "MIT-ref",
    "this project is licensed under the mit license": "MIT-ref",
    "this software is released under the mit license": "MIT-ref",
    "spdx license identifier mit": "MIT-ref",
    "the mit license": "MIT-title",
    "the mit license mit": "MIT-title",
    "mit license": "MIT-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions": "MIT-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the software": "MIT-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in"
    " an action of contract tort or otherwise arising from out of or in connection with the software or the use or"
    " other dealings in the software": "MIT-liability",
    "licensed under the apache license version 2.0": "Apache-2-ref",
    "licensed under the apache license version 2.0 the license": "Apache-2-ref",
    "this work is licensed under the apache license version 2.0": "Apache-2-ref",
    "released under the apache license version 2.0": "Apache-2-ref",
    "spdx license identifier apache 2.0": "Apache-2-ref",
    "you may not use this file except in compliance with the license": "Apache-comply",
    "you may obtain a copy of the license at": "Apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on"
    " an as is basis without warranties or conditions of any kind either express or implied": "Apache-asis",
    "see the license for the specific language governing permissions and limitations under the license": "Apache-see",
    "licensed under the gnu general public license version 3": "GPL-3-ref",
    "this work is licensed under the gnu general public license version 3": "GPL-3-ref",
    "released under the gnu general public license version 3": "GPL-3-ref",
    "spdx license identifier gpl 3.0 only": "GPL-3-ref",
    "spdx license identifier gpl 3.0 or later": "GPL-3+-ref",
    "licensed under the gnu general public license version 2": "GPL-2-ref",
    "this work is licensed under the gnu general public license version 2": "GPL-2-ref",
    "spdx license identifier gpl 2.0 only": "GPL-2-ref",
    "spdx license identifier gpl 2.0 or later": "GPL-2+-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 3 of the license or at your option any later"
    " version": "GPL-3+-free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 2 of the license or at your option any later"
    " version": "GPL-2+-free",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose": "GPL-hope",
    "see the gnu general public license for more details": "GPL-see",
    "you should have received a copy of the gnu general public license along with this program": "GPL-received",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "BSD-permit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "BSD-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution": "BSD-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission": "BSD-endorse",
    "spdx license identifier bsd 2 clause": "BSD-2-ref",
    "spdx license identifier bsd 3 clause": "BSD-3-ref",
    "licensed under cc by nc 4.0": "CC-BY-NC-4-ref",
    "this work is licensed under cc by nc 4.0": "CC-BY-NC-4-ref",
    "licensed under cc by sa 4.0": "CC-BY-SA-4-ref",
    "this work is licensed under cc by sa 4.0": "CC-BY-SA-4-ref",
    "licensed under cc by 4.0": "CC-BY-4-ref",
    "this work is licensed under cc by 4.0": "CC-BY-4-ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "CC-BY-4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CC-BY-NC-4-ref",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "CC-BY-SA-4-ref",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "MPL-2-subject",
    "spdx license identifier mpl 2.0": "MPL-2-subject",
    "all rights reserved": "Reserved",
}

# Licences and the identifier sequences that name them, the stricter before the looser.
RULES = [
    ("MIT", ["MIT-title", "MIT-grant", "MIT-notice", "MIT-warranty", "MIT-liability"]),
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-warranty", "MIT-liability"]),
    ("Apache-2.0", ["Apache-2-ref", "Apache-comply", "Apache-copy", "Apache-asis", "Apache-see"]),
    ("Apache-2.0", ["Apache-2-ref", "Apache-comply"]),
    ("GPL-3.0-or-later", ["GPL-3+-free", "GPL-hope", "GPL-see", "GPL-received"]),
    ("GPL-3.0-or-later", ["GPL-3+-free", "GPL-hope"]),
    ("GPL-2.0-or-later", ["GPL-2+-free", "GPL-hope", "GPL-see", "GPL-received"]),
    ("GPL-2.0-or-later", ["GPL-2+-free", "GPL-hope"]),
    ("BSD-3-Clause", ["BSD-permit", "BSD-source", "BSD-binary", "BSD-endorse"]),
    ("BSD-2-Clause", ["BSD-permit", "BSD-source", "BSD-binary"]),
    ("MIT", ["MIT-grant"]),
    ("MIT", ["MIT-ref"]),
    ("MIT", ["MIT-title"]),
    ("Apache-2.0", ["Apache-2-ref"]),
    ("GPL-3.0-or-later", ["GPL-3+-free"]),
    ("GPL-3.0-or-later", ["GPL-3+-ref"]),
    ("GPL-3.0-only", ["GPL-3-ref"]),
    ("GPL-2.0-or-later", ["GPL-2+-free"]),
    ("GPL-2.0-or-later", ["GPL-2+-ref"]),
    ("GPL-2.0-only", ["GPL-2-ref"]),
    ("BSD-2-Clause", ["BSD-2-ref"]),
    ("BSD-3-Clause", ["BSD-3-ref"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-4-ref"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-4-ref"]),
    ("CC-BY-4.0", ["CC-BY-4-ref"]),
    ("MPL-2.0", ["MPL-2-subject"]),
    ("Proprietary", ["Reserved"]),
]

#: Where a sentence may begin or end; one sentence may hold several of these.
SENTENCE_END = r"[.!?:;]+(?=\s|$)"
#: Every known sentence has one of these, so other texts need no look-up.
CUE = r"(?i)licen|licence|redistribut|copyright|permission|warrant|rights\W+reserved|liable"
#: Known sentences from one end to another, the longest first, whatever ends stand inside.
KNOWN = r"(?<![^\n])(?:%s)(?![^\n])" % "|".join(
    re.escape(s).replace(r"\ ", r"[ \n]") for s in sorted(SENTENCES, key=len, reverse=True)
)


def normalised(text: Column) -> Column:
    """Lower case; letters, digits and dots between digits stay, all else is one space, or one line end if it holds one."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.\n]+|\.(?!\p{N})|(?<!\p{N})\.", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r" *\n[ \n]*", "\n"), " +", " "))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text in text order.

    A known sentence begins and ends at a sentence end or line end. Ends inside it ("free software: you", "v. 2.0", wrapped
    lines) don't count, so it is found whole however the text is punctuated; where several begin, the longest is taken.
    """
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    found = F.regexp_extract_all(normalised(F.regexp_replace(text, SENTENCE_END, "\n")), F.lit(KNOWN), F.lit(0))
    return F.when(text.rlike(CUE), F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))).otherwise(
        F.array().cast("array<string>")
    )


def matched_rules(ids: Column) -> Column:
    """Licences of a sequence of identifiers: each rule in order takes its sequence wherever it still stands."""
    rules = F.array(
        *(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in sequence)).alias("sequence")) for name, sequence in RULES)
    )
    marked = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    start = F.named_struct(F.lit("left"), marked, F.lit("found"), F.array().cast("array<string>"))
    end = F.aggregate(
        rules,
        start,
        lambda state, rule: F.when(
            F.contains(state["left"], rule["sequence"]),
            F.named_struct(
                F.lit("left"),
                F.replace(state["left"], rule["sequence"], F.lit("|")),
                F.lit("found"),
                F.concat(state["found"], F.array(rule["name"])),
            ),
        ).otherwise(state),
    )
    return F.array_distinct(end["found"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, licenses) per row: identifiers in text order, and licences in the order of the rules.

    A null or empty text, or one without a known sentence, has two empty arrays. Repeated rows are scanned alike; only
    doc_id and text are read; an empty table gives no rows.
    """
    found = docs.select("doc_id", sentence_ids(F.coalesce(F.col("text"), F.lit(""))).alias("sentences"))
    licences = F.when(F.size("sentences") > 0, matched_rules(F.col("sentences"))).otherwise(F.array().cast("array<string>"))
    return found.select("doc_id", "sentences", licences.alias("licenses"))

