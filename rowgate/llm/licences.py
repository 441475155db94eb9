"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, at line ends and after full stops, and once more paragraph by paragraph without the line ends, for wrapped text.
Normalised sentences (lower-case letters and digits with single blanks, and `under` for what may stand before a licence's name) are looked up among
known licence sentences, tags among them. The identifiers found, in order, are matched
with ordered rules, the longest sequences first; what a rule has matched is not matched again.

Defined results: null and empty texts, and texts without a known sentence, have an empty list; texts are taken whole; a licence that is named twice is
listed once; known sentences that complete no rule are reported but give no licence; repeated rows get a row each; null ids are kept; an empty table gives no
rows. Other columns of the input are not looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import quoted

#: Known licence sentences, normalised, and their identifiers. Fixed values. `licensed under the` and the like are written `under`.
SENTENCES = {
    "under apache license version 2 0": "apache2",
    "under apache license version 2 0 the license": "apache2",
    "you may not use this file except in compliance with the license": "apache_use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache_copy",
    "under mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "under gnu general public license version 3": "gpl3",
    "under gnu general public license version 2": "gpl2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_later_own",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_later_own",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl_terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_later_own",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_later_own",
    "either version 2 of the license or at your option any later version": "later2",
    "either version 2 1 of the license or at your option any later version": "later21",
    "either version 3 of the license or at your option any later version": "later3",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "see the gnu general public license for more details": "gpl_details",
    "under gnu lesser general public license version 3": "lgpl3",
    "under gnu affero general public license version 3": "agpl3",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "under cc by 4 0": "ccby4",
    "under cc by sa 4 0": "ccbysa4",
    "under cc by nc 4 0": "ccbync4",
    "under cc by nc sa 4 0": "ccbyncsa4",
    "under cc by nd 4 0": "ccbynd4",
    "under a creative commons attribution 4 0 international license": "ccby4",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "spdx license identifier apache 2 0": "spdx_apache2",
    "spdx license identifier mit": "spdx_mit",
    "spdx license identifier gpl 2 0": "spdx_gpl2",
    "spdx license identifier gpl 2 0 only": "spdx_gpl2",
    "spdx license identifier gpl 2 0 or later": "spdx_gpl2_later",
    "spdx license identifier gpl 3 0": "spdx_gpl3",
    "spdx license identifier gpl 3 0 only": "spdx_gpl3",
    "spdx license identifier gpl 3 0 or later": "spdx_gpl3_later",
    "spdx license identifier lgpl 2 1 only": "spdx_lgpl21",
    "spdx license identifier lgpl 2 1 or later": "spdx_lgpl21_later",
    "spdx license identifier lgpl 3 0 only": "spdx_lgpl3",
    "spdx license identifier lgpl 3 0 or later": "spdx_lgpl3_later",
    "spdx license identifier agpl 3 0 only": "spdx_agpl3",
    "spdx license identifier agpl 3 0 or later": "spdx_agpl3_later",
    "spdx license identifier mpl 2 0": "spdx_mpl2",
    "spdx license identifier bsd 2 clause": "spdx_bsd2",
    "spdx license identifier bsd 3 clause": "spdx_bsd3",
    "spdx license identifier isc": "spdx_isc",
    "spdx license identifier unlicense": "spdx_unlicense",
    "spdx license identifier cc by 4 0": "spdx_ccby4",
    "spdx license identifier cc by sa 4 0": "spdx_ccbysa4",
}
#: Ordered rules: licence and its sequence of identifiers. Fixed values.
RULES = [
    ("Apache-2.0", "apache2 apache_use apache_copy"), ("Apache-2.0", "apache2 apache_use"),
    ("GPL-3.0-or-later", "gpl3_later gpl_warranty gpl_details"), ("GPL-2.0-or-later", "gpl2_later gpl_warranty gpl_details"),
    ("BSD-3-Clause", "bsd bsd_source bsd_binary bsd_names"), ("BSD-2-Clause", "bsd bsd_source bsd_binary"),
    ("MIT", "mit_grant mit_notice mit_warranty"), ("MIT", "mit_notice mit_warranty"), ("MIT", "mit_grant mit_notice"),
    ("GPL-2.0-or-later", "gpl_terms later2"), ("GPL-3.0-or-later", "gpl_terms later3"), ("LGPL-2.1-or-later", "lgpl_terms later21"), ("LGPL-3.0-or-later", "lgpl_terms later3"),
    ("GPL-3.0-or-later", "gpl3_later"), ("GPL-2.0-or-later", "gpl2_later"), ("GPL-2.0-or-later", "gpl2_later_own"), ("GPL-3.0-or-later", "gpl3_later_own"),
    ("LGPL-3.0-or-later", "lgpl3_later_own"), ("AGPL-3.0-or-later", "agpl3_later_own"), ("Apache-2.0", "apache2"), ("MIT", "mit"), ("GPL-3.0-only", "gpl3"),
    ("GPL-2.0-only", "gpl2"), ("LGPL-3.0-only", "lgpl3"), ("AGPL-3.0-only", "agpl3"), ("MPL-2.0", "mpl2"), ("CC-BY-4.0", "ccby4"),
    ("CC-BY-SA-4.0", "ccbysa4"), ("CC-BY-NC-4.0", "ccbync4"), ("CC-BY-NC-SA-4.0", "ccbyncsa4"), ("CC-BY-ND-4.0", "ccbynd4"), ("Unlicense", "unlicense"), ("ISC", "isc"),
    ("Apache-2.0", "spdx_apache2"), ("MIT", "spdx_mit"), ("GPL-2.0-only", "spdx_gpl2"), ("GPL-2.0-or-later", "spdx_gpl2_later"), ("GPL-3.0-only", "spdx_gpl3"),
    ("GPL-3.0-or-later", "spdx_gpl3_later"), ("LGPL-2.1-only", "spdx_lgpl21"), ("LGPL-2.1-or-later", "spdx_lgpl21_later"), ("LGPL-3.0-only", "spdx_lgpl3"),
    ("LGPL-3.0-or-later", "spdx_lgpl3_later"), ("AGPL-3.0-only", "spdx_agpl3"), ("AGPL-3.0-or-later", "spdx_agpl3_later"), ("MPL-2.0", "spdx_mpl2"),
    ("BSD-2-Clause", "spdx_bsd2"), ("BSD-3-Clause", "spdx_bsd3"), ("ISC", "spdx_isc"), ("Unlicense", "spdx_unlicense"), ("CC-BY-4.0", "spdx_ccby4"), ("CC-BY-SA-4.0", "spdx_ccbysa4"),
]
#: Every known sentence has one of these, so a text or sentence without them needs no look.
CUES = "licen|warrant|redistribut|permission|public domain|notice|either version|(?:released|distributed|published|available) under"
#: What may stand before the name of a licence: `this software is released under the terms of the`. Fixed values.
LEAD = (
    "^(?:(?:this|the) (?:file|software|project|library|program|code|source code|work|package|repository) is )?"
    "(?:licensed|released|distributed|published|available|made available) under (?:the terms of )?(?:the )?"
)


def _identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order. The colon of a tag ends no sentence."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    tagged = F.regexp_replace(text, "(?i)spdx-license-identifier:[ \\t]*", "spdx license identifier ")
    lines = F.split(F.regexp_replace(tagged, "([.;:!?])[ \\t\\r]+", "$1\n"), "\n")
    near = F.filter(F.transform(lines, F.lower), lambda s: s.rlike(CUES))
    plain = F.transform(near, lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), LEAD, "under "))
    return F.filter(F.transform(plain, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())


def _matched(ids: Column) -> Column:
    """Licences of a sequence of identifiers, in the order of the rules. Every identifier stands between blanks of its own."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.concat(F.lit("  "), F.lit(seq.replace(" ", "  ")), F.lit("  ")).alias("seq")) for name, seq in RULES])
    start = F.struct(F.concat(F.lit("  "), F.array_join(ids, "  "), F.lit("  ")).alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        there = F.contains(state["rest"], rule["seq"])
        return F.struct(
            F.when(there, F.replace(state["rest"], rule["seq"], F.lit("  |  "))).otherwise(state["rest"]).alias("rest"),
            F.when(there, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    return F.when(F.size(ids) > 0, F.aggregate(rules, start, step, lambda s: s["found"])).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, licences (array, without repeats) and sentences (identifiers found line by line)."""
    cue = F.lower(quoted(text_col)).rlike(CUES)
    nothing = F.array().cast("array<string>")
    rows = docs.select(quoted(id_col).alias("doc_id"), F.when(cue, quoted(text_col)).alias("t"))
    # Blank lines end a paragraph, and so a sentence.
    whole = F.regexp_replace(F.regexp_replace("t", "\\r?\\n[ \\t#*/]*\\r?\\n[ \\t#*/\\r\\n]*", ". "), "[\\r\\n]+[ \\t#*/]*", " ")
    found = [F.when(F.col("t").isNotNull(), _identifiers(x)).otherwise(nothing).alias(n) for n, x in (("a", F.col("t")), ("b", whole))]
    named = F.array_distinct(F.concat(_matched(F.col("a")), _matched(F.col("b"))))
    return rows.select("doc_id", *found).select("doc_id", named.alias("licences"), F.col("a").alias("sentences"))
