"""License scans: sentences are mapped to identifiers of known license sentences, whose order is matched with rules.

All on DataFrame functions, one pass, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licenses and notices, by identifier.
SENTENCES = {
    "mit.name": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit.notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit.grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit.keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit.asis": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "apache.name": ["Apache License"],
    "apache.notice": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")', "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache.use": ["you may not use this file except in compliance with the License"],
    "apache.copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache.asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "gpl3.notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GPLv3", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl3.later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2.notice": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl2.later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "either version 2 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl.free": ["This program is free software", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl3.version": ["either version 3 of the License, or (at your option) any later version", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl.hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "lgpl.notice": ["Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"],
    "lgpl3.notice": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl3.notice": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl2.notice": ["Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "bsd.may": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd.endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd3.notice": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License"],
    "bsd2.notice": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License"],
    "isc.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "cc0.notice": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "SPDX-License-Identifier: CC0-1.0"],
    "ccby.notice": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "ccbysa.notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "ccbync.notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "ccbynd.notice": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "unlicense.free": ["This is free and unencumbered software released into the public domain"],
    "public.notice": ["This work is in the public domain", "Released into the public domain"],
    "reserved": ["All rights reserved"],
}
# Licenses by the order of sentences that states them; a rule further up covers the licenses it names last.
RULES = [
    ("MIT", ["mit.grant", "mit.keep"], []),
    ("MIT", ["mit.notice"], []),
    ("MIT", ["mit.name", "mit.asis"], []),
    ("Apache-2.0", ["apache.notice"], []),
    ("Apache-2.0", ["apache.use", "apache.asis"], []),
    ("Apache-2.0", ["apache.name", "apache.copy"], []),
    ("Apache-2.0", ["apache.use", "apache.copy"], []),
    ("GPL-3.0-or-later", ["gpl3.later"], []),
    ("GPL-3.0-or-later", ["gpl.free", "gpl3.version"], []),
    ("GPL-3.0", ["gpl3.notice"], []),
    ("GPL-2.0-or-later", ["gpl.free", "gpl2.later"], []),
    ("GPL-2.0", ["gpl2.notice"], []),
    ("LGPL-2.1", ["lgpl.notice"], []),
    ("LGPL-3.0", ["lgpl3.notice"], []),
    ("AGPL-3.0", ["agpl3.notice"], []),
    ("MPL-2.0", ["mpl2.notice"], []),
    ("BSD-3-Clause", ["bsd.may", "bsd.source", "bsd.binary", "bsd.endorse"], ["BSD-2-Clause"]),
    ("BSD-3-Clause", ["bsd3.notice"], []),
    ("BSD-2-Clause", ["bsd.may", "bsd.source", "bsd.binary"], []),
    ("BSD-2-Clause", ["bsd2.notice"], []),
    ("ISC", ["isc.grant"], []),
    ("CC0-1.0", ["cc0.notice"], []),
    ("CC-BY-4.0", ["ccby.notice"], []),
    ("CC-BY-SA-4.0", ["ccbysa.notice"], []),
    ("CC-BY-NC-4.0", ["ccbync.notice"], []),
    ("CC-BY-ND-4.0", ["ccbynd.notice"], []),
    ("Unlicense", ["unlicense.free"], []),
    ("Public-Domain", ["public.notice"], []),
    ("All-Rights-Reserved", ["reserved"], []),
]
#: Words of which every known sentence has one; texts without any of them have no known sentence.
STEMS = "licen[sc]e|mit license|redistribut|copyright|warrant|rights reserved|public domain|free software|permission|gplv|version"
ENDS, LINES = r"[.;!?]+[ \t\r\n]+|:[ \t\r]*\n", r"|\n"
#: A line without letters or digits, as between the paragraphs of a comment.
BLANK = r"|\n[^A-Za-z0-9\n]*\n"


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def known() -> dict[str, str]:
    return {plain(s): k for k, every in SENTENCES.items() for s in every}


def sentence_ids(text: Column, lines: bool) -> Column:
    """Identifiers of the known sentences of a text, in its order; with lines, a line's end ends a sentence too."""
    table = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    parts = F.split(F.concat(text, F.lit(" ")), ENDS + (LINES if lines else BLANK))
    spelled = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    return F.filter(F.transform(parts, lambda s: F.try_element_at(table, spelled(s))), lambda x: x.isNotNull())


def pattern(steps: list[str]) -> str:
    return "," + "(.*,)?".join(re.escape(s) + "," for s in steps)


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentences, wrapped, licences): known license sentences of each text and the licenses they state.

    `sentences` takes the end of a line as the end of a sentence, `wrapped` only stops
    and lines without letters or digits; a rule holds if its sentences stand in its order in either.
    `licences` follows the order of RULES, each name once. Null, empty and unmatched
    texts have empty arrays; rows are handled alone, so repeated rows each give a row;
    other columns are left out; no rows give no rows.
    """
    none = F.array().cast("array<string>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hit = F.lower(text).rlike(STEMS)
    out = df.select(F.col(id_col).alias("doc_id"), F.when(hit, text).alias("text"))
    out = out.select("doc_id", *(F.when(F.col("text").isNull(), none).otherwise(sentence_ids(F.col("text"), by)).alias(c) for c, by in (("sentences", True), ("wrapped", False))))
    in_order = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    states = lambda steps: in_order("sentences").rlike(pattern(steps)) | in_order("wrapped").rlike(pattern(steps))
    covered = lambda name: F.lit(False) if not (by := [s for _, s, names in RULES if name in names]) else states(by[0])
    found = F.array_distinct(F.array_compact(F.array(*(F.when(states(steps) & ~covered(name), F.lit(name)) for name, steps, _ in RULES))))
    return out.select("doc_id", "sentences", "wrapped", F.when(F.size("sentences") + F.size("wrapped") == 0, none).otherwise(found).alias("licences"))


def op2_license_scan(spark, sf_dir) -> DataFrame:
    """The license sentences and licenses of every document."""
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.size("licences").cast("long").alias("n_licences"), F.array_join("licences", ",").alias("licences"))


def oracle() -> str:
    """The same by DuckDB."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    keys = ", ".join(text(k) for k in known())
    values = ", ".join(text(v) for v in known().values())
    ids = lambda ends: f"list_filter(list_transform(string_split_regex(coalesce(text, '') || ' ', {text(ends)}), lambda s: map_extract(MAP([{keys}], [{values}]), trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))[1]), lambda x: x IS NOT NULL)"
    states = lambda steps: f"(regexp_matches(a, {text(pattern(steps))}) OR regexp_matches(b, {text(pattern(steps))}))"
    rules = []
    for name, steps, _ in RULES:
        by = [s for _, s, names in RULES if name in names]
        rules.append(f"CASE WHEN {states(steps)}{f' AND NOT {states(by[0])}' if by else ''} THEN {text(name)} END")
    first = {}
    for i, (name, _, _) in enumerate(RULES):
        first.setdefault(name, []).append(rules[i])
    names = ", ".join(f"coalesce({', '.join(x)})" for x in first.values())
    return f"""WITH s AS (SELECT doc_id, {ids(ENDS + LINES)} AS x, {ids(ENDS + BLANK)} AS y FROM documents),
t AS (SELECT doc_id, x, ',' || coalesce(array_to_string(x, ','), '') || ',' AS a, ',' || coalesce(array_to_string(y, ','), '') || ',' AS b FROM s),
u AS (SELECT doc_id, x, list_filter([{names}], lambda n: n IS NOT NULL) AS l FROM t)
SELECT doc_id, len(x)::BIGINT AS n_sentences, coalesce(array_to_string(x, ','), '') AS sentences, len(l)::BIGINT AS n_licences, coalesce(array_to_string(l, ','), '') AS licences FROM u"""
