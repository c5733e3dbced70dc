"""Licence scans by sentence rules, in DataFrame functions within each row.

A text is cut into sentences, each is normalised (letters and digits in lower case, single blanks, holders of
copyrights left out) and looked up among known licence sentences. The identifiers found, in their order, are matched
against ordered rules, longer ones first; what a rule has matched is taken out before the next. This is done twice,
with each line break as an end and with single line breaks as blanks, for notices that run over lines. Nothing
is shuffled.

Defined cases: a null or empty text has no sentences and gives no row, like any text without a known sentence; known
sentences that no rule takes give the licence ``unknown``; repeated rows and repeated notices count each row, each
licence once; empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.common import let

# The known sentences, by identifier.
SENTENCES = {
    "apache2-line": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License 2.0",
                     'Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache2-use": ["you may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "apache2-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License '
                      'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
                      'or implied'],
    "mit-line": ["Released under the MIT License", "Licensed under the MIT License", "MIT License",
                 "The MIT License (MIT)"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
                  'associated documentation files (the "Software"), to deal in the Software without restriction, '
                  'including without limitation the rights to use, copy, modify, merge, publish, distribute, '
                  'sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is '
                  'furnished to do so, subject to the following conditions'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial "
                   "portions of the Software"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                  "that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                   "following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                   "the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                  "hereby granted, provided that the above copyright notice and this permission notice appear in all "
                  "copies"],
    "gpl2-line": ["This work is licensed under the GNU General Public License, version 2"],
    "gpl3-line": ["This work is licensed under the GNU General Public License, version 3"],
    "gpl-free": ["This program is free software"],
    "gpl2-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                   "by the Free Software Foundation, either version 2 of the License, or (at your option) any later "
                   "version"],
    "gpl3-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                   "by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                   "version"],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain"],
    "all-rights": ["All rights reserved"],
    "copyright": ["Copyright"],
}
# The rules in order, each a sequence of identifiers; a longer rule stands before its parts.
RULES = [
    ("Apache-2.0", "apache2-line apache2-use apache2-copy apache2-basis"),
    ("Apache-2.0", "apache2-line apache2-use apache2-copy"),
    ("MIT", "mit-line copyright mit-grant mit-notice"),
    ("MIT", "mit-grant mit-notice"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("GPL-2.0-or-later", "gpl-free gpl2-terms"),
    ("GPL-3.0-or-later", "gpl-free gpl3-terms"),
    ("Apache-2.0", "apache2-line"),
    ("MIT", "mit-line"),
    ("ISC", "isc-grant"),
    ("GPL-2.0-only", "gpl2-line"),
    ("GPL-3.0-only", "gpl3-line"),
    ("MPL-2.0", "mpl2-form"),
    ("CC-BY-4.0", "cc-by"),
    ("CC-BY-SA-4.0", "cc-by-sa"),
    ("CC-BY-NC-4.0", "cc-by-nc"),
    ("Unlicense", "public-domain"),
    ("All-rights-reserved", "copyright all-rights"),
    ("All-rights-reserved", "all-rights"),
]
ENDS = r"[.!?:;]+[ \t\r]+|\n"
HOLDER = r"^(c )?copyright .*$"


def normalised(sentence: str) -> str:
    """The look-up form of a sentence, as ``normalise`` makes it."""
    low = re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()
    return re.sub(HOLDER, "copyright", low)


def known() -> dict[str, str]:
    """Identifiers by normalised sentence."""
    return {normalised(s): k for k, forms in SENTENCES.items() for s in forms}


def normalise(sentence: Column) -> Column:
    """The look-up form of a sentence."""
    low = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(low, HOLDER, "copyright")


def sequence(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order, each in angle brackets."""
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    # Forms longer than every known one need no look-up; sentences are measured after they are normalised.
    longest = max(map(len, known()))
    forms = F.filter(F.transform(F.split(text, ENDS), normalise), lambda s: F.length(s) <= longest)
    found = F.transform(forms, lambda s: F.element_at(table, s))
    return F.array_join(F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")


def match(ids: Column) -> Column:
    """The licences that the rules find in a sequence of identifiers, and what they leave."""
    rules = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in seq.split())).alias("ids"))
        for name, seq in RULES
    ])
    start = F.struct(ids.alias("left"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.when(
            hit,
            F.struct(
                F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"),
                F.array_append(state["names"], rule["name"]).alias("names"),
            ),
        ).otherwise(state)

    return F.aggregate(rules, start, step)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sentences, licences)`` of each text with a known sentence: identifiers in order, names in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    flowing = F.regexp_replace(text, r"([^\n])\n([^\n])", "$1 $2")
    found = docs.select(
        F.col(id_col).alias("doc_id"), sequence(text).alias("lines"), sequence(flowing).alias("flow")
    )

    def named(ids: Column) -> Column:
        def names(state: Column) -> Column:
            rest = F.when(F.contains(state["left"], F.lit("<")), F.array(F.lit("unknown")))
            return F.when(F.size(state["names"]) > 0, state["names"]).otherwise(F.coalesce(rest, F.array().cast("array<string>")))

        return let(match(ids), names)

    both = found.select(
        "doc_id",
        F.when(F.length("flow") > F.length("lines"), F.col("flow")).otherwise(F.col("lines")).alias("sentences"),
        F.array_sort(F.array_distinct(F.concat(named(F.col("lines")), named(F.col("flow"))))).alias("names"),
    )
    sure = F.filter("names", lambda n: n != "unknown")
    return both.select(
        F.explode(F.when(F.size("names") > 0, F.array(F.struct(
            "doc_id", "sentences",
            F.array_join(F.when(F.size(sure) > 0, sure).otherwise(F.col("names")), ",").alias("licences"),
        )))).alias("row")
    ).select("row.*")
