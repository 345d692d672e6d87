"""License scans by sentence rules: known licence sentences become identifiers, their order makes a licence.

A text is cut into fragments at line ends and sentence marks, and each is normalised (case, punctuation,
comment marks, white space). A known sentence may run over any number of lines: the fragments are joined with
their starts marked, and at each start the longest known sentence that ends with a fragment is taken. The
identifiers found, in order, are held against licence rules, ordered lists of identifiers that have to follow
each other. Column expressions only; texts without any word that every known sentence needs one of are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of the public licence texts, by identifier.
SENTENCES = {
    "mit-reference": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "mit-as-is": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "apache-reference": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is '
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "gpl3-reference": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-or-later",
}
#: Ordered rules: a licence is found where the identifiers follow each other among those of the text.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-reference"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-reference"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["spdx-gpl3"]),
    ("GPL-3.0", ["gpl3-reference"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
]
#: A rule that another one contains does not count where the longer one is found.
_CONTAINED = {"BSD-2-Clause": "BSD-3-Clause"}
#: Every known sentence has one of these.
GATE = "(?i)licen[sc]|permi|redistribut|warrant|copyright"
_GNU = "can redistribute it and/or modify it under the terms of the GNU"
_FSF = "as published by the Free Software Foundation"
_LATER = "of the License, or (at your option) any later version."
#: Further licences. The SQL twin stays as it was and knows those above only.
MORE_SENTENCES = {
    "gpl2-redistribute": f"This program is free software; you {_GNU} General Public License {_FSF}; either version 2 {_LATER}",
    "gpl2-only": f"This program is free software; you {_GNU} General Public License {_FSF}; version 2 of the License.",
    "gpl2-only-short": f"This program is free software; you {_GNU} General Public License version 2 {_FSF}.",
    "lgpl2-redistribute": f"This library is free software; you {_GNU} Library General Public License {_FSF}; either version 2 {_LATER}",
    "lgpl21-redistribute": f"This library is free software; you {_GNU} Lesser General Public License {_FSF}; either version 2.1 {_LATER}",
    "lgpl3-redistribute": f"This program is free software: you {_GNU} Lesser General Public License {_FSF}, either version 3 {_LATER}",
    "lgpl3-library": f"This library is free software: you {_GNU} Lesser General Public License {_FSF}, either version 3 {_LATER}",
    "agpl3-redistribute": f"This program is free software: you {_GNU} Affero General Public License {_FSF}, either version 3 {_LATER}",
    "lgpl-warranty": (
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "isc-grant-and": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "cc0-dedication": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of "
        "his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to "
        "the extent allowed by law."
    ),
    "cc0-software": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide."
    ),
    "unlicense-dedication": "This is free and unencumbered software released into the public domain.",
}
MORE_RULES = [
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-warranty"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-only", ["gpl2-only-short"]),
    ("LGPL-2.0-or-later", ["lgpl2-redistribute", "lgpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute", "gpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-library", "lgpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-warranty"]),
    ("MPL-2.0", ["mpl2-header"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("CC0-1.0", ["cc0-dedication"]),
    ("CC0-1.0", ["cc0-software"]),
    ("Unlicense", ["unlicense-dedication"]),
]
#: Short notices are an opening and a name.
_OPENINGS = ("Licensed under the", "Released under the", "Distributed under the", "This work is licensed under the")
NOTICES = {
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL, version 2"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL, version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL, version 3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL, version 3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "ISC": ("ISC License",),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal license", "CC0 1.0 license", "CC0 1.0 Universal Public Domain Dedication"),
    "Unlicense": ("Unlicense",),
}
SPDX = (
    "GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0-only LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 ISC "
    "CC0-1.0 Unlicense BSD-2-Clause"
).split()
for _name, _titles in NOTICES.items():
    for _n, (_opening, _title) in enumerate((o, t) for o in _OPENINGS for t in _titles):
        MORE_SENTENCES[f"notice-{_name.lower()}-{_n + 1}"] = f"{_opening} {_title}."
        MORE_RULES.append((_name, [f"notice-{_name.lower()}-{_n + 1}"]))
for _name in SPDX:
    MORE_SENTENCES[f"spdx-{_name.lower()}"] = f"SPDX-License-Identifier: {_name}"
    MORE_RULES.append((_name.replace("+", "-or-later"), [f"spdx-{_name.lower()}"]))
#: Every further sentence has one of these or of ``GATE``.
MORE_GATE = GATE + "|unencumbered|cc0|gnu"
#: The SQL twin joins so many fragments at most; the expressions below have no such bound.
MOST_LINES = 10
_CUT = r"([.!?;:])[ \t\r]+"
_OTHER = "[^a-z0-9.+]+"


def fragments_of(text: str) -> list[str]:
    """The normalised fragments of a text, as the expressions below make them."""
    import re

    lines = re.sub(_CUT, r"\1\n", text).split("\n")
    found = (re.sub(_OTHER, " ", "".join(c.lower() if c.isascii() else c for c in line)).strip(" ").rstrip(".") for line in lines)
    return [f for f in found if f]


def known_sentences() -> dict[str, str]:
    """Identifier by normalised sentence, as the SQL twin knows them."""
    return {" ".join(fragments_of(sentence)): name for name, sentence in SENTENCES.items()}


def all_sentences() -> dict[str, str]:
    """Identifier by normalised sentence, the further licences included."""
    return known_sentences() | {" ".join(fragments_of(sentence)): name for name, sentence in MORE_SENTENCES.items()}


def _any_sentence() -> str:
    """Group 1: the longest known sentence from a fragment's start to a fragment's end, words apart by a blank or a start.

    It looks ahead only, so that each fragment start is tried, also those inside a sentence found before.
    """
    import re

    longest_first = sorted(all_sentences(), key=len, reverse=True)
    words = ("[ \\n]".join(re.escape(word) for word in sentence.split(" ")) for sentence in longest_first)
    return rf"\n(?=((?:{'|'.join(words)})(?=\n|\z)))"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _identifiers(text: Column) -> Column:
    lines = F.split(F.regexp_replace(text, _CUT, "$1\n"), "\n")
    plain = F.transform(
        lines, lambda line: F.rtrim(F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), _OTHER, " ")), F.lit("."))
    )
    pieces = F.filter(plain, lambda p: p != "")
    known = F.create_map(*[F.lit(x) for pair in all_sentences().items() for x in pair])
    marked = F.concat(F.lit("\n"), F.array_join(pieces, "\n"))
    found = F.transform(
        F.regexp_extract_all(marked, F.lit(_any_sentence()), F.lit(1)), lambda s: F.try_element_at(known, F.translate(s, "\n", " "))
    )
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text.rlike(MORE_GATE), F.lit(False)), found).otherwise(none)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, sentences and licenses per row of ``docs`` (doc_id, text; others are ignored). No shuffle.

    sentences: identifiers in the order of the text, joined by commas, repeats kept; licenses: distinct names in
    the order of the rules, joined by commas. A null or empty text has none; repeated rows each get a row; null
    ids stay null; an empty table gives an empty result. Whole texts are scanned.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _identifiers(F.col("text").cast("string")).alias("ids"))
    chain = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")
    hits = [F.when(F.instr(chain, "".join(f"|{i}|" for i in ids)) > 0, F.lit(name)) for name, ids in RULES + MORE_RULES]
    names = F.array_distinct(F.array_compact(F.array(*hits)))
    for short, longer in _CONTAINED.items():
        names = F.when(F.array_contains(names, longer), F.array_remove(names, short)).otherwise(names)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentences"),
        F.array_join(names, ",").alias("licenses"),
    )


def _license_sql() -> str:
    keys = ", ".join("'" + k.replace("'", "''") + f"': '{v}'" for k, v in known_sentences().items())
    tries = ", ".join(f"k[array_to_string(f[i:i + {n - 1}], ' ')]" for n in range(MOST_LINES, 0, -1) if n)
    hits = ", ".join(
        f"CASE WHEN contains(chain, '{''.join(f'|{i}|' for i in ids)}') THEN {n} END" for n, (_, ids) in enumerate(RULES)
    )
    order: dict[str, int] = {}
    for n, (name, _) in enumerate(RULES):
        order.setdefault(name, n)
    rules = ", ".join(f"({n}, '{name}', {order[name]})" for n, (name, _) in enumerate(RULES))
    lost = " ".join(f"AND NOT (r.name = '{a}' AND list_contains(all_names, '{b}'))" for a, b in _CONTAINED.items())
    return f"""
WITH rules(n, name, place) AS (VALUES {rules}),
cut AS (
  SELECT doc_id, row_number() OVER () AS row,
         CASE WHEN regexp_matches(text, '{GATE}')
              THEN string_split(regexp_replace(text, '([.!?;:])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))
              ELSE []::VARCHAR[] END AS lines
  FROM documents
), plain AS (
  SELECT doc_id, row, list_filter(list_transform(lines, lambda x: rtrim(trim(regexp_replace(
           translate(x, '{_UPPER}', '{_LOWER}'), '{_OTHER}', ' ', 'g')), '.')), lambda x: x <> '') AS f, MAP {{{keys}}} AS k
  FROM cut
), ids AS (
  SELECT doc_id, row, list_filter(list_transform(range(1, len(f) + 1), lambda i: coalesce({tries})), lambda x: x IS NOT NULL) AS ids
  FROM plain
), chained AS (
  SELECT *, coalesce(array_to_string(list_transform(ids, lambda i: '|' || i || '|'), ''), '') AS chain FROM ids
), hit AS (
  SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS found FROM chained
), named AS (
  SELECT hit.*, (SELECT list(DISTINCT name) FROM rules WHERE list_contains(found, n)) AS all_names FROM hit
), listed AS (
  SELECT row, string_agg(name, ',' ORDER BY place) AS licenses
  FROM (SELECT DISTINCT row, r.name, r.place FROM named JOIN rules r ON list_contains(found, r.n) {lost}) GROUP BY row
)
SELECT doc_id, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentences,
       coalesce(licenses, '') AS licenses
FROM named LEFT JOIN listed USING (row)
"""


LICENSE_SQL = _license_sql()
