"""Licence scans: sentences become identifiers, identifiers meet rules (operator 7).

DataFrame functions alone, one pass, no shuffle: a text is cut into sentences, each is
normalised (lower case, runs of other characters as one space) and looked up among the
known licence sentences; the identifiers found, in order, meet the ordered rules of
each licence. A rule is a sequence of identifiers that must follow each other with
nothing known in between; of rules that start at one place the longest wins, and its
identifiers are used up.

Catalogue: the sentences of full notices (`SENTENCES`), one-line notices made of a beginning
and a licence's name (`NOTICES`, `NAMES`, `BEHIND`), and SPDX-License-Identifier lines, whose every
licence is reported: the GNU ones without "only" and "or later", unknown ones as they stand.
"All rights reserved", alone or behind a copyright line, is `proprietary`, unless the sentences of
a full notice follow it. Other licences and other wordings are not known.

A text with known sentences of which no rule comes true is reported as partial.

Defined cases: a null or empty text has no licence; repeated rows are scanned each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: sentences of well-known notices, and the rules over them -----
SENTENCES = {
    "A": "Licensed under the Apache License, Version 2.0",
    "B": "you may not use this file except in compliance with the License",
    "C": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "D": "Licensed under the Apache License, Version 2.0 (the License)",
    "E": "Released under the MIT License",
    "F": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "G": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "H": "This work is licensed under the GNU General Public License, version 3",
    "I": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "J": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "K": "Licensed under CC BY-NC 4.0",
    "L": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "M": "Licensed under CC BY 4.0",
    "N": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "O": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "P": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "Q": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "R": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "S": "Licensed under the MIT License",
    "T": "This work is licensed under the MIT License",
    "U": "Licensed under the GNU General Public License, version 3",
    "a": "All rights reserved",
    "b": "This program is free software",
    "c": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "d": "either version 2 of the License, or (at your option) any later version",
    "e": "either version 2.1 of the License, or (at your option) any later version",
    "f": "either version 3 of the License, or (at your option) any later version",
    "g": "This library is free software",
    "h": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "i": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "j": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "k": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "l": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "m": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "n": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "o": "This is free and unencumbered software released into the public domain",
    "p": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "q": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "r": "Distributed under the Boost Software License, Version 1.0",
    "s": "Use of this software is governed by the Business Source License included in the LICENSE file",
    "t": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "u": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
}
PROPRIETARY = "proprietary"
#: Sequences of sentence identifiers, longest first where one begins another.
RULES = {
    "NOPQ": "BSD-3-Clause",
    "NOP": "BSD-2-Clause",
    "DBC": "Apache-2.0",
    "ABC": "Apache-2.0",
    "AB": "Apache-2.0",
    "D": "Apache-2.0",
    "A": "Apache-2.0",
    "FG": "MIT",
    "E": "MIT",
    "S": "MIT",
    "T": "MIT",
    "IJ": "GPL-3.0",
    "H": "GPL-3.0",
    "U": "GPL-3.0",
    "K": "CC-BY-NC-4.0",
    "L": "CC-BY-NC-4.0",
    "M": "CC-BY-4.0",
    "R": "MPL-2.0",
    "bcd": "GPL-2.0",
    "bcf": "GPL-3.0",
    "l": "GPL-2.0",
    "ghd": "LGPL-2.0",
    "ghe": "LGPL-2.1",
    "ghf": "LGPL-3.0",
    "bhe": "LGPL-2.1",
    "bhf": "LGPL-3.0",
    "k": "LGPL-3.0",
    "bif": "AGPL-3.0",
    "j": "AGPL-3.0",
    "m": "ISC",
    "n": "ISC",
    "o": "Unlicense",
    "p": "EPL-2.0",
    "q": "EPL-1.0",
    "r": "BSL-1.0",
    "s": "BUSL-1.1",
    "t": "CC0-1.0",
    "u": "CC0-1.0",
}
# Full notices often stand below "All rights reserved".
RULES |= {"a" + ids: name for ids, name in RULES.items() if len(ids) > 1} | {"a": PROPRIETARY}
# -- fixed values: one-line notices ----------------------------------------------
NOTICES = (
    r"^(?:this (?:work|software|project|program|library|file|code|document) is )?"
    r"(?:licen[sc]ed|released|distributed|published|available)(?: under the terms of| under) (?:the |an? )?|^licen[sc]e (?:the )?"
)
#: What may stand behind a name.
BEHIND = r"(?: international| unported)?(?: only| or later| or any later version| or at your option any later version)?(?: licen[sc]e)?$"
#: Names of each licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0"],
    "MIT": ["MIT"],
    "ISC": ["ISC"],
    "BSD-2-Clause": ["BSD-2-Clause", "2-Clause BSD", "BSD 2-Clause \"Simplified\"", "Simplified BSD"],
    "BSD-3-Clause": ["BSD-3-Clause", "3-Clause BSD", "BSD 3-Clause \"New\" or \"Revised\"", "New BSD"],
    "MPL-2.0": ["MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"],
    "EPL-1.0": ["EPL 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "BSL-1.0": ["BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "BUSL-1.1": ["BUSL-1.1", "BSL 1.1", "Business Source License 1.1", "Business Source License, version 1.1"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
} | {
    f"CC-{code.replace(' ', '-')}-{v}": [f"CC {code} {v}", f"Creative Commons {name} {v}"]
    for code, name in {
        "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
        "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
        "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    }.items()
    for v in ("3.0", "4.0")
} | {
    f"{code}-{v}": [
        name
        for short in dict.fromkeys((v, v.removesuffix(".0")))
        for name in (
            f"{code} {short}", f"{code}v{short}", f"{code} v{short}", f"GNU {code} v{short}",
            f"GNU {code} version {short}", f"{word} Public License {short}",
            f"{word} Public License v{short}", f"{word} Public License version {short}",
        )
    ]
    for code, word, versions in (
        ("GPL", "GNU General", ("2.0", "3.0")), ("LGPL", "GNU Lesser General", ("2.1", "3.0")),
        ("AGPL", "GNU Affero General", ("3.0",)),
    )
    for v in versions
}
PARTIAL = "partial"
#: Every known sentence has one of these words.
HINT = (
    "licen[sc]e|redistribut|permission|copyright|warranty|CC BY|reserved|public domain|"
    "free software|either version|(?:released|distributed|published|available)\\s+under"
)
#: Stands between sentences; in a text it ends a sentence too.
MARK = "\u0001"
#: Sentence ends: a mark before white space, or a line end.
_LINE = r"(?i)SPDX-License-Identifier:[ \t]*"
_ID = r"(?:[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\+?)"
_SPDX = rf"{_LINE}(\(*{_ID}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{_ID}\)*)*)"
_RESERVED = r"^(?:copyright|c) .*all rights reserved$"
_ENDS = r"[.!?;]+[\x22')]*(?=\s)|:(?=\s*\n)|\n{2,}|[.!?;:]\s*$"


def normalised(sentence: str) -> str:
    return re.sub(r"[^\w]+", " ", sentence.lower()).strip()


#: One character of the private use area for each licence of `NAMES`.
NAMED = {licence: chr(0xE000 + i) for i, licence in enumerate(NAMES)}
RULES |= {key: licence for licence, key in NAMED.items()}


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in order: (line by line, over line ends)."""
    known = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (normalised(v), k)])
    short = {normalised(n).removesuffix(" license"): NAMED[k] for k, v in NAMES.items() for n in v}
    names = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    marked = F.regexp_replace(text, _ENDS, MARK)
    return F.struct(
        _looked_up(F.replace(marked, F.lit("\n"), F.lit(MARK)), known, names).alias("lines"),
        _looked_up(F.replace(marked, F.lit("\n"), F.lit(" ")), known, names).alias("sentences"),
    )


def _looked_up(marked: Column, known: Column, names: Column) -> Column:
    def identifier(sentence: Column) -> Column:
        words = F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}_]+", " ")
        words = F.regexp_replace(F.trim(words), _RESERVED, normalised(SENTENCES["a"]))
        name = F.regexp_replace(F.regexp_replace(words, NOTICES, ""), BEHIND, "")
        named = F.when(words.rlike(NOTICES), F.try_element_at(names, name))
        return F.coalesce(F.try_element_at(known, words), named)

    return F.array_join(F.transform(F.split(marked, MARK), identifier), "")


def licenses(text: Column) -> Column:
    """The licences of a text, each once and sorted, as array<string>."""
    ids = sentence_ids(text)
    found = F.array_distinct(
        F.concat(_ruled(ids["lines"]), _ruled(ids["sentences"]), _spdx(text))
    )
    full = F.array_sort(F.array_remove(found, PARTIAL))
    result = F.when((F.size(full) == 0) & (F.size(found) > 0), found).otherwise(full)
    return F.when(text.rlike(f"(?i){HINT}"), result).otherwise(F.array().cast("array<string>"))


def _ruled(ids: Column) -> Column:
    rules = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    several = sorted((r for r in RULES if len(r) > 1), key=len, reverse=True)
    parts = F.regexp_extract_all(ids, F.lit("|".join([*several, "."])), F.lit(0))
    return F.transform(parts, lambda p: F.coalesce(F.try_element_at(rules, p), F.lit(PARTIAL)))


def _spdx(text: Column) -> Column:
    """The licences of SPDX lines; exceptions behind WITH are none."""
    names = {n.lower(): n for n in RULES.values() if n != PROPRIETARY}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    lines = F.regexp_extract_all(text, F.lit(_SPDX), F.lit(1))
    without = F.regexp_replace(F.array_join(lines, " AND "), rf"(?i)\s+WITH\s+\(*{_ID}", "")
    each = F.filter(F.split(without, r"(?i)[\s()]+(?:(?:AND|OR)[\s()]+)*|[()]"), lambda x: x != "")

    def name(said: Column) -> Column:
        plain = F.regexp_replace(said, r"(?i)^([AL]?GPL-[0-9.]+)(?:-only|-or-later|\+)$", "$1")
        return F.coalesce(F.try_element_at(known, F.lower(plain)), plain)

    return F.transform(each, name)
