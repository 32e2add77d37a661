"""Licence scans by sentence rules, in SQL functions only.

A text loses what marks comments and list items at the beginning of its lines,
and is cut into sentences: at full stops, colons and blank lines. Each is normalised (lower case, runs of other characters than letters
and digits as one space) and looked up among the known licence sentences. What
remains is a sequence of sentence identifiers, against which ordered rules are
matched: a rule names identifiers that must occur in that order, and takes them
out for the rules after it, so a licence that begins like another isn't both. A
notice ("released under the terms of the X license", "dual licensed under X or
Y") is brought to one form for each name; SPDX lines are sentences of their own.
Sentences are cut twice, with line ends as breaks (for a notice on a line of
its own) and as spaces (for wrapped licence texts), and a rule may match either
sequence. Everything happens inside the row; there is no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a comment, and after it an item of a list, at the beginning of a line.
_MARKS = r"(?m)^[ \t]*(?:(?:/{2,}|/[*]+|#+|;+|-{2,}|%+|<!--|[*]+/?)(?:[ \t]+|$))?(?:(?:[-*•]|[(]?(?:[0-9]{1,2}|[a-zA-Z])[.)])[ \t]+)?"
#: Ends of sentences, without and with line ends.
BY_TEXT = r"[.!?:](?:\s|$)|\r?\n[ \t\r]*\n\s*"
BY_LINE = BY_TEXT + r"|[\n\r]+"
#: A colon and a full stop that end no sentence.
_INSIDE = r"(?i)(?:(free\s+software):|(\bv)[.])(\s)"
#: What a notice begins and ends with besides the licence's name, in normalised text; the same around each of several names.
_BEGIN = "^(?:this (?:work|software|program|project|package|file|code|document|data) is )?(?:dual |dually |also )?(?:licensed|released|distributed|available|provided|published|made available) under (?:either )?(?:of )?(?:the )?(?:terms of )?(?:the )?"
_END = "^(under .*?)(?: licen[cs]e)?(?: see .*)?$"
_NAME = "^(?:the )?(.*?)(?: licen[cs]e)?$"
#: Sentences that hold a name of their own.
_OWN, _ANY = "^neither the names? of .* nor the names of its contributors ", "neither the name of the copyright holder nor the names of its contributors "
_SPDX = r"SPDX-License-Identifier:[ \t]*([^\r\n]*)"

#: Licences and the names that notices give them, in normalised text without a last "license".
NAMES = {
    "0BSD": ["0bsd", "zero clause bsd"],
    "AFL-3.0": ["academic free license version 3 0", "afl 3 0"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl 3 0", "agplv3"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache version 2 0"],
    "APSL-2.0": ["apple public source license version 2 0", "apsl 2 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"],
    "BSD-2-Clause": ["bsd 2 clause", "simplified bsd", "2 clause bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "new bsd", "3 clause bsd", "modified bsd"],
    "BSD-4-Clause": ["bsd 4 clause", "original bsd"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international"],
    "CC0-1.0": ["cc0 1 0", "cc0", "creative commons zero v1 0 universal"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "cddl 1 0"],
    "CPL-1.0": ["common public license version 1 0", "cpl 1 0"],
    "ECL-2.0": ["educational community license version 2 0", "ecl 2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"],
    "EUPL-1.2": ["european union public licence version 1 2", "eupl 1 2", "eupl v1 2"],
    "GFDL-1.3": ["gnu free documentation license version 1 3", "gfdl 1 3"],
    "GPL-2.0": ["gnu general public license version 2", "gpl version 2", "gpl 2 0", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gpl version 3", "gpl 3 0", "gplv3"],
    "ISC": ["isc"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"],
    "LPPL-1.3c": ["latex project public license version 1 3c", "lppl 1 3c"],
    "MIT": ["mit", "mit x11"],
    "MIT-0": ["mit no attribution", "mit 0"],
    "MPL-1.1": ["mozilla public license version 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"],
    "MS-PL": ["microsoft public", "ms pl"],
    "NCSA": ["university of illinois ncsa open source", "ncsa"],
    "ODbL-1.0": ["open database license version 1 0", "odbl 1 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "ofl 1 1"],
    "OSL-3.0": ["open software license version 3 0", "osl 3 0"],
    "PostgreSQL": ["postgresql"],
    "PSF-2.0": ["python software foundation license version 2", "psf 2 0"],
    "UPL-1.0": ["universal permissive license version 1 0", "upl 1 0"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["do what the fuck you want to public", "wtfpl"],
    "Zlib": ["zlib", "zlib libpng"],
}
#: Identifiers and normalised sentences of public licences and their notices.
_SENTENCES = {
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the"
        " software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the"
        " software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache2-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-as-is": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties"
        " or conditions of any kind either express or implied"
    ),
    "gpl3-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
        " foundation either version 3 of the license or at your option any later version"
    ),
    "gpl2-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
        " foundation either version 2 of the license or at your option any later version"
    ),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a"
        " particular purpose"
    ),
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or"
        " other materials provided with the distribution"
    ),
    "bsd-names": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without"
        " specific prior written permission"
    ),
    "mpl2-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mit0-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the"
        " software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the"
        " software and to permit persons to whom the software is furnished to do so"
    ),
    "ncsa-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the"
        " software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the"
        " software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"
        " and this permission notice appear in all copies"
    ),
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-grant": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to"
        " the following restrictions"
    ),
    "unlicense-first": "this is free and unencumbered software released into the public domain",
    "bsl1-grant": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this"
        " license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit"
        " third parties to whom the software is furnished to do so all subject to the following"
    ),
    "wtfpl-copies": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "lgpl21-header": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free"
        " software foundation either version 2 1 of the license or at your option any later version"
    ),
    "lgpl3-header": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free"
        " software foundation either version 3 of the license or at your option any later version"
    ),
    "agpl3-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free"
        " software foundation either version 3 of the license or at your option any later version"
    ),
    "postgresql-grant": (
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby"
        " granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"
    ),
}


def reduced(sentence: str) -> str:
    """A normalised sentence, notices in their one form."""
    return re.sub(_END, r"\1", re.sub(_BEGIN, "under ", re.sub(_OWN, _ANY, sentence)))


#: Sentences by identifier; those of notices follow from the names.
SENTENCES = {name: reduced(x) for name, x in _SENTENCES.items()} | {f"{licence.lower()}-notice-{i}": f"under {re.sub(_NAME, r'\1', x)}" for licence, names in NAMES.items() for i, x in enumerate(names)}
#: Rules in order: licence and the sentence identifiers that must follow each other, other sentences between them allowed.
RULES = [
    ("Apache-2.0", ["apache2-header", "apache2-copy", "apache2-as-is"]),
    ("Apache-2.0", ["apache2-header"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl2-header", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl3-header", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-header"]),
    ("LGPL-2.1-or-later", ["lgpl21-header"]),
    ("LGPL-3.0-or-later", ["lgpl3-header"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT-0", ["mit0-grant"]),
    ("NCSA", ["ncsa-grant"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("Unlicense", ["unlicense-first"]),
    ("WTFPL", ["wtfpl-copies"]),
    ("MPL-2.0", ["mpl2-header"]),
    *((licence, [f"{licence.lower()}-notice-{i}"]) for licence, names in NAMES.items() for i in range(len(names))),
]
#: What SPDX lines may name: the licences and, of those with versions to come, these forms.
SPDX = list(dict.fromkeys(licence + form for licence, _ in RULES if not licence.endswith("-or-later") for form in ("", *(("-only", "-or-later", "+") if "GPL" in licence or "GFDL" in licence else ()))))
#: Every known sentence has one of these, so that a text without them is not cut.
_HINT = r"(?i)licen[cs]e|permission|redistribut|copyright|distributed|public domain|(?:released|available|provided|published)\s+under"


def normalise(sentence: Column) -> Column:
    """Lower case, with each run of other characters than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def numbered(rules: list[tuple[str, list[str]]]) -> tuple[list[str], list[tuple[str, int]], dict[str, int]]:
    """The licence of each rule and then of each SPDX name; patterns of the rules of several sentences over ``,a,,b,``, each with its number; numbers of the rules of single sentences."""
    several = [("(.*?)".join(f",{x}," for x in wanted), i) for i, (_, wanted) in enumerate(rules) if len(wanted) > 1]
    single = {wanted[0]: i for i, (_, wanted) in reversed(list(enumerate(rules))) if len(wanted) == 1}
    return [licence for licence, _ in rules] + SPDX, several, single


def _identifiers(text: Column, breaks: str, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for name, sentence in sentences.items() for x in (sentence, name)])
    one_form = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(normalise(s), _OWN, _ANY), _BEGIN, "under "), _END, "$1")
    names = lambda s: F.transform(F.split(F.substring(s, 7, 1000), " or | and "), lambda x: known[F.concat(F.lit("under "), F.regexp_replace(x, _NAME, "$1"))])
    found = lambda s: F.when(known[s].isNotNull() | ~s.startswith("under "), F.array(known[s])).otherwise(names(s))
    formed = F.transform(F.filter(F.split(text, breaks), lambda s: s.rlike(_HINT)), one_form)
    return F.filter(F.flatten(F.transform(formed, found)), lambda x: x.isNotNull())


def scan(documents: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """``(doc_id, n_sentences, sentences, licences, licence)`` for every row of ``documents (doc_id, text)``.

    ``sentences`` (identifier to normalised sentence, see ``reduced``) and
    ``rules`` may be replaced; each sentence has to contain a word of ``_HINT``
    or begin with "under".

    ``sentences`` lists the identifiers of recognised sentences in order (of the
    cut that recognises more; of equals the one by lines), then ``spdx-`` and
    each licence of SPDX lines. ``licences`` are those whose rules match or that
    SPDX lines name, each once, in the order of the rules, and ``licence`` the
    first of them.

    A text that is null, empty or without licence sentences has empty lists and
    a null licence. Repeated rows are repeated, a null doc_id stays null, other
    columns are ignored, an empty table gives no rows. Texts are scanned whole,
    however long.
    """
    text = F.when(F.col("text").rlike(_HINT), F.regexp_replace(F.regexp_replace("text", _MARKS, ""), _INSIDE, "$1$2$3"))
    none = F.array().cast("array<string>")
    every, several, single = numbered(rules)
    tagged = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(_SPDX), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9.+-]+"), F.lit(0))))
    allowed = F.array(*[F.lit(x) for x in SPDX])
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(_identifiers(text, BY_LINE, sentences), none).alias("by_line"),
        F.coalesce(_identifiers(text, BY_TEXT, sentences), none).alias("by_text"),
        F.coalesce(F.when(F.col("text").contains("SPDX-License-Identifier:"), F.filter(tagged, lambda x: F.array_contains(allowed, x))), none).alias("spdx"),
    )
    by_one = F.create_map(*[F.lit(x) for pair in single.items() for x in pair])

    def hits(c: str) -> Column:
        marked = F.concat(F.lit(","), F.array_join(c, ",,"), F.lit(","))
        for pattern, n in several:  # what a rule has matched is gone for the next
            between = "".join(f"${i + 1}" for i in range(pattern.count("(")))
            marked = F.regexp_replace(marked, pattern, f",<{n}>,{between}")
        left = F.split(F.regexp_replace(marked, "^,|,$", ""), ",+")
        return F.transform(left, lambda x: F.when(x.startswith("<"), F.regexp_replace(x, "[<>]", "").cast("int")).otherwise(by_one[x]))

    some = (F.size("by_line") > 0) | (F.size("by_text") > 0) | (F.size("spdx") > 0)
    tagged_rule = F.transform("spdx", lambda x: F.array_position(allowed, x).cast("int") - 1 + len(rules))
    matched = F.sort_array(F.array_distinct(F.array_compact(F.concat(hits("by_line"), hits("by_text"), tagged_rule))))
    found = F.array_distinct(F.transform(matched, lambda i: F.get(F.array(*[F.lit(x) for x in every]), i)))
    rows = rows.withColumn("licences", F.when(some, found).otherwise(none))
    best = F.concat(F.when(F.size("by_text") > F.size("by_line"), F.col("by_text")).otherwise(F.col("by_line")), F.transform("spdx", lambda x: F.concat(F.lit("spdx-"), x)))
    return rows.select("doc_id", F.size(best).alias("n_sentences"), best.alias("sentences"), "licences", F.get("licences", F.lit(0)).alias("licence"))
