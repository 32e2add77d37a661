"""Document operators against brute force on small inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from graphloom.llm import langid, licences, neardup, quality, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra="bands string, text_x string"):
    """doc_id and text, with columns whose names operators use inside."""
    names = [x.split()[0] for x in extra.split(", ")]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], f"doc_id long, text string, {extra}")


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "re", "on"]) + str(rng.randrange(400)) for _ in range(n))


# ---- near duplicates -----------------------------------------------------


def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rng = random.Random(5)
    base = sentence(rng, 120).split()
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "One"), (5, "one two"), (6, "a b c d e"), (7, "A b c d e")]
    for i in range(10, 70):  # a group of near copies with edits, chained by similarity
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(i, sentence(rng, rng.randrange(1, 60))) for i in range(100, 140)] + [(200 + i, "x y z " * 3000) for i in range(2)]
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, rows), width, percent).collect())
    assert got == brute_components(rows, width, percent)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == [(2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (None, 2, None, True)]
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_densified_bins_keep_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:20]), np.unique(pool[2:22])  # fewer members than bins
    sign = neardup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 160)
    same = (sign[0] == sign[1]).mean()
    assert abs(same - 18 / 22) < 0.2


# ---- repeated passages ---------------------------------------------------


def brute_passages(rows, least):
    """Words of each document that lie in a run of ``least`` words that an earlier document has."""
    out, seen = {}, {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        grams = [tuple(words[k : k + least]) for k in range(len(words) - least + 1)]
        hit = {k + j for k, g in enumerate(grams) if seen.get(g, i) < i for j in range(least)}
        if hit:
            out[i] = hit
        for g in grams:
            seen.setdefault(g, i)
    return out


def test_repeated_passages(spark):
    rng = random.Random(8)
    shared = [sentence(rng, 55 + 7 * k) for k in range(4)]
    rows = [(0, None), (1, ""), (2, " ")]
    for i in range(3, 60):
        parts = [sentence(rng, rng.randrange(5, 90))]
        if i % 3 == 0:
            parts += [rng.choice(shared), sentence(rng, rng.randrange(1, 30))]
        if i % 7 == 0:
            parts += [sentence(rng, 3), " ".join(shared[0].split()[:40])]  # too short to count
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows.append((61, rows[30][1]))
    docs = frame(spark, rows)
    found = substrings.repeated_passages(docs)
    got = {}
    texts = dict(rows)
    for r in found.collect():
        words = WORD.findall(texts[r["doc_id"]])
        own = words[r["word"] : r["word"] + r["n_words"]]
        assert r["source_doc_id"] < r["doc_id"] and own == WORD.findall(texts[r["source_doc_id"]])[r["source_word"] :][: r["n_words"]]
        assert WORD.findall(texts[r["doc_id"]][r["start"] : r["stop"]]) == own
        got.setdefault(r["doc_id"], set()).update(range(r["word"], r["word"] + r["n_words"]))
    assert got == brute_passages(rows, 50)
    left = {r["doc_id"]: r["text"] for r in substrings.cut_passages(docs, found).collect()}
    for i, text in rows:
        words = WORD.findall(text or "")
        assert WORD.findall(left[i] or "") == [x for k, x in enumerate(words) if k not in got.get(i, ())], i
        assert i in got or left[i] == text


def covered(spark, rows):
    got = {}
    for r in substrings.repeated_passages(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["word"], r["word"] + r["n_words"]))
    return got


def test_passages_whose_parts_come_from_elsewhere(spark):
    rng = random.Random(12)
    rows = []
    for i in range(0, 400, 10):  # halves in different earlier documents, then the whole twice
        a, b = (sentence(rng, 30) for _ in range(2))
        rows += [(i + k, " ".join([sentence(rng, 20), text, sentence(rng, 20)])) for k, text in enumerate([a, b, f"{a} {b}", f"{a} {b}"])]
        line = sentence(rng, 20)  # an earlier place of the line in the source itself
        rows += [(i + k, " ".join([line, sentence(rng, 9), sentence(random.Random(i), 20), line, sentence(random.Random(i + 1), 20), sentence(rng, 5)])) for k in (5, 6)]
    want = brute_passages(rows, 50)
    assert len(want) == 80 and covered(spark, rows) == want


def test_passages_of_repeated_words_and_phrases(spark):
    rng = random.Random(13)
    rows = []
    for i in range(120):
        unit = rng.choice([["and"], ["it"], ["of."], ["of", "the"], ["no", "no", "yes"], [f"w{k}" for k in range(rng.choice([17, 49, 51]))]])
        run = (unit * 200)[rng.randrange(len(unit)) :][: rng.choice([40, 49, 50, 51, 63, 64, 65, 130, 180])]
        rows.append((i, " ".join([sentence(rng, rng.randrange(1, 40)), *run, sentence(rng, rng.randrange(1, 40))])))
    rows += [(200, "and " * 3000), (201, "so " + "and " * 4000)]
    assert covered(spark, rows) == brute_passages(rows, 50)
    n = substrings.repeated_passages(frame(spark, rows[-2:])).count()
    assert 0 < n < 100  # and not one for each place


def test_chunks_resist_insertions():
    import pyarrow as pa

    rng = random.Random(1)
    text = sentence(rng, 400)
    one, two = (set(substrings.chunks(pa.array([x]))[3].tolist()) for x in (text, "some words before it " + text))
    assert len(one & two) >= len(one) - 2


def test_no_passages(spark):
    assert substrings.repeated_passages(frame(spark, [])).collect() == []
    assert substrings.repeated_passages(frame(spark, [(None, "a " * 80), (1, "b " * 80), (1, "b " * 80)])).collect() == []


# ---- quality -------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)]


def test_quality_measures(spark):
    rng = random.Random(2)
    texts = [None, "", " \x0b\f\r\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\nx\n\n x\nx ", "é ö 日本 #$ <a>|b", "a\xa0b", "w " * 9000, "x\x0by\x1fz"]
    texts += [" ".join(rng.choices("abc", k=rng.randrange(40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "a b c")]
    got = sorted(quality.ledger(frame(spark, rows, "failed_bits string, n_words string")).collect())
    want = sorted([i, *brute_measures(t)] for i, t in rows)
    assert [list(r)[:7] for r in got] == want
    for r in got:
        for name, fails in (("few_words", r["n_words"] < 50), ("repeated_windows", 100 * r["n_repeat_words"] > 50 * r["n_words"])):
            assert bool(r["failed_bits"] & quality.BIT[name]) == fails


def test_policies_and_ablations(spark):
    book = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 8), (5, 9)], "doc_id long, failed_bits long")
    assert [r["kept"] for r in quality.apply_policy(book, "base-1").orderBy("doc_id").collect()] == [True, False, False, True, False]
    rows = {(r["policy"], r["rule"]): r for r in quality.ablations(book).collect()}
    few = rows["base-1", "few_words"]
    assert (few["n_failed"], few["n_alone"], few["n_kept_without"]) == (3, 2, 4)
    assert (rows["strict-1", "symbols"]["n_failed"], rows["strict-1", "symbols"]["n_alone"]) == (2, 1)


# ---- language ------------------------------------------------------------


def test_viterbi_against_every_path():
    from itertools import product

    rng = np.random.default_rng(3)
    score, penalty = rng.normal(size=(11, 3)).astype(np.float32) * 3, 1.5
    offsets = np.array([0, 5, 5, 11])
    labels = langid.viterbi(score, offsets, penalty)
    worth = lambda s, path: s[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()
    for a, b in ((0, 5), (5, 11)):
        best = max(worth(score[a:b], np.array(p)) for p in product(range(3), repeat=b - a))
        assert abs(worth(score[a:b], labels[a:b].astype(int)) - best) < 1e-4


def test_held_out_accuracy_and_mixed_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(langid.training_part(docs))
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang", langid.held_out().alias("out")), "doc_id").where("out").collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    texts = {r["lang"]: " ".join(r["text"].split()[:40]) for r in docs.where("lang IN ('en', 'fr') AND n_chars > 600").collect()}
    mixed = frame(spark, [(1, texts["en"] + " " + texts["fr"]), (2, None), (3, "12 ..."), (4, ""), (None, texts["fr"]), (5, "Ελληνικά")])
    got = {r["doc_id"]: r for r in langid.identify(mixed, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "fr"] and abs(got[1]["spans"][1]["start"] - 40) <= 3
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4))
    assert got[None]["lang_pred"] == "fr"


def test_model_of_nothing(spark):
    model = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in langid.identify(frame(spark, [(1, "some text")]), model).collect()] == ["und"]


# ---- licences ------------------------------------------------------------


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    rows = [(1, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, mit), (3, None), (4, ""), (5, "a license of no kind."), (6, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (None, "Licensed under CC BY-NC 4.0.")]
    rows.append((7, "\n".join(reversed(mit.split("\n\n")))))  # wrong order
    rows.append((8, "# " + mit.replace("\n", "\n# ")))  # in comments
    rows.append((9, " ".join(mit.split())))  # on one line
    rows.append((10, "word " * 400_000 + ". " + mit))
    notices = [f"{verb} {the}{name}{end}" for verb in ("This software is released under", "Licensed under") for the in ("", "the ", "the terms of the ") for name in ("ISC", "MPL 2.0", "Zlib") for end in ("", " License", " licence")]
    rows += [(100 + i, f"Words before it.\n{x}.\nWords after it.") for i, x in enumerate(notices)]
    rows += [(1000 + i, f"Licensed under {names[-1]}.") for i, names in enumerate(licences.NAMES.values())]
    got = {r["doc_id"]: r for r in licences.scan(frame(spark, rows, "licences string, sentences string")).collect()}
    assert got[1]["licence"] == "Apache-2.0" and got[2]["licences"] == ["MIT"] and got[2]["n_sentences"] == 2
    assert got[6]["licences"] == ["CC-BY-NC-4.0", "MIT"] and got[None]["licence"] == "CC-BY-NC-4.0"
    assert all(got[i]["licence"] is None and got[i]["licences"] == [] for i in (3, 4, 5, 7))
    assert all(got[i]["licences"] == ["MIT"] for i in (8, 9, 10))
    assert [got[100 + i]["licence"] for i in range(len(notices))] == [next(k for k in ("ISC", "MPL-2.0", "Zlib") if k[:3] in x) for x in notices]
    assert len(licences.NAMES) >= 40 and [got[1000 + i]["licence"] for i in range(len(licences.NAMES))] == list(licences.NAMES)
    assert licences.scan(frame(spark, [], "licences string")).collect() == []


BSD = """Copyright (c) 2020, A. N. Other

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
NAMES_ITEM = """
3. Neither the name of the Example Company nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MIT = """The MIT License

Copyright (c) 2020 A. N. Other

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE = """Copyright 2020 A. N. Other

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GNU = """This {what} is free software{sign} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{then} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented."""
TEXTS = {
    "BSD-2-Clause": BSD,
    "BSD-3-Clause": BSD + NAMES_ITEM,
    "MIT": MIT.partition("\n\n")[2],
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GNU.format(what="program", sign=":", kind="", then=",", version=3),
    "GPL-2.0-or-later": GNU.format(what="program", sign=";", kind="", then=";", version=2),
    "AGPL-3.0-or-later": GNU.format(what="program", sign=":", kind="Affero ", then=",", version=3),
    "LGPL-2.1-or-later": GNU.format(what="library", sign=";", kind="Lesser ", then=";", version=2.1),
    "LGPL-3.0-or-later": GNU.format(what="library", sign=":", kind="Lesser ", then=",", version=3),
    "ISC": ISC.format(", provided that the above\ncopyright notice and this permission notice appear in all copies"),
    "0BSD": ISC.format(""),
    "Zlib": ZLIB,
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def in_comments(text: str) -> list[str]:
    lines = text.split("\n")
    block = "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\nint x;"
    return [text, *("\n".join(f"{mark} {x}".rstrip() for x in lines) for mark in ("#", "//", ";;", "--")), block, text.replace("\n", "\r\n"), "   " + text.replace("\n", "\n   ")]


def test_licence_texts_each_give_their_own(spark):
    rows, want = [], []
    for licence, text in TEXTS.items():
        for form in in_comments(text):
            rows.append((len(rows), form))
            want.append([licence])
    for marks in (["1)", "2)", "3)"], ["(1)", "(2)", "(3)"], ["a.", "b.", "c."], ["*", "*", "*"], ["-", "-", "-"]):
        text = BSD + NAMES_ITEM
        for n, mark in enumerate(marks):
            text = text.replace(f"\n{n + 1}. ", f"\n{mark} ")
        rows += [(len(rows), text), (len(rows) + 1, text.partition(f"\n{marks[2]} Neither")[0])]
        want += [["BSD-3-Clause"], ["BSD-2-Clause"]]
    both = BSD + NAMES_ITEM + "\n\n" + BSD
    others = [
        (both, ["BSD-3-Clause", "BSD-2-Clause"]), (MIT, ["MIT"]), ("Licensed under the MIT License, see LICENSE.", ["MIT"]), ("// SPDX-License-Identifier: MIT", ["MIT"]),
        ("/* SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) WITH Linux-syscall-note */", ["BSD-3-Clause", "GPL-2.0-or-later"]),
        ("Dual licensed under MIT or Apache-2.0.", ["Apache-2.0", "MIT"]), ("Licensed under either of the Apache License, Version 2.0 or the MIT license.", ["Apache-2.0", "MIT"]),
        ("SPDX-License-Identifier: NOBODY-KNOWS", []), ("Licensed under a scheme of our own or nothing.", []), ("x " * 50_000 + "\n\n" + MIT, ["MIT"]),
    ]
    rows += [(len(rows) + i, text) for i, (text, _) in enumerate(others)]
    want += [x for _, x in others]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(frame(spark, rows, "spdx string, by_text string")).collect()}
    assert [(got[i], rows[i][1][:300]) for i in range(len(rows)) if got[i] != want[i]] == []


def test_licences_as_in_sql(spark):
    import duckdb
    import pandas as pd
    from graphloom.llm.queries import ORACLES

    rows = [(i, form) for i, form in enumerate(x for text in TEXTS.values() for x in (text, *in_comments(text)[1:6]))] + [(1000, None), (1001, "SPDX-License-Identifier: MIT AND Zlib\nDual licensed under ISC or the MIT license")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by name below
    want = sorted(duckdb.sql(ORACLES["op3_sentence_licences"]).fetchall())
    found = licences.scan(frame(spark, rows, "lang string"))
    from pyspark.sql import functions as F

    got = found.select("doc_id", "n_sentences", F.array_join("sentences", ","), F.array_join("licences", ","), "licence").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == want
