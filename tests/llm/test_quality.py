import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import licenses, quality_model, quality_rules, queries, toxicity

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(twice)


def test_counts_and_verdict(docs, none, texts, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 1), (500, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(docs, labels).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == sorted((i or 0, *brute_counts(t)) for i, t in texts)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.judge(none, labels).count() == 0 and quality_rules.judge(docs, labels.limit(0)).count() == 16


def test_bounds_are_exact():
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0
    k = quality_rules.upper_bound(3, 50, 0.05)
    assert quality_rules._tail(3, 50, k) == pytest.approx(0.05, abs=1e-6)


def test_cutoffs_hold_the_risk():
    rng = np.random.default_rng(1)
    rows = [("a", "r", int(b), 1) for b in np.minimum(rng.geometric(0.2, 3000), 200)] + [("b", "r", 3, 20)]
    cut = quality_rules.choose_cutoffs(rows, risk=0.05)
    assert ("b", "r") not in cut  # twenty documents certify nothing
    rejected = sum(b >= round(cut["a", "r"] * 200) for s, _, b, _ in rows if s == "a")
    assert quality_rules.upper_bound(rejected, 3000, 0.025) <= 0.05 and cut["a", "r"] < 0.2


def brute_scores(text):
    w = WORD.findall(text)
    n, chars, symbols, dup, repeats = brute_counts(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    share = lambda a, b: min(1.0, a / b) if b else 0.0
    return [share(symbols, chars), share(dup, lines), share(repeats, n), share(upper, letters), share(sum(a == b for a, b in zip(w, w[1:])), n)]


def test_verdict_against_brute_force(spark):
    rng = random.Random(9)
    rows, good = [], []
    for i in range(1100):
        lang = "en" if i < 1000 else "de"
        w = [f"t{rng.randrange(900)}" for _ in range(30)]
        bad = i % 5 == 0
        for _ in range(12 if bad else int(rng.expovariate(2))):
            w[rng.randrange(30)] = rng.choice(["##", "A%B", "<<>>"]) if bad or rng.random() < 0.5 else "AB"
        rows.append((i, " ".join(w[:15]) + "\n" + " ".join(w[15:]), lang))
        if not bad:
            good.append(i)
    labels = spark.createDataFrame([(i, int(i in set(good)), 0) for i in range(1100)], "doc_id long, quality int, toxic int")
    scores = {i: brute_scores(t) for i, t, _ in rows}
    bins, tests, part = 200, 10, 0.05 / 5
    cutoffs = {}
    for lang in ("en", "de"):
        held = [scores[i] for i in good if rows[i][2] == lang]
        for k in range(5):
            for b in range(bins, 0, -1):
                n, above = len(held), sum(math.floor(x[k] * bins) >= b for x in held)
                tail = sum(math.comb(n, j) * part**j * (1 - part) ** (n - j) for j in range(above + 1))
                if tail > 0.05 / tests:
                    break
                cutoffs[lang, k] = b
    want = {i: not any(math.floor(scores[i][k] * bins) >= cutoffs.get((lang, k), bins + 1) for k in range(5)) for i, _, lang in rows}
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert got == want and not any(lang == "de" for lang, _ in cutoffs)
    assert 150 < sum(not k for k in want.values()) < 260 and sum(not want[i] for i in good if i < 1000) <= 0.05 * 800
    no_lang = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").drop("lang"), labels)
    assert no_lang.count() == 1100 and "lang" not in no_lang.columns


def test_quality_model_held_out(spark):
    rows = queries.op1_quality_model(spark, DATA).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in known) >= 0.93 * len(known)


def test_compiled_rules_score_like_the_model(spark, docs, none):
    rng = np.random.default_rng(2)
    x = rng.random((800, len(quality_model.FEATURES)))
    y = ((x[:, 3] < 0.4) | (x[:, 0] > 0.8)).astype(float)
    model = quality_model.fit(x, y)
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.95 and 0 < len(model.rules) < 200
    stats = quality_model.statistics(docs).select("_stats.*").collect()
    want = model.score(np.array([list(r) for r in stats]))
    assert sorted(r["s"] for r in quality_model.statistics(docs).select(model.column().alias("s")).collect()) == pytest.approx(sorted(want))
    out = quality_model.score(docs.drop("score"), model)
    assert out.count() == 16 and quality_model.score(none.drop("score"), model).count() == 0
    for labels in ([], [1.0], [0.0]):
        assert quality_model.fit(x[: len(labels)], np.array(labels)).rules == []


def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        w = [f"n{rng.randrange(400)}" for _ in range(60)]
        bad = i % 6 == 0
        for k in range(rng.randint(1, 5) if bad else 0):
            w[rng.randrange(60)] = rng.choice(["idiot", "scum,", "Moron"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert (np.diff(model.thresholds) > 0).all()
    scored = toxicity.score(df.withColumnRenamed("toxic", "y"), model).collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["toxic"] == bool(r["y"]) for r in held) >= 0.95 * len(held)
    many = [r["expected_severity"] for r in scored if len(re.findall("(?i)idiot|scum|moron", r["text"])) > 3]
    one = [r["expected_severity"] for r in scored if len(re.findall("(?i)idiot|scum|moron", r["text"])) == 1]
    assert np.mean(many) > np.mean(one)
    out = toxicity.score(docs, model)
    assert out.count() == 16 and toxicity.score(none, model).count() == 0 and out.where("toxic").select("doc_id").collect() == [(13,)]


def test_licences_in_standard_texts():
    import textwrap

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to deal in the Software without restriction."
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    bsd = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer.",
        "3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ]
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    scan = lambda text: licenses.apply_rules(licenses.recognise(text))
    assert scan("This text is available under CC BY-SA 4.0.") == ["CC-BY-SA-4.0"] and scan("Released under CC0 1.0.") == ["CC0-1.0"]
    assert scan("Under BSD 3-Clause.") == ["BSD-3-Clause"]
    assert scan("It is under the MIT License and may be copied.") == ["MIT"]
    assert scan(gpl) == ["GPL-3.0-or-later"]
    for width in (30, 60, 72, 80):
        wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, width))
        for mark in ("", "# ", " * ", "// "):
            assert scan(f"{mark}Copyright 2020 X\n\n{wrap(mit, mark)}\n{mark}\n{wrap(notice, mark)}") == ["MIT"], (width, mark)
            assert scan("\n".join(wrap(t, mark) for t in bsd)) == ["BSD-3-Clause"], (width, mark)
            assert scan("\n".join(wrap(t, mark) for t in bsd[:3])) == ["BSD-2-Clause"], (width, mark)
            assert scan(wrap(gpl, mark)) == ["GPL-3.0-or-later"], (width, mark)
    assert scan("A license to thrill, in a bsd-like way.") == [] and scan("See Apache License 2.5 of old") == []


def test_expressions_short_names_and_unknown_licences():
    scan = lambda text: licenses.apply_rules(licenses.recognise(text))
    assert scan("// SPDX-License-Identifier: MIT OR Apache-2.0") == ["MIT", "Apache-2.0"]
    assert scan("SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause") == ["GPL-2.0-only WITH linux-syscall-note", "BSD-3-Clause"]
    assert scan("Licensed under GPLv3.") == ["GPL-3.0"] and scan("Some of it is LGPL-2.1 or later.") == ["LGPL-2.1"] and scan("AGPL v3") == ["AGPL-3.0"]
    assert scan('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file.') == ["Apache-2.0"]
    assert scan("Licensed under the MIT license, see LICENSE.") == ["MIT"] and scan("This work is CC BY-SA 4.0.") == ["CC-BY-SA-4.0"]
    assert scan("CC0 1.0 Universal") == ["CC0-1.0"] and scan("BSD 3-Clause") == ["BSD-3-Clause"]
    assert scan("Distributed under the Foo Public Licence of 2031.") == ["unknown"] and scan("We went under the bridge; he had a licence.") == []


def test_licences(docs, none, spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind."
    cases = {
        "Some words.\nReleased under the MIT License.\nmore": ["MIT"],
        "x\nThis work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.": ["Apache-2.0"],
        "Licensed under CC BY-NC 4.0.\nSPDX-License-Identifier: ISC": ["CC-BY-NC-4.0", "ISC"],
        mit: ["MIT"],
        "Copyright 2020 X.\nAll rights reserved.": ["all-rights-reserved"],
        "A license to thrill.": None,
        "": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(df).collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v}
    assert licenses.scan(docs).count() == 0 and licenses.scan(none).count() == 0
