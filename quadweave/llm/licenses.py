"""License texts and notices in texts, by MinHash over overlapping windows. DataFrame functions only.

A template of n words is looked for in windows of 2 s words that begin every s words, so that any s
consecutive words lie in one window; s (`step`) is n or up to a quarter more, so that templates of about the same
length share windows.  Windows and templates are sets of five-word shingles (a shorter
template is one shingle of all its words).  A window that holds at least `CONTAINMENT` of a template's m
shingles has a Jaccard similarity to it of at least

    J = c m / (w + (1 - c) m),   w: shingles of a window,

and the number of bands (of one row) is chosen so that 1 - (1 - J)^bands >= `CERTAINTY`.  Band values bring
windows to templates; exact containment of shingles then decides.

A window with enough of a template holds one of any choice of more than (1 - c) m of its shingles.  So only texts and
windows with an `anchor` of a template are looked at: words that stand in so many of its shingles.  Windows with
fewer words than c m shingles have are left out as well.  Neither loses a match.

Words are runs of letters and digits in lower case.  Defined results: null and empty texts match nothing;
rows that share a key count as one document (rows without key as one as well); of several windows that match, the
first and the best containment are reported.  Without templates or rows there are no matches.  Extra columns
are ignored.  A text's words are one row; its windows are cut one at a time.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.pii import let
from quadweave.llm.scratch import written

SHINGLE = 5
CONTAINMENT = 0.8
CERTAINTY = 0.99999
#: Notices that are looked for by default (fixed values: the customary words of each licence).
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
}
_GAP = r"[^\p{L}\p{N}]+"


def _split(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _shingles(words: list[str]) -> list[str]:
    size = min(SHINGLE, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(len(words) - size + 1)))


def default_templates() -> dict[str, str]:
    """The notices, and the whole texts of the licences in `license_texts` (their names end in -whole)."""
    return NOTICES | {f"{f.stem}-whole": f.read_text(encoding="utf-8") for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


def enough(m: int) -> int:
    """Shingles of a template with m that make a match."""
    return math.ceil(CONTAINMENT * m - 1e-9)


def anchors(words: list[str]) -> list[str]:
    """Words of which every match of a template holds one; long words that are in many shingles come first."""
    shingles = [s.split() for s in _shingles(words)]
    need, left, chosen = len(shingles) - enough(len(shingles)) + 1, shingles, []
    while len(shingles) - len(left) < need:
        count: dict[str, int] = {}
        for s in left:
            for w in set(s):
                count[w] = count.get(w, 0) + 1
        word = max(count, key=lambda w: (min(count[w], need) * len(w) ** 3, w))
        chosen.append(word)
        left = [s for s in left if word not in s]
    return chosen


def step(n: int) -> int:
    """n, rounded up to a multiple of a power of two that is at most a quarter of it."""
    unit = 1 << max(0, n.bit_length() - 3)
    return -(-n // unit) * unit


def bands(n: int, containment: float = CONTAINMENT, certainty: float = CERTAINTY) -> int:
    """Bands that find a window with enough of a template of n words with the certainty asked for."""
    size = min(SHINGLE, n)
    m, w = n - size + 1, 2 * step(n) - size + 1
    similarity = containment * m / (w + (1 - containment) * m)
    return math.ceil(math.log(1 - certainty) / math.log(1 - similarity))


def classes(split: dict[str, list[str]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(step, words of a shingle): (bands, least words of a window), for templates of about one length."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for words in split.values():
        size, at = min(SHINGLE, len(words)), (step(len(words)), min(SHINGLE, len(words)))
        count, least = found.get(at, (0, 1 << 31))
        found[at] = max(count, bands(len(words))), min(least, enough(len(_shingles(words))) + size - 1)
    return found


def _hashes(words: Column, size: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " "))))


def _band_values(hashes: Column, count: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def _starts(length: Column, step: int, size: int, count: int, least: int) -> Column:
    """Where the windows of one class begin in a text of so many words, with what its hashes need."""
    window = lambda i: F.struct(i.alias("at"), F.lit(step).alias("step"), F.lit(size).alias("size"), F.lit(count).alias("bands"))
    none = F.array().cast("array<struct<at:int,step:int,size:int,bands:int>>")
    return F.when(length >= least, F.transform(F.sequence(F.lit(0), length - least, F.lit(step)), window)).otherwise(none)


def find(df: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `license`, `first_word` (of the first window), `windows`, `containment` (the best), per match.

    The templates ride in the plan: there may be thousands, not millions."""
    templates = default_templates() if templates is None else templates
    split = {name: words for name, template in templates.items() if (words := _split(template))}
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    if not split:
        return spark.createDataFrame([], f"`{key}` {kind}, license string, first_word int, windows bigint, containment double")
    # One pass of the texts keeps the words of the few that have an anchor.
    every = sorted({a for words in split.values() for a in anchors(words)})
    lowered = F.lower(F.col(text))
    held = df.where(lowered.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(f"\\Q{a}\\E" for a in every) + r")(?![\p{L}\p{N}])")).select(F.col(key).alias("key"), F.filter(F.split(lowered, _GAP), lambda w: w != "").alias("words"))
    # The few texts that are left are spread over all tasks again.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    held = written(held.repartition(tasks), "anchored").repartition(tasks)

    lengths = classes(split)
    rows = [(name, words, step(len(words)), min(SHINGLE, len(words))) for name, words in split.items()]
    named = spark.createDataFrame([(*row, lengths[row[2:]][0]) for row in rows], "license string, template array<string>, step int, size int, bands int")
    sides = named.select("license", "step", "size", "bands", _hashes(F.col("template"), F.col("size")).alias("wanted"))
    index = sides.select("license", "step", "size", F.explode(_band_values(F.col("wanted"), F.col("bands"))).alias("value"))
    found = index.collect()
    index, known = spark.createDataFrame(found, index.schema), sorted({r["value"] for r in found})

    starts = F.flatten(F.array(*[_starts(F.size("words"), *of, *limits) for of, limits in sorted(lengths.items())]))
    windows = held.select("key", "words", F.explode(starts).alias("x")).select("key", "x", F.slice("words", F.col("x.at") + 1, F.col("x.step") * 2).alias("w"))
    windows = windows.where(F.arrays_overlap("w", F.array(*map(F.lit, every))))
    # The hashes of a window are computed once, and go along only with band values that a template has.
    hits = let(_hashes(F.col("w"), F.col("x.size")), lambda h: F.transform(F.filter(_band_values(h, F.col("x.bands")), lambda v: v.isin(known)), lambda v: F.struct(v.alias("value"), h.alias("hashes"))))
    values = windows.select("key", "x", F.explode(hits).alias("b")).select("key", "x.at", "x.step", "x.size", "b.value", "b.hashes")
    retrieved = values.join(F.broadcast(index), ["step", "size", "value"]).join(F.broadcast(sides.select("license", "wanted")), "license")
    common = F.size(F.array_intersect("hashes", "wanted")) / F.size("wanted")
    verified = retrieved.withColumn("containment", common).where(F.col("containment") >= CONTAINMENT)
    once = verified.groupBy("key", "license", F.col("at").alias("first_word")).agg(F.max("containment").alias("containment"))
    best = once.groupBy("key", "license").agg(F.min("first_word").alias("first_word"), F.count("*").alias("windows"), F.max("containment").alias("containment"))
    return best.withColumnRenamed("key", key)
