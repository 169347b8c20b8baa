"""Licence scan: sparse word n-gram logistic regression over paragraphs, with a calibrated unknown class, confirmed by templates.

Every line of every document is a paragraph. Its hashed words, word pairs and triples meet the weights of one logistic regression a
family; what no family claims is `none`, and what speaks of licensing without enough certainty is `unknown`. A claimed family stands
only if a template of that family agrees with the paragraph: enough of the template's word pairs occur in it.

The model is fitted on the driver from templates and seeded variations of them, against seeded ordinary prose, as the tables have no
licence labels.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from annolytics.llm import textnum

SPACE = 1 << 18

# Short public licence notices by family.
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0", "This project is available under the Apache 2.0 license."),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT", "This software is distributed under the MIT license."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU Lesser General Public License, version 2.1.", "GNU Affero General Public License version 3"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "cc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License", "Dedicated to the public domain under CC0 1.0 Universal"),
    "proprietary": ("All rights reserved.", "Copyright (c) 2020 Example Corp. All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.", "This document is confidential and proprietary."),
}
#: Sentences that speak of licences without naming a known family: they train the unknown class.
VAGUE = ("See the license for details.", "This content is subject to license terms.", "Please read the terms of use before you copy this.", "Used under license from the owner.", "Licensed under the terms of the agreement.", "The licence of this file is described elsewhere.", "Copyright notices must be kept.", "Distributed under a custom license.", "You may use this work under the conditions below.")


@dataclass
class LicenseModel:
    families: list[str]
    weights: np.ndarray  # (SPACE, families) float32
    bias: np.ndarray
    pairs: list[list[np.ndarray]]  # of each family, the sorted word-pair hashes of each template
    threshold: float = 0.5
    confirm: float = 0.5


def grams(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: text and line of each paragraph; paragraph and slot of each 1- to 3-gram; paragraph and hash of each pair."""
    # punctuation ends words here, so that "License," and "License" are one
    table = bytes(32 if chr(b) in "\"'(),.:;!?<>[]{}/*#-_=|" else b for b in range(256))
    h, start, _ = textnum.words(data.translate(table))
    ends = np.cumsum(lengths + 1)
    breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    text = np.searchsorted(ends, start, side="right")
    number = np.searchsorted(breaks, start)
    new = np.ones(len(h), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
    owner = np.cumsum(new) - 1
    line = number[new] - np.searchsorted(breaks, np.append(0, ends[:-1]))[text[new]]
    two = np.flatnonzero(owner[1:] == owner[:-1]) if len(h) else np.zeros(0, dtype=np.int64)
    pair = textnum.mix(h[two] * np.uint64(0xBF58476D1CE4E5B9) + h[two + 1])
    three = two[np.flatnonzero(owner[np.minimum(two + 2, max(0, len(h) - 1))] == owner[two])] if len(two) else two
    three = three[three + 2 < len(h)]
    triple = textnum.mix(textnum.mix(h[three] * np.uint64(0xBF58476D1CE4E5B9) + h[three + 1]) * np.uint64(3) + h[three + 2])
    mask = np.uint64(SPACE - 1)
    slot = np.concatenate([h, pair, triple]) & mask
    return text[new], line, np.concatenate([owner, owner[two], owner[three]]), slot.astype(np.int64), owner[two], pair, np.bincount(owner, minlength=int(new.sum()))


def logistic(model: LicenseModel, owner: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Probability of each family for each of n paragraphs; grams are averaged with a root, so that length alone decides nothing."""
    used = np.any(model.weights != 0, axis=1)[slot]
    seen = np.unique(owner[used] * SPACE + slot[used])  # a gram counts once a paragraph
    owner_used, slot_used = seen // SPACE, seen % SPACE
    total = np.stack([np.bincount(owner_used, model.weights[slot_used, c], n) for c in range(len(model.families))], axis=1) if n else np.zeros((0, len(model.families)))
    scale = np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))[:, None]
    return 1 / (1 + np.exp(-np.clip(total / scale + model.bias, -40, 40)))


def prose(rng: random.Random) -> str:
    syllables = "an ar be ca der el fi gu ho in jo ka lo mi ne on pe qua ri so tu ur ve wi za the of and to in is that for with as this by from".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 3)))) for _ in range(rng.randint(1, 60)))


@lru_cache(maxsize=1)
def default_model(seed: int = 3) -> LicenseModel:
    rng = random.Random(seed)
    families = [*TEMPLATES, "unknown"]
    texts, y = [], []
    for c, family in enumerate(families):
        for template in TEMPLATES.get(family, VAGUE):
            for _ in range(12):
                words = template.split()
                if rng.random() < 0.5:
                    words = [w for w in words if rng.random() > 0.08] or words
                around = [prose(rng), prose(rng)] if rng.random() < 0.3 else ["", ""]
                texts.append(" ".join([*around[0].split()[:12], *words, *around[1].split()[:12]]))
                y.append(c)
    common = "the of and to in is that for with as this by from a on or you be are may it".split()
    for i in range(3000):
        texts.append(prose(rng) if i % 2 else " ".join(rng.choice(common) for _ in range(rng.randint(1, 12))))
        y.append(-1)
    labels = np.array(y)
    data, lengths = b" ".join(t.encode() for t in texts), np.array([len(t.encode()) for t in texts])
    text, _, owner, slot, *_ = grams(data, lengths)
    seen = np.unique(owner * SPACE + slot)
    counts = np.bincount(owner)
    owner, slot = seen // SPACE, seen % SPACE
    labels = labels[text]
    n, k = len(labels), len(families)
    weights, bias = np.zeros((SPACE, k), dtype=np.float32), np.full(k, -3.0)
    model = LicenseModel(families, weights, bias, [])
    scale = np.sqrt(np.maximum(counts, 1))
    squares = np.full((SPACE, k), 1e-3)
    used = np.unique(slot)
    for _ in range(60):  # full-batch AdaGrad with weight decay
        p = np.stack([np.bincount(owner, weights[slot, c], n) for c in range(k)], axis=1) / scale[:, None] + bias
        error = 1 / (1 + np.exp(-np.clip(p, -40, 40))) - (labels[:, None] == np.arange(k))
        for c in range(k):
            g = np.bincount(slot, (error[:, c] / scale)[owner], SPACE)[used] + 1e-3 * weights[used, c]
            squares[used, c] += g * g
            weights[used, c] -= (0.8 * g / np.sqrt(squares[used, c])).astype(np.float32)
        bias -= 0.02 * error.sum(axis=0) / np.sqrt(n)
    # what speaks for nothing is left at zero: grams of ordinary prose cost nothing at scoring
    weights[np.abs(weights).max(axis=1) < 1e-2] = 0
    for family in TEMPLATES:
        own = []
        for template in TEMPLATES[family]:
            raw = template.encode()
            *_, pair, _ = grams(raw, np.array([len(raw)]))
            own.append(np.unique(pair))
        model.pairs.append(own)
    return model


def scanned(texts: list[str | None], model: LicenseModel) -> Iterator[tuple[int, int, str, float, float, int]]:
    """(text, line, family or unknown, probability, share of the template found, words) of each paragraph about licences."""
    for i, _, data, lengths in textnum.blocks(texts):
        text, line, owner, slot, pair_owner, pair, size = grams(data, lengths)
        p = logistic(model, owner, slot, len(text))
        if not len(p):
            continue
        for at in np.flatnonzero(p.max(axis=1) >= model.threshold).tolist():
            c = int(p[at].argmax())
            family, share = model.families[c], 0.0
            if family != "unknown":
                a, b = np.searchsorted(pair_owner, [at, at + 1])
                own = np.unique(pair[a:b])
                share = max(len(np.intersect1d(t, own, assume_unique=True)) / max(1, len(t)) for t in model.pairs[c])
                if share < model.confirm:
                    family = "unknown"
            yield i + int(text[at]), int(line[at]), family, float(p[at].max()), share, int(size[at])


def paragraphs(docs: DataFrame, *, model: LicenseModel | None = None) -> DataFrame:
    """doc_id, licenses: array<struct<line, family, probability, template_share, words>> in line order; one row a row of docs.

    Null, empty and blank texts have an empty array; lines are read whole. Equal texts have equal arrays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("array<struct<line:long,family:string,probability:double,template_share:double,words:long>>")
    def scan(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            rows: list[list] = [[] for _ in range(len(s))]
            for i, line, family, p, share, words in scanned([t if isinstance(t, str) else None for t in s], shared.value):
                rows[i].append({"line": line, "family": family, "probability": round(p, 6), "template_share": round(share, 6), "words": words})
            yield pd.Series(rows, dtype=object)

    return docs.select("doc_id", scan(F.col("text").cast("string")).alias("licenses"))


def documents(docs: DataFrame, *, model: LicenseModel | None = None) -> DataFrame:
    """doc_id, n_found, families (sorted, distinct), license (the surest confirmed family, else unknown, else none), probability."""
    found = paragraphs(docs, model=model)
    known = F.filter("licenses", lambda s: s["family"] != "unknown")
    surest = lambda a: F.array_max(F.transform(a, lambda s: F.struct(s["probability"].alias("p"), s["family"].alias("f"))))
    best = F.coalesce(surest(known), surest(F.col("licenses")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_found"), F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["family"]))).alias("families"),
        F.coalesce(best["f"], F.lit("none")).alias("license"), F.coalesce(best["p"], F.lit(0.0)).alias("probability"), "licenses",
    )
