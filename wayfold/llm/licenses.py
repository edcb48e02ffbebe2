"""Licence scans: a paragraph classifier over sparse word n-grams, native on the scan.

A text is cut at blank lines; comment marks go and wrapped lines are joined, so
a paragraph is whole whatever its layout. Its statements (sentences and
clauses ended by a semicolon) are what is classified; one that lists several
licences is read once for each of them besides. Only statements with a cue are
classified: a licence word in one of four languages, a reservation of rights, or
the name of a licence; every template and short name holds one, which a test
asserts, so what the template comparison could confirm word for word passes.

A multinomial logistic regression over presence of word n-grams (one and two
words) tells licence families and ``unknown`` apart. It is trained on the
driver: families on the notices below with words dropped at random; unknown on
ordinary sentences, on notices of licences outside the families, on the
families' notices without their cue words, and on statements of the corpus (at most MAX_DOCUMENTS texts and MAX_STATEMENTS statements with
the smallest hashes, a documented bound). Weights under MIN_WEIGHT are pruned.
A temperature and an offset of the unknown class, fitted on other wordings that
training never sees, other licences among them, calibrate the probabilities;
under MIN_PROBABILITY a statement is unknown. A prediction
counts only when the template comparison confirms it: the share of one of the
family's notices or names whose n-grams the statement holds must reach
MIN_OVERLAP. A negated statement (not released under ...) is never confirmed.

Scanning is row-local: nothing is shuffled. Null and blank texts have no
statements. Families are reported in order of place; of equal probabilities the
later name wins. Repeated rows are scanned each; extra columns pass through,
but one named like the result is replaced.
"""

from __future__ import annotations

import random
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import double_literal, let

SEED, ROUNDS, RATE, DECAY = 11, 400, 2.0, 1e-4
MIN_WEIGHT, MIN_PROBABILITY, MIN_OVERLAP = 0.1, 0.6, 0.5
MAX_DOCUMENTS, MAX_STATEMENTS = 256, 2_000
UNKNOWN = "unknown"

# Common public licence notices by family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-only"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Tous droits réservés.", "This file is proprietary and confidential.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. All rights reserved.", "All rights reserved."],
    "public-domain": ["This work is released into the public domain.", "This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal."],
}

# Short names, as lists of licences use them.
NAMES = {
    "agpl": ["AGPL", "AGPLv3", "under AGPL", "under AGPL-3.0", "GNU Affero General Public License"],
    "apache-2.0": ["under Apache-2.0", "Apache License 2.0", "Apache 2.0 license"],
    "bsd": ["under BSD", "under BSD-3-Clause", "under BSD-2-Clause", "BSD license"],
    "cc-by": ["under CC BY", "Creative Commons Attribution"],
    "cc-by-nc": ["under CC BY-NC", "Creative Commons Attribution-NonCommercial"],
    "gpl": ["under GPL", "under GPL-3.0", "GPL", "GPLv3", "GPLv2", "under GPLv3", "under GPLv2", "GNU General Public License"],
    "isc": ["under ISC", "ISC license"],
    "lgpl": ["LGPL", "LGPLv3", "under LGPL", "under LGPL-2.1", "GNU Lesser General Public License"],
    "mit": ["under MIT", "MIT license", "MIT licensed"],
    "mpl-2.0": ["under MPL-2.0", "Mozilla Public License 2.0"],
    "public-domain": ["under CC0", "this image is in the public domain", "this image belongs to the public domain", "gemeinfrei", "es de dominio público", "est dans le domaine public"],
}

# How three other languages of the corpus name a licence.
FRAMES = ("lizenziert unter der {} Lizenz", "veröffentlicht unter der {} Lizenz", "bajo la licencia {}", "publicado bajo licencia {}", "sous licence {}", "distribué sous la licence {}")
FRAMED = {"agpl": "AGPL", "apache-2.0": "Apache 2.0", "bsd": "BSD", "cc-by": "CC BY", "cc-by-nc": "CC BY-NC", "gpl": "GPL", "isc": "ISC", "lgpl": "LGPL", "mit": "MIT", "mpl-2.0": "MPL 2.0"}

# Licences outside the families, which train the unknown class.
OTHERS = """Eclipse Public License 2.0|EPL-2.0
European Union Public Licence 1.1|EUPL-1.1
Artistic License 2.0|Artistic-2.0
zlib License|Zlib
Common Development and Distribution License 1.0|CDDL-1.0
Microsoft Public License|MS-PL
PostgreSQL License|PostgreSQL
SIL Open Font License 1.1|OFL-1.1
Academic Free License 3.0|AFL-3.0
Python Software Foundation License 2.0|PSF-2.0
Open Software License 3.0|OSL-3.0
Common Public License 1.0|CPL-1.0
Business Source License 1.1|BUSL-1.1
Server Side Public License 1|SSPL-1.0
Open Database License 1.0|ODbL-1.0""".splitlines()
OTHER_FRAMES = ("Licensed under the {}.", "This program and the accompanying materials are made available under the terms of the {}.", "This work is distributed under the {}, see the file for details.", "Released under {}")

# Licences outside the families that only calibrate.
OTHER_CALIBRATION = ["Licensed under the IBM Public License 1.0", "This library is free software under the Ruby License", "Released under the W3C Software Notice and License", "Covered by the Sun Industry Standards Source License", "made available under the terms of the CeCILL licence", "Licensed under the Elastic License 2.0"]

# Other wordings, on which the probabilities are calibrated; training never sees them.
CALIBRATION = {
    "agpl": ["Distributed under the terms of the GNU AGPL version 3 license", "This server is free software under the GNU Affero General Public License v3.0"],
    "apache-2.0": ["This project is made available under the Apache License 2.0", "Code in this repository is licensed under Apache License Version 2.0", "Unless required by applicable law, software distributed under the Apache License is distributed on an as is basis"],
    "bsd": ["Use of this source code is governed by a BSD-style license", "This package is distributed under the 3-clause BSD license", "Redistributions of source code in source and binary forms are permitted provided the conditions are met"],
    "cc-by": ["Text is available under the Creative Commons Attribution 4.0 License", "Images are published under a CC BY 4.0 license"],
    "cc-by-nc": ["Available under a Creative Commons Attribution-NonCommercial license", "The data are shared under CC BY-NC 4.0 license terms"],
    "gpl": ["This program comes under the terms of the GNU General Public License version 2", "Distributed under the GPL license", "released under GNU General Public License v3"],
    "isc": ["This module uses the ISC license", "Permission to use, copy and distribute this software with or without fee is hereby granted"],
    "lgpl": ["You may use this library under the GNU Lesser General Public License", "This library is distributed under the LGPL license"],
    "mit": ["This software is available under the MIT license", "The code is MIT licensed", "Permission is hereby granted, free of charge, to use this software and associated documentation"],
    "mpl-2.0": ["This file is under the Mozilla Public License version 2.0", "Covered by the Mozilla Public License"],
    "proprietary": ["Copyright 2020 Example Corporation. All rights reserved", "This document is proprietary and confidential and all rights are reserved"],
    "public-domain": ["The author places this work in the public domain", "This image is in the public domain and free of known copyright"],
    UNKNOWN: ["the city gave its permission for the market", "he lost his driving license last week", "a licensed electrician must do this work", "the rights of the tenants were reserved for another day", "redistribution of wealth was the topic of the debate", "the public domain of debate has grown", "the license plate of the car was found", "permission is needed to enter the park", "her letters are confidential", "the software license costs ten dollars a month", *OTHER_CALIBRATION],
}

# Ordinary sentences near licence wording, which train the unknown class.
ORDINARY = """the driver lost his license after the accident in march
she was released from hospital under the care of her doctor
the version of the story that he told was different in the second chapter
they work under the assumption that the source of the river is in the north
you may not use the lift in case of fire
permission was granted by the city to hold the fair in the park
the general told the public that the war was over
a copy of the letter was found in the library of the foundation
this is the first time that the company has sold a product in this form
all of the rooms are free and the terms of the offer are subject to change
the file was lost and the work had to be done again
the conditions in the mountains are not good and the road is closed
in the beginning there was a house with a garden and a dog
use the following words in a sentence and read it to the class
for any person in the town the price of bread is of great importance
with or without rain the game will be played on sunday
the commons voted on the bill and the lords sent it back
he asked for permission to leave and permission is seldom granted
a licence to sell beer costs more than a licence to sell bread
the talks were confidential and the room was reserved for them
redistribution of land came before the redistribution of money
the doctor is licensed and the shop is licensed to sell wine
they renewed the fishing license at the office
the matter belongs in the public domain of politics and not at home
public domain names are sold by many companies
er fährt mit einer lizenz und der mann hat keine lizenz
der trainer mit der lizenz wurde gelobt
la licencia de conducir fue renovada y perdió la licencia
la licence de pêche coûte cher et il a perdu sa licence
the gnu lives in the grass of the south and the apache lived in the west
the mozilla browser and the apache server were started
the talk at mit was on general public policy
all seats were reserved and all rights were respected
that of by as for it this to and on with from at are be was is the a in""".splitlines()

#: Without one of these a statement is unknown.
CUES = r"(?i)li[cz]en[scz]|permission is|permission to|redistribut|rights (?:are )?reserved|rechte vorbehalten|derechos reservados|droits réservés|public domain|dominio público|domaine public|gemeinfrei|spdx|confidential|proprietary|creative commons|cc0|cc[ -]by|\b[al]?gpl|gnu |\bapache\b|\bbsd\b|\bmpl\b|\bisc\b|mozilla public|(?-i:\bMIT\b)"
#: What begins a comment line, what ends a comment.
COMMENT = r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*+|//+!?|#+|;+|--+|%+|<!--+|dnl\b|\.\\\")?[ \t]*|[ \t]*(?:\*+/|--+>)[ \t]*$"
PARAGRAPH_END, LINE_END = r"\n[ \t\r]*(?:\n[ \t\r]*)+", r"[ \t\r]*\n[ \t\r]*"
STATEMENT_END = r"(?<=[\p{L}\p{N}\"')\]]{2}[.;!?])\s+"
SEVERAL = r"(?i)^(.*?(?:licen[sc]ed(?: \w+){0,3}? under|spdx-license-identifier:)) +(?:either |both )?(.*(?: or | and |/).*)$"
BETWEEN = r"(?i),? (?:or|and) | ?/ ?"
NEGATED = r"(?i)\b(?:not|never|no longer|isn't|aren't|wasn't)\b(?:\W+\w+){0,3}?\W+(?:licen[sc]ed|released|distributed|available|covered|subject|under|governed)\b"


def words_in(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


class Model(NamedTuple):
    families: list[str]
    grams: list[str]
    weights: list[list[float]]
    bias: list[float]
    templates: list[tuple[str, list[str]]]


def all_notices() -> list[tuple[str, str]]:
    """(family, text) of every template, short name and its forms in other languages."""
    framed = [(f, frame.format(name)) for f, name in sorted(FRAMED.items()) for frame in FRAMES]
    return [(f, t) for f in sorted(TEMPLATES) for t in (*TEMPLATES[f], *NAMES.get(f, ()))] + framed


def own_names() -> list[tuple[str, str]]:
    """(family, name) of the families' short names without what stands around them."""
    return [(f, t.removeprefix("under ")) for f in sorted(FRAMED) for t in NAMES[f]]


def other_sentences() -> list[str]:
    """What the unknown class learns of licences outside the families."""
    return [frame.format(name) for line in OTHERS for name in line.split("|") for frame in OTHER_FRAMES]


def train(corpus: list[str] = (), seed: int = SEED) -> Model:
    """Fits, prunes and calibrates the model. corpus: statements without a cue; the same result for the same ones."""
    import numpy as np

    rng = random.Random(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    notices = all_notices()

    def variants(text: str, n: int) -> list[set[str]]:
        words = words_in(text)
        return [grams_of(words), *(grams_of([w for w in words if rng.random() > 0.15]) for _ in range(n))]

    last = len(families) - 1
    rows = [(g, families.index(f)) for f, t in notices for g in variants(t, 8)]
    blunt = [" ".join(re.sub(CUES, " ", t).split()) for _, t in notices]
    # The same sentences around names of families and of other licences, so that the sentence itself tells nothing.
    rows += [(g, families.index(f)) for f, t in own_names() for frame in OTHER_FRAMES for g in variants(frame.format(t), 2)]
    others = other_sentences()
    unknown = [
        [g for t in others for g in variants(t, 2)],
        [*(g for t in ORDINARY for g in variants(t, 8)), *(grams_of(words_in(t)) for t in blunt)],
        [*(grams_of(words_in(t)) for t in sorted(corpus)), *[set()] * 20],
    ]
    # Every family weighs as much as any other, and so does every kind of unknown text, whatever the number of its rows.
    share = [1 / sum(k == own for _, k in rows) for _, own in rows]
    share += [1 / len(unknown) / len(kind) for kind in unknown for _ in kind]
    rows += [(g, last) for kind in unknown for g in kind]
    grams = sorted({g for _, t in notices for g in grams_of(words_in(t))} | {g for t in (*ORDINARY, *others) for g in grams_of(words_in(t))})
    place = {g: i for i, g in enumerate(grams)}

    def table(sets: list[set[str]]):
        x = np.zeros((len(sets), len(grams)))
        for i, own in enumerate(sets):
            x[i, [place[g] for g in own if g in place]] = 1.0
        return x

    def probability(logits):
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = table([g for g, _ in rows]), np.eye(len(families))[[k for _, k in rows]]
    each = np.array(share)[:, None] / len(families)
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))
    for _ in range(ROUNDS):
        gap = (probability(x @ w + b) - y) * each
        w -= RATE * (x.T @ gap + DECAY * w)
        b -= RATE * gap.sum(axis=0)
    w[np.abs(w - w[:, -1:]).max(axis=1) < MIN_WEIGHT] = 0.0
    held = [(grams_of(words_in(t)), families.index(f)) for f in sorted(CALIBRATION) for t in CALIBRATION[f]]
    logits = table([g for g, _ in held]) @ w + b
    truth = np.arange(len(held)), [k for _, k in held]
    shift = lambda v: np.eye(len(families))[-1] * v
    loss = {(t, v): -np.log(probability(logits * t + shift(v))[truth] + 1e-12).mean() for t in np.arange(0.5, 6.1, 0.25) for v in np.arange(-3.0, 3.1, 0.25)}
    heat, offset = map(float, min(loss, key=loss.get))
    b = b + shift(offset / heat)
    keep = np.nonzero(np.abs(w).max(axis=1) > 0)[0]
    templates = [(f, sorted(grams_of(words_in(t)))) for f, t in notices]
    used = sorted({grams[i] for i in keep} | {g for _, own in templates for g in own})
    column = lambda g, k: round(float(w[place[g], k] * heat), 6)
    return Model(families, used, [[column(g, k) for g in used] for k in range(len(families))], [round(float(v * heat), 6) for v in b], templates)


def statements(text: Column) -> Column:
    """Array of (paragraph, statement) with a cue, given a non-null text."""
    paragraphs = F.split(F.regexp_replace(text, COMMENT, ""), PARAGRAPH_END)

    def of_paragraph(p: Column, i: Column) -> Column:
        found = F.filter(F.split(F.regexp_replace(p, LINE_END, " "), STATEMENT_END), lambda s: s.rlike(CUES))
        return F.transform(found, lambda s: F.struct(i.cast("int").alias("paragraph"), s.alias("statement")))

    cued = F.flatten(F.transform(paragraphs, of_paragraph))
    return F.when(text.rlike(CUES), cued).otherwise(F.array().cast("array<struct<paragraph:int,statement:string>>"))


def readings(statement: Column) -> Column:
    """The statement, and one reading for each licence that it lists."""
    head, tail = F.regexp_extract(statement, SEVERAL, 1), F.regexp_extract(statement, SEVERAL, 2)
    each = F.transform(F.filter(F.split(tail, BETWEEN), lambda t: F.trim(t) != ""), lambda t: F.concat(head, F.lit(" "), t))
    return F.concat(F.array(statement), F.when(head != "", each).otherwise(F.array().cast("array<string>")))


def corpus_statements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_documents: int = MAX_DOCUMENTS, max_statements: int = MAX_STATEMENTS) -> list[str]:
    """Statements without a cue of the documents with the smallest id hashes, to train the unknown class."""
    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__c")).distinct().orderBy(F.xxhash64("__c"), "__c").limit(max_documents)
    texts = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__c")).select(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), COMMENT, "").alias("t"))
    each = texts.select(F.explode(F.split(F.regexp_replace("t", LINE_END, " "), STATEMENT_END)).alias("s")).where(~F.col("s").rlike(CUES) & (F.length("s") < 2_000)).distinct()
    return [r.s for r in each.orderBy(F.xxhash64("s"), "s").limit(max_statements).collect()]


def scan(docs: DataFrame, model: Model | None = None, text_col: str = "text", into: str = "__licences") -> DataFrame:
    """docs with an array column: paragraph, family, probability, overlap, confirmed, negated.

    Only statements whose class is not unknown are listed, in order.
    """
    model = model or train()
    known = F.split(F.lit("\n".join(model.grams)), "\n")
    weight = [double_literal(row) for row in model.weights]

    def places(text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")

        def held(words: Column) -> Column:
            pairs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
            return F.transform(F.array_intersect(F.array_distinct(F.concat(words, pairs)), known), lambda g: (F.array_position(known, g) - 1).cast("int"))

        return let(words, held)

    def logit(at: Column, k: int) -> Column:
        return F.aggregate(at, F.lit(model.bias[k]), lambda a, i: a + F.get(weight[k], i))

    spot = {g: i for i, g in enumerate(model.grams)}
    by_family: dict[str, list[list[int]]] = {}
    for family, own in model.templates:
        by_family.setdefault(family, []).append([spot[g] for g in own])

    def overlap(at: Column, family: Column) -> Column:
        share = lambda own: F.size(F.array_intersect(at, F.split(F.lit(",".join(map(str, own))), ",").cast("array<int>"))) / F.lit(float(len(own)))
        out = F.lit(0.0)
        for name, notices in by_family.items():
            best = F.greatest(*(share(own) for own in notices), F.lit(0.0))
            out = F.when(family == name, best).otherwise(out)
        return out

    def judged(paragraph: Column, text: Column, at: Column) -> Column:
        logits = F.array(*(F.struct(logit(at, k).alias("z"), F.lit(f).alias("f")) for k, f in enumerate(model.families)))

        def decide(z: Column) -> Column:
            top = F.array_max(z)
            total = F.aggregate(z, F.lit(0.0), lambda a, s: a + F.exp(s["z"] - top["z"]))
            return F.struct(
                paragraph.alias("paragraph"),
                F.when(1 / total >= MIN_PROBABILITY, top["f"]).otherwise(F.lit(UNKNOWN)).alias("family"),
                F.round(1 / total, 6).alias("probability"),
                F.round(overlap(at, top["f"]), 6).alias("overlap"),
                text.rlike(NEGATED).alias("negated"),
            )

        return let(logits, decide)

    def read(s: Column) -> Column:
        return F.transform(readings(s["statement"]), lambda t: let(places(t), lambda at: judged(s["paragraph"], t, at)))

    found = F.flatten(F.transform(statements(F.coalesce(F.col(text_col), F.lit(""))), read))
    named = F.transform(
        F.filter(found, lambda r: r["family"] != UNKNOWN),
        lambda r: F.struct(*(r[n].alias(n) for n in ("paragraph", "family", "probability", "overlap")), ((r["overlap"] >= MIN_OVERLAP) & ~r["negated"]).alias("confirmed"), r["negated"].alias("negated")),
    )
    return docs.withColumn(into, named)
