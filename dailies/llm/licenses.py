"""Licence scans: an exact set-similarity join of text blocks with licence templates."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailies.llm.common import WORD, keyed, word_array

#: Phrases whose places are counted, by label.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Sentences of common licences and notices; each is a set of words to be contained in a block. At a threshold of 0.8
#: up to four words must all be there, five to nine spare one, ten to fourteen two. A sentence that tells a licence by
#: name is so short that the name must be there, or has more naming words than may be missing (MIT is also called
#: Expat). Sentences that several licences share have a family's label, or are notices: they name none.
TEMPLATES = {
    "apache-2.0": ("apache license 2 0", "licensed apache version 2", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    "mit": ("released under mit expat license", "under the mit license", "released the mit license", "released under the mit", "mit license permission granted"),
    "mit-family": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "isc-family": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "gpl-family": (
        "gnu general public license", "licensed gnu public license", "terms gnu public license", "under the gnu general public license version 3", "licensed under the gnu general public license 3",
        "licensed under the gnu general public license version", "redistribute modify under terms of gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "either version 3 of the license or at your option any later version",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice this list of conditions",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "mpl-2.0": ("form mozilla public license", "source form mozilla license", "licensed mozilla license 2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    "epl-family": ("this program and the accompanying materials are made available under the terms of the eclipse public license",),
    "creative-commons": (
        "licensed under cc by", "cc by 4 0", "licensed cc 4 0", "creative commons attribution 4 0 international", "this work is licensed under a creative commons attribution 4 0 international license",
        "to view a copy of this license visit http creativecommons org licenses by 4 0",
    ),
    "cc0": ("creative commons zero public domain dedication", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    "public-domain": ("this is free and unencumbered software released into the public domain",),
    "notice": (
        "copyright c all rights reserved", "no part of this publication may be reproduced without written permission of the publisher",
        "you may not use this file except in compliance with the license", "the software is provided as is without warranty of any kind express or implied",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
}
#: A configuration, not data: what is broadcast is at most this many sentences.
MAX_TEMPLATES = 2_000
BLOCK, STRIDE = 64, 32


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def _rank_of(rank: Mapping[str, int]) -> Callable[[Column], Column]:
    """Place of a word in the global order of the templates' words, null for any other: a hash table as a literal."""
    size = 1 << max(1, len(rank).bit_length())
    slots: list[list] = [[] for _ in range(size)]
    for w, r in rank.items():
        slots[zlib.crc32(w.encode()) % size] += [F.lit(w), F.lit(r)]
    table = F.array(*[F.create_map(*x).cast("map<string,int>") for x in slots])
    return lambda w: F.try_element_at(F.get(table, (F.crc32(w.cast("binary")) % size).cast("int")), w)


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Places of phrases and blocks that contain licence templates, one row for each row of ``docs`` (doc_id, text).

    A block is 64 consecutive words (the last one of a text may be shorter), and blocks start every 32 words, so
    every run of up to 33 words lies in one. A template sentence (at most 32 words) is found where a block has at
    least ``threshold`` of its distinct words; a phrase where its words stand one after the other. Templates are
    sorted by how often their words occur in all of ``docs``: only words of the prefix (all but the most frequent
    ones that the threshold spares) look up templates; a pair is taken up at its first common word, and only if the
    block's length can reach the threshold. Texts are never moved.

    Returns doc_id, n_words, n_base (places of phrases), first_word and last_word (their smallest and largest start,
    else null), base_labels, labels (with the templates' labels; sorted, comma-joined) and score, the largest share
    of a template found (1 for a phrase, 0 without either). Null text is empty; repeated rows each give a row; an
    empty table gives none.
    """
    spark = docs.sparkSession
    sets = [(label, True, _words(p)) for label, p in phrases.items()] + [(label, False, _words(t)) for label, ts in templates.items() for t in ts]
    sets = [s for s in sets if s[2]]
    if len(sets) > MAX_TEMPLATES or any(len(w) > STRIDE for _, _, w in sets):
        raise ValueError(f"at most {MAX_TEMPLATES} sentences of at most {STRIDE} words")
    vocabulary = spark.range(1).select(F.explode(F.lit(sorted({w for s in sets for w in s[2]}))).alias("word"))
    words = keyed(docs).select("doc_id", "h", word_array(F.col("text")).alias("words"))
    seen = words.select(F.explode("words").alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").count()
    often = dict(seen.collect())  # one count for each word of the templates

    ranked = sorted({w for x in sets for w in x[2]}, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    entries: dict[str, list] = {}
    for label, exact, ws in sets:
        order = sorted(set(ws), key=rank.__getitem__)
        need = len(order) if exact else math.ceil(threshold * len(order) - 1e-9)
        for p in range(1 if exact else len(order) - need + 1):
            ints = lambda part: F.lit([rank[w] for w in part]) if part else F.array().cast("array<int>")
            entries.setdefault(order[p], []).append(
                F.struct(
                    F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.lit(ws).alias("phrase"), F.lit(ws.index(order[p])).alias("offset"), F.lit(rank[order[p]]).alias("rank"),
                    ints(order[:p]).alias("earlier"), ints(order[p + 1 :]).alias("later"), F.lit(need).alias("need"), F.lit(len(order)).alias("size"),
                )
            )
    probe = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.array(*e).alias("entries")) for w, e in sorted(entries.items())])))

    at = words.select("doc_id", "h", F.size("words").alias("n"), "words", F.posexplode_outer("words").alias("pos", "token"))
    head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    hit = at.join(F.broadcast(probe), at["token"] == probe["word"], "left").filter(head | F.col("word").isNotNull())
    first = F.when(F.col("pos") >= STRIDE, F.floor(F.col("pos") / STRIDE) - 1).otherwise(0).cast("int")
    looks = F.exists(F.coalesce("entries", F.array()), lambda e: ~e["exact"])
    blocks = F.concat(F.array(F.lit(-1)), F.when(looks, F.sequence(first, F.floor(F.col("pos") / STRIDE).cast("int"))).otherwise(F.array().cast("array<int>")))
    hit = hit.select("doc_id", "h", "n", "words", "pos", head.alias("head"), "entries", F.posexplode(blocks).alias("nth", "block"))
    inside = F.expr(f"slice(words, block * {STRIDE} + 1, {BLOCK})")
    lined = F.array_sort(F.array_compact(F.array_distinct(F.transform(inside, _rank_of(rank)))))
    own = F.filter("entries", lambda e: e["exact"] == (F.col("block") < 0))
    hit = hit.withColumn("lined", F.when(F.col("block") >= 0, lined))
    hit = hit.select("doc_id", "h", "n", "words", "pos", "head", "nth", "lined", F.posexplode_outer(own).alias("k", "e"))
    place = F.col("pos") - F.col("e.offset")
    stands = F.col("e.exact") & (place >= 0) & (F.expr("slice(words, greatest(pos - e.offset, 0) + 1, size(e.phrase))") == F.col("e.phrase"))
    left = F.filter("lined", lambda r: r > F.col("e.rank"))
    reach = 1 + F.least(F.size("e.later"), F.size(left)) >= F.col("e.need")
    taken = ~F.col("e.exact") & (F.size("lined") >= F.col("e.need")) & ~F.arrays_overlap("e.earlier", "lined") & reach
    common = F.when(taken, 1 + F.size(F.array_intersect("e.later", left)))
    contains = common >= F.col("e.need")
    # the first word stands for its text, once, whatever it looks up
    rows = hit.select(
        "doc_id", "h", "n", (F.col("head") & (F.coalesce("k", F.lit(0)) == 0) & (F.col("nth") == 0)).cast("int").alias("head"), "e.label",
        F.when(stands, place).alias("place"), F.when(contains, common / F.col("e.size")).alias("share"),
    ).filter((F.col("head") == 1) | F.col("place").isNotNull() | F.col("share").isNotNull())
    base = F.collect_set(F.when(F.col("place").isNotNull(), F.col("label")))
    found = F.collect_set(F.when(F.col("place").isNotNull() | F.col("share").isNotNull(), F.col("label")))
    out = rows.groupBy("doc_id", "h").agg(
        F.max("n").cast("bigint").alias("n_words"), F.sum("head").alias("copies"), F.count("place").alias("places"), F.min("place").cast("bigint").alias("first_word"), F.max("place").cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(found), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("place").isNotNull(), 1.0).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return out.select(
        "doc_id", "n_words", F.expr("places div copies").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).drop("copy")
