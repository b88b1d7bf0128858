"""License scans by diagonal voting.

All rolling word trigrams of all texts are hashed and joined to the trigrams' places in the license
templates (a bounded, broadcast table); equal hashes are checked word by word in the same join. A
hit votes for the diagonal (place in the text less place in the template). Neighbouring diagonals,
which arise from inserted or dropped words, are merged; a merged span is verified by the share
of the template's trigrams that it covers and by its length, and must hold the words that tell its
license from those of like wording (TELLING) and none that belong to another (BARRED). Those words are
found at the same places, in the same pass. A template's exact places are the
diagonals with every vote; an identifier, which is short, counts only where it has such a place.

Defined results: null or empty text has no words and score 0; a null doc_id is kept as null; repeated rows
have the same result each; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from ._text import folded_words, folded_words_column

K = 3
#: Words that may be inserted or missing between two hits of one span.
NEAR = 2
COVER, STRETCH = 0.6, 1.6
#: Template trigrams that may be broadcast (about 100 bytes each).
BROADCAST_LIMIT = 50_000

# The base phrases, and public license notices in words.
BASE = {
    "mit": ["under the mit license"],
    "apache-2": ["apache license version 2"],
    "cc-by-nc": ["cc by nc"],
}
NOTICES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "gpl-2": ["under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "gpl-3": [
        "licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-3": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": ["licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-sa": ["licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-nd": ["licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Public short names and SPDX identifiers.
IDENTIFIERS = {
    "mit": ["SPDX-License-Identifier: MIT"],
    "apache-2": ["SPDX-License-Identifier: Apache-2.0", "Apache License 2.0", "Apache 2.0 license"],
    "bsd": ["BSD 2-Clause", "BSD 3-Clause"],
    "isc": ["SPDX-License-Identifier: ISC"],
    "gpl-2": ["SPDX-License-Identifier: GPL-2.0", "GNU GPL v2", "GNU GPL version 2", "GNU GPL 2.0"],
    "gpl-3": ["SPDX-License-Identifier: GPL-3.0", "GNU GPL v3", "GNU GPL version 3", "GNU GPL 3.0"],
    "lgpl": ["SPDX-License-Identifier: LGPL", "GNU LGPL v2", "GNU LGPL v3", "GNU LGPL version 2", "GNU LGPL version 3"],
    "agpl-3": ["SPDX-License-Identifier: AGPL-3.0", "GNU AGPL v3", "GNU AGPL version 3"],
    "mpl-2": ["SPDX-License-Identifier: MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0"],
    "cc-by-sa": ["CC BY-SA"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC BY-ND 3.0"],
    "cc-by-nc-sa": ["CC BY-NC-SA"],
    "cc-by-nc-nd": ["CC BY-NC-ND"],
    "cc0": ["CC0 1.0"],
    "unlicense": ["SPDX-License-Identifier: Unlicense"],
}


#: Words that tell licenses of like wording apart: mark, SQL test of a text's words w0 and w1 (the next). A license's notice holds all its marks.
MARKS = {
    "gnu-general": "w0 = 'gnu' and w1 = 'general'",
    "lesser": "w0 = 'lesser'",
    "affero": "w0 = 'affero'",
    "2": "w0 = 'v2' or w0 = 'version' and w1 = '2'",
    "3": "w0 = 'v3' or w0 = 'version' and w1 = '3'",
    "attribution": "w0 = 'attribution' and coalesce(w1, '') not in ('sharealike', 'share', 'noncommercial', 'non', 'noderivatives', 'noderivs', 'no')",
    "sharealike": "w0 = 'sharealike' or w0 = 'share' and w1 = 'alike'",
    "noncommercial": "w0 = 'noncommercial' or w0 = 'non' and w1 = 'commercial'",
    "noderivatives": "w0 in ('noderivatives', 'noderivs') or w0 = 'no' and w1 in ('derivatives', 'derivs')",
}
TELLING = {
    "gpl-2": ["gnu-general", "2"], "gpl-3": ["gnu-general", "3"], "lgpl": ["lesser"], "agpl-3": ["affero"],
    "cc-by": ["attribution"], "cc-by-sa": ["sharealike"], "cc-by-nc": ["noncommercial"], "cc-by-nd": ["noderivatives"],
    "cc-by-nc-sa": ["noncommercial", "sharealike"], "cc-by-nc-nd": ["noncommercial", "noderivatives"],
}
#: Marks inside a span that make it another license's.
BARRED = {"cc-by-sa": ["noncommercial"], "cc-by-nd": ["noncommercial"], "cc-by-nc": ["sharealike", "noderivatives"]}
#: Marks of versions may also stand up to so many words behind a span, after its last hit.
VERSIONS, BEHIND = ("2", "3"), 3


def templates(base: dict[str, list[str]] = BASE, notices: dict[str, list[str]] = NOTICES, identifiers: dict[str, list[str]] = IDENTIFIERS) -> list[tuple[int, str, str, list[str]]]:
    """number, label, kind (base, notice or identifier), words; templates of fewer than K words can't be voted for."""
    flat = [(label, kind, t) for kind, known in (("base", base), ("notice", notices), ("identifier", identifiers)) for label, ts in known.items() for t in ts]
    out = [(k, label, kind, [w.decode() for w in folded_words(t)]) for k, (label, kind, t) in enumerate(flat)]
    for _, label, _, words in out:
        if len(words) < K:
            raise ValueError(f"a template of {label} has fewer than {K} words")
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def template_grams(spark: SparkSession, known: list[tuple[int, str, str, list[str]]]) -> DataFrame:
    rows = [f"({t}, {_quoted(label)}, {_quoted(kind)}, {len(words) - K + 1}, {p}, {', '.join(map(_quoted, words[p : p + K]))})" for t, label, kind, words in known for p in range(len(words) - K + 1)]
    grams = spark.sql(f"select *, xxhash64(t0, t1, t2) t_gram from values {', '.join(rows)} as t(template, label, kind, grams, place, t0, t1, t2)")
    return F.broadcast(grams) if len(rows) <= BROADCAST_LIMIT else grams


def votes(docs: DataFrame, known: list[tuple[int, str, str, list[str]]]) -> DataFrame:
    """doc_id, h (xxhash64 of the text), template, label, kind, grams, at, place, mark: each hit and each mark once; a mark that is no hit has null in the template's columns."""
    words = docs.select("doc_id", "h", folded_words_column(F.col("text")).alias("w"))
    n = F.size("w")
    rolling = F.arrays_zip(F.col("w").alias("w0"), F.slice("w", F.lit(2), n).alias("w1"), F.slice("w", F.lit(3), n).alias("w2"))
    grams = words.select("doc_id", "h", F.posexplode(rolling).alias("at", "g")).select("doc_id", "h", "at", "g.w0", "g.w1", "g.w2").withColumn("gram", F.xxhash64("w0", "w1", "w2"))
    # The tests exclude each other, so a place has one mark at most.
    mark = F.coalesce(*[F.when(F.expr(test), name) for name, test in MARKS.items()])
    met = grams.join(template_grams(docs.sparkSession, known), F.expr("gram = t_gram and w0 = t0 and w1 = t1 and w2 = t2"), "left").withColumn("mark", mark)
    return met.where("template is not null or mark is not null").select("doc_id", "h", "template", "label", "kind", "grams", "at", "place", "mark").distinct()


def spans(hits: DataFrame) -> DataFrame:
    """Merged diagonals: doc_id, h, template, label, first (word), behind (last word), cover (0 to 1), exact (places of the whole template), exact_first, exact_last, kind."""
    keys = ["doc_id", "h", "template", "label", "kind", "grams"]
    lines = hits.where("template is not null").withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*keys, "diagonal").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places"))
    # A partition is one template in one text, so it is bounded by the text.
    along = Window.partitionBy(*keys).orderBy("diagonal")
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= NEAR, 0).otherwise(1)
    grouped = lines.withColumn("step", step).withColumn("span", F.sum("step").over(along))
    whole = F.size("places") == F.col("grams")
    out = grouped.groupBy(*keys, "span").agg(
        F.min("first").alias("first"), (F.max("last") + K).alias("behind"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        F.count(F.when(whole, 1)).alias("exact"), F.min(F.when(whole, F.col("diagonal"))).alias("exact_first"), F.max(F.when(whole, F.col("diagonal"))).alias("exact_last"),
    )
    return out.withColumn("cover", F.col("covered") / F.col("grams"))


def told(verified: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, h, label: labels of verified spans that hold all marks of their license (versions up to BEHIND words after them) and none that is barred."""
    marked = lambda names: F.coalesce(*[F.when(F.col("label") == label, F.array(*map(F.lit, m))) for label, m in names.items()], F.expr("cast(array() as array<string>)"))
    span = ["doc_id", "h", "label", "first", "behind"]
    asked = verified.where("kind <> 'identifier'").select(*span, marked(TELLING).alias("needs"), marked(BARRED).alias("bars")).distinct()
    plain = asked.where("size(needs) = 0").unionByName(verified.where("kind = 'identifier'"), allowMissingColumns=True).select("doc_id", "h", "label")
    asked, m = asked.where("size(needs) > 0"), marks.select(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"), "mark", F.col("at").alias("word"))
    here = asked.doc_id.eqNullSafe(m.m_id) & (asked.h == m.m_h) & m.word.between(asked["first"], asked["behind"] - 1 + F.when(m.mark.isin(*VERSIONS), BEHIND).otherwise(0)) & F.array_contains(F.concat(asked.needs, asked.bars), m.mark)
    needed, barred = F.array_contains("needs", F.col("mark")), F.array_contains("bars", F.col("mark"))
    met = asked.join(m, here).groupBy(*span).agg(F.count_distinct(F.when(needed, F.col("mark"))).alias("held"), F.max(barred).alias("barred"), F.first(F.size("needs")).alias("asked"))
    return plain.unionByName(met.where("held = asked and not barred").select("doc_id", "h", "label")).distinct()


def license_scan(docs: DataFrame, known: list[tuple[int, str, str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    known = known or templates()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    hits = written(votes(slim, known), "hits")
    found = written(spans(hits), "spans")
    exact = F.col("exact") > 0
    base = (F.col("kind") == "base") & exact
    close = (F.col("cover") >= COVER) & (F.col("behind") - F.col("first") <= STRETCH * (F.col("grams") + K - 1))
    verified = F.when(F.col("kind") == "identifier", exact).otherwise(close)
    named = told(found.where(verified), hits.where("mark is not null").select("doc_id", "h", "mark", "at").distinct()).select(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h"), F.col("label").alias("t_label"))
    found = found.join(named, found.doc_id.eqNullSafe(named.t_id) & (found.h == named.t_h) & (found.label == named.t_label), "left").withColumn("told", F.col("t_h").isNotNull())
    of_doc = found.groupBy("doc_id", "h").agg(
        F.sum(F.when(base, F.col("exact")).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("exact_first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("exact_last"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(base, F.col("label"))))).alias("base_labels"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(base | F.col("told"), F.col("label"))))).alias("labels"),
        F.max("cover").alias("score"),
    )
    of_doc = of_doc.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), *of_doc.columns[2:])
    every = slim.select("doc_id", "h", F.size(folded_words_column(F.col("text"))).cast("long").alias("n_words"))
    met = every.join(of_doc, every.doc_id.eqNullSafe(of_doc.r_id) & every.h.eqNullSafe(of_doc.r_h), "left")
    return met.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
