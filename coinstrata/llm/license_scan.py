"""License scan by diagonal voting, in DataFrame functions alone.

Every run of K words of a text (fewer for a shorter phrase) is hashed and joined to the places of that run in templates, a
fixed table of whole license texts and usual statements.  A hit at word p of the text and place t of a template, its words
compared, votes for the diagonal p - t.  Votes are counted with map-side partial aggregation, so a text that repeats a license
costs its own hits and no more.  A diagonal on which all runs of a phrase vote is a place of the phrase.  For templates, each
diagonal is merged with the next SHIFT ones (words left out or put in); a span is verified by its hits that stand in the
template's order, and counts if they cover COVER of the template's words.  More text adds hits and takes none away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinstrata.llm._common import materialize, text_rows

# The phrases whose places are the base, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Statements by which licenses are commonly named or granted, and labels for them.
TEMPLATES = {
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit-notice",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
    files the software to deal in the software without restriction including without limitation the rights to use copy modify
    merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
    furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
    included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
    express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
    noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
    whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
    other dealings in the software""": "mit-full",
    """redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the
    following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and
    the following disclaimer in the documentation and or other materials provided with the distribution""": "bsd-2-clause",
    """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission""": "bsd-3-clause",
    """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
    provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
    the author disclaims all warranties with regard to this software including all implied warranties of merchantability and
    fitness""": "isc-full",
    """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
    you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed
    to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of
    any kind either express or implied see the license for the specific language governing permissions and limitations under
    the license""": "apache-2.0-header",
    """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
    as published by the free software foundation either version 3 of the license or at your option any later version""": "gpl-3.0-or-later",
    """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
    as published by the free software foundation either version 2 of the license or at your option any later version""": "gpl-2.0-or-later",
    """this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty
    of merchantability or fitness for a particular purpose see the gnu general public license for more details""": "gpl-notice",
    """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
    with this file you can obtain one at https mozilla org mpl 2 0""": "mpl-2.0-header",
    """this software is provided as is without any express or implied warranty in no event will the authors be held liable for
    any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
    including commercial applications and to alter it and redistribute it freely subject to the following restrictions""": "zlib",
    """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
    sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
    commercial and by any means""": "unlicense",
    """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
    documentation covered by this license the software to use reproduce display distribute execute and transmit the
    software""": "boost",
}

#: Words of a run.
K = 4
#: Share of a template's words that a span must cover.
COVER = 0.85
#: Diagonals this far apart are of one span.
SHIFT = 2
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), WORD_BREAK), lambda w: w != "")


def runs(phrases: dict[str, str], templates: dict[str, str]) -> list[tuple[str, str, str, int, list[str], int, int]]:
    """template, kind, label, place, run, its number of words, and the template's, of every run of all."""
    out = []
    for kind, table in (("base", phrases), ("more", templates)):
        for text, label in table.items():
            w = text.split()
            k = min(K, len(w))
            out += [(" ".join(w), kind, label, i, w[i : i + k], k, len(w)) for i in range(len(w) - k + 1)]
    return out


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    A null or empty text has no words and no labels (empty strings), score 0.  Ids may be null or repeat: rows with equal
    id and text get equal results.  Other columns are not read; no rows give no rows.  The score is the largest share of
    a phrase's or template's words that one span covers.
    """
    table = runs(phrases or PHRASES, templates or TEMPLATES)
    lengths = sorted({r[5] for r in table})
    least = lengths[0]
    rows = text_rows(docs, id_col, text_col)
    key = F.xxhash64("text").alias("key")
    split = rows.select("doc_id", key, words(F.col("text")).alias("words")).filter(F.size("words") >= least)
    shifted = [F.slice("words", F.lit(i + 1), F.size("words")).alias(f"w{i}") for i in range(K)]
    grams = split.select("doc_id", "key", F.posexplode(F.arrays_zip(*shifted)).alias("word", "g"))
    run = lambda k: [F.col(f"g.w{i}") for i in range(k)]
    # both tables have as many rows as the templates have words
    places = docs.sparkSession.createDataFrame(table, "template string, kind string, label string, place int, run array<string>, k int, length int")
    hashes = F.expr("CASE " + " ".join(f"WHEN k = {k} THEN xxhash64({', '.join(f'run[{i}]' for i in range(k))})" for k in lengths) + " END")
    begins = places.select(F.xxhash64(*[F.col("run")[i] for i in range(least)]).alias("begin")).distinct()
    likely = grams.join(F.broadcast(begins), F.xxhash64(*run(least)) == F.col("begin"), "left_semi")
    each = likely.select("doc_id", "key", "word", "g", F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.xxhash64(*run(k)).alias("hash")) for k in lengths])).alias("h"))
    found = each.join(F.broadcast(places.withColumn("of", hashes)), (F.col("h.hash") == F.col("of")) & (F.col("h.n") == F.col("k"))).filter(F.col("run") == F.slice(F.array(*run(K)), 1, F.col("k")))
    same = ["doc_id", "key", "kind", "template", "label", "length", "k"]
    hits = materialize(found.select(*same, "word", "place").distinct())
    votes = hits.filter("kind = 'base'").groupBy(*same, (F.col("word") - F.col("place")).alias("start")).agg(F.count("*").alias("n"))
    base = votes.filter("n = length - k + 1").select("doc_id", "key", "label", "start", F.lit(1.0).alias("score"), F.lit(True).alias("base"))
    band = hits.filter("kind = 'more'").select("*", F.explode(F.sequence(F.lit(0), F.lit(SHIFT))).alias("off")).withColumn("diagonal", F.col("word") - F.col("place") - F.col("off"))
    at = band.groupBy(*same, "diagonal", "place").agg(F.min("word").alias("word"), F.min("off").alias("off"))
    line = Window.partitionBy(*same, "diagonal").orderBy("place")
    ordered = at.withColumn("before", F.max("word").over(line.rowsBetween(Window.unboundedPreceding, -1))).filter("before IS NULL OR word > before")
    new = F.least(F.col("k"), F.coalesce(F.col("place") - F.lag("place").over(line), F.col("k")))
    spans = ordered.withColumn("new", new).groupBy(*same, "diagonal").agg(F.sum("new").alias("covered"), F.min("off").alias("off"))
    more = spans.filter((F.col("off") == 0) & (F.col("covered") >= F.col("length") * COVER)).select("doc_id", "key", "label", F.lit(None).cast("int").alias("start"), (F.col("covered") / F.col("length")).alias("score"), F.lit(False).alias("base"))
    result = base.union(more).groupBy("doc_id", "key").agg(
        F.count("start").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )
    counts = rows.select("doc_id", key, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = counts.alias("c").join(result.alias("f"), F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("c.key") == F.col("f.key")), "left")
    return joined.select(
        "c.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same rows in SQL."""
    table = runs(PHRASES, TEMPLATES)
    values = ", ".join(f"('{t}', '{kind}', '{label}', {place}, '{' '.join(run)}', {k}, {length})" for t, kind, label, place, run, k, length in table)
    grams = " UNION ALL ".join(f"SELECT doc_id, word, {k} AS k, array_to_string(words[word + 1 : word + {k}], ' ') AS run FROM (SELECT doc_id, words, unnest(range(len(words) - {k - 1})) AS word FROM docs)" for k in sorted({r[5] for r in table}))
    return rf"""
        WITH places(template, kind, label, place, run, k, length) AS (VALUES {values}),
        docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        grams AS ({grams}),
        hits AS (SELECT DISTINCT doc_id, kind, template, label, length, places.k, word, place FROM grams JOIN places ON grams.run = places.run AND grams.k = places.k),
        phrases AS (SELECT doc_id, label, length, k, word - place AS start FROM hits WHERE kind = 'base' GROUP BY doc_id, template, label, length, k, word - place HAVING count(*) = length - k + 1),
        band AS (SELECT *, word - place - off AS diagonal FROM hits, (SELECT unnest(range({SHIFT + 1})) AS off) WHERE kind = 'more'),
        at_place AS (SELECT doc_id, template, label, length, k, diagonal, place, min(word) AS word, min(off) AS off FROM band GROUP BY ALL),
        seen AS (SELECT *, max(word) OVER (PARTITION BY doc_id, template, diagonal ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM at_place),
        ordered AS (SELECT * FROM seen WHERE before IS NULL OR word > before),
        steps AS (SELECT *, least(k, coalesce(place - lag(place) OVER (PARTITION BY doc_id, template, diagonal ORDER BY place), k)) AS new FROM ordered),
        spans AS (SELECT doc_id, label, length, sum(new) AS covered FROM steps GROUP BY doc_id, template, label, length, diagonal HAVING min(off) = 0 AND sum(new) >= length * {COVER}),
        found AS (SELECT doc_id, label, start, 1.0::DOUBLE AS score, TRUE AS base FROM phrases
                  UNION ALL SELECT doc_id, label, NULL, covered::DOUBLE / length, FALSE FROM spans),
        result AS (SELECT doc_id, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY doc_id)
        SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM docs d LEFT JOIN result r ON d.doc_id = r.doc_id"""
