"""Licence scans by a positional rare-token index, with DataFrame functions only.

Every template is a list of words with a mandatory key phrase. One pass counts in how many documents each licence
word occurs. The index posts each template under the rarest (highest-IDF) words of its key phrase, with their places
in it. A file's licence words are looked up; the places they stand at, less their places in the template, are the
starts that they support, and the supports of a template's rarest words are intersected. Each start left is verified:
all words of the key phrase must stand there consecutively. A place's score is the IDF share of the template's words
that stand at their relative places.

The base labels are templates whose key phrase is the whole text, so their places are exact and complete.

Defined results: null or empty text: no words, no places, empty labels, score 0. Repeated rows get equal results. The
other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Base labels and their phrases.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: label: (key phrase, template). Places of these add labels to the base ones.
TEMPLATES = {
    "apache-2.0": ("apache license version 2 0", "licensed under the apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    "cc-by-nc": ("cc by nc", "licensed under cc by nc 4 0"),
    "cc-by-sa": ("cc by sa", "licensed under cc by sa 4 0"),
    "cc0": ("cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    "gpl-notice": ("gnu general public license", "licensed under the gnu general public license version 3"),
    "lgpl": ("lesser general public license", "gnu lesser general public license"),
    "mit": ("mit license", "released under the mit license"),
    "mit-grant": ("permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "mpl-2.0": ("mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    "unlicense": ("released into the public domain", "this is free and unencumbered software released into the public domain"),
}

#: Whole licence texts and standard notices, as words. label: (key phrase, text).
TEXTS = {
    "apache-2.0-notice": (
        "you may not use this file except in compliance with the license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "boost-text": (
        "obtaining a copy of the software and accompanying documentation covered by this license",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is "
        "furnished to do so all subject to the following",
    ),
    "bsd-2-clause-text": (
        "redistributions in binary form must reproduce the above copyright notice",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "bsd-3-clause-text": (
        "may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission this software is provided by the copyright holders and contributors as is",
    ),
    "gpl-3.0-notice": (
        "under the terms of the gnu general public license as published by the free software foundation",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public "
        "license along with this program if not see",
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
        "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    "mit-text": (
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ),
    "unlicense-text": (
        "anyone is free to copy modify publish use compile sell or distribute this software",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code "
        "form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "zlib-text": (
        "in no event will the authors be held liable for any damages arising from the use of this software",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ),
}
RAREST = 2  #: words of each key phrase that the index posts

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words of the text with A-Z in lower case. Other capitals may be lowered too: they are word characters before and
    after, except the two whose lower case is ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(text.rlike("[İK]"), F.translate(text, _LETTERS, _LETTERS.lower())).otherwise(F.lower(text))
    return F.filter(F.split(low, _GAPS), lambda w: w != "")


def _index() -> dict[str, tuple[list[str], list[str], int]]:
    """label: (key words, template words, place of the key in the template)."""
    out = {f"base:{label}": (p.split(), p.split(), 0) for label, p in BASE.items()}
    for label, (key, text) in (TEMPLATES | TEXTS).items():
        k, t = key.split(), text.split()
        out[label] = (k, t, next(i for i in range(len(t)) if t[i : i + len(k)] == k))
    return out


def word_idf(docs: DataFrame) -> dict[str, float]:
    """IDF over all documents of the templates' words (a fixed, small vocabulary)."""
    vocabulary = sorted({w for _, t, _ in _index().values() for w in t})
    seen = docs.select(F.explode(F.array_distinct(F.filter(_words(F.col("text")), lambda w: w.isin(vocabulary)))).alias("w"))
    df = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = docs.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}


def _literal(x: object) -> Column:
    """A literal of lists of equal kinds; dicts are structs."""
    if isinstance(x, list):
        return F.array(*map(_literal, x))
    if isinstance(x, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in x.items()])
    return F.lit(x)


def scan(docs: DataFrame, idf: dict[str, float]) -> DataFrame:
    """docs' doc_id with n_words and places: array of (label, base, start, score), in the order of the templates and starts.

    All templates are looked up together: each posted word that a text has supports (template, start) pairs, equal pairs
    meet by sorting, and those that all posted words of a template support are verified."""
    templates, postings = [], {}
    for t, (label, (key, text, at)) in enumerate(_index().items()):
        rare = sorted(range(len(key)), key=lambda j: (-idf[key[j]], j))[:RAREST]
        total = sum(idf[w] for w in text) or 1.0
        for j in rare:
            postings.setdefault(key[j], []).append({"t": t, "j": j})
        words = [{"w": w, "j": j - at, "share": idf[w] / total} for j, w in enumerate(text)]
        templates.append({"label": label.removeprefix("base:"), "base": label.startswith("base:"), "posted": len(rare), "key": key, "words": words})
    posted = F.create_map(*[x for w, p in postings.items() for x in (F.lit(w), _literal(p))])
    index = _literal(templates)

    words = docs.select("doc_id", _words(F.col("text")).alias("words"))
    # each step is a generator's output, so that no array is worked out again inside a lambda
    step = lambda df, **c: df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))))
    words = step(words, n=F.size("words"))
    found = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", i).isin(list(postings)))
    words = step(words, hits=F.when(F.col("n") > 0, found).otherwise(F.array().cast("array<int>")))
    supports = F.flatten(F.transform("hits", lambda i: F.transform(F.element_at(posted, F.get("words", i)), lambda p: F.struct(p["t"].alias("t"), (i - p["j"]).alias("s")))))
    words = step(words, supports=F.when(F.size("hits") > 0, F.array_sort(supports)).otherwise(F.array().cast("array<struct<t:int,s:int>>")))
    # the last of as many equal pairs as the template has posted words
    ahead = lambda k, need: F.get("supports", k - need + 1) == F.get("supports", k)
    whole = F.transform(F.filter(F.sequence(F.lit(0), F.size("supports") - 1), lambda k: ahead(k, F.get(index, F.get("supports", k)["t"])["posted"])), lambda k: F.get("supports", k))
    words = step(words, starts=F.when(F.size("supports") > 0, whole).otherwise(F.array().cast("array<struct<t:int,s:int>>")))

    def verified(x: Column) -> Column:
        key = F.get(index, x["t"])["key"]
        return (x["s"] >= 0) & (F.slice("words", F.greatest(x["s"], F.lit(0)) + 1, F.size(key)) == key)

    def place(x: Column) -> Column:
        share = F.aggregate(F.get(index, x["t"])["words"], F.lit(0.0), lambda a, w: a + F.when((x["s"] + w["j"] >= 0) & (F.get("words", x["s"] + w["j"]) == w["w"]), w["share"]).otherwise(0.0))
        return F.struct(F.get(index, x["t"])["label"].alias("label"), F.get(index, x["t"])["base"].alias("base"), x["s"].cast("long").alias("start"), F.least(F.lit(1.0), F.round(share, 6)).alias("score"))

    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,score:double>>")
    places = F.when(F.size("starts") > 0, F.transform(F.filter("starts", verified), place)).otherwise(none)
    return step(words, places=places).select("doc_id", F.col("n").cast("long").alias("n_words"), "places")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, word_idf(docs))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    joined = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def _template_rows() -> str:
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return ", ".join(f"('{label.removeprefix('base:')}', {str(label.startswith('base:')).lower()}, {lists(key)}, {lists(text)}, {at})" for label, (key, text, at) in _index().items())


SQL = rf"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), tpl AS (SELECT * FROM (VALUES {_template_rows()}) AS t(label, base, key, words, key_at)
), vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM tpl
), df AS (SELECT word, count(*) AS c FROM (SELECT unnest(list_distinct(w)) AS word FROM dw) JOIN vocabulary USING (word) GROUP BY word
), idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(c, 0) + 0.5)) AS idf FROM vocabulary LEFT JOIN df USING (word)
), starts AS (SELECT doc_id, w, label, base, words, key_at, unnest(list_filter(range(1, len(w) - len(key) + 2), lambda k: list_slice(w, k, k + len(key) - 1) = key)) AS k FROM dw, tpl WHERE list_has_all(w, key)
), each AS (SELECT doc_id, label, base, k, key_at, w, unnest(words) AS word, unnest(range(0, len(words))) AS j FROM starts
), places AS (SELECT doc_id, label, base, k - 1 AS start, least(1.0, round(sum(CASE WHEN k - key_at + j >= 1 AND w[k - key_at + j] = word THEN idf ELSE 0 END) / sum(idf), 6)) AS score
  FROM each JOIN idf USING (word) GROUP BY doc_id, label, base, k, key_at
)
SELECT dw.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(start) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0) AS score
FROM dw LEFT JOIN places USING (doc_id) GROUP BY dw.doc_id
"""
