"""Licence scans: phrases, and an exact containment join of text blocks with licence templates, in DataFrame functions only.

Words are runs of digits, letters a to z (A to Z in lower case) and characters beyond ASCII. Texts and templates are
compared by their runs of three words. A block is BLOCK consecutive ones, and a block begins every BLOCK / 2, so that each
run of BLOCK / 2 lies in one whole. A block meets a template if it holds at least THRESHOLD of the template's. A template
that a block holds in part gives way to one that has at least half of it in common (as licences of a family have) and of
which the block holds more.

The join: the templates' runs of words are ordered by the number of texts of the corpus that hold them, rarest first. A
block that has need = ceil(THRESHOLD * size) of a template has one of the template's first size - need + 1. Only such
pairs are joined (prefix filter), where the block has at least need runs of templates (length filter) and those left after
the common one in both orders suffice (positional filter); their overlap is then counted. What is broadcast and sent to
the driver is one row for each run of three words of the templates.

Null text counts as empty: no words, no labels, score 0. Rows alike in doc_id and text share a result, and each is
returned. Null doc_ids stay null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole_text

#: Phrases and labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words that a lower-cased text must hold to have a phrase.
HINTS = ("license", "cc")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 512
THRESHOLD = 0.8
SHINGLE = 3

#: Labels and wording of well-known licence texts and notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "All rights reserved"),
)


def template_runs(text: str) -> list[str]:
    """The template's distinct runs of words."""
    import re

    words = re.findall("[0-9a-z]+", text.lower())
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def related(sets: list[list[str]]) -> list[list[int]]:
    """For each template those that have at least half of it in common."""
    return [[j for j, u in enumerate(sets) if j != i and 2 * len(set(t) & set(u)) >= len(t)] for i, t in enumerate(sets)]


def words_of(text: Column) -> Column:
    """The words. lower() takes the Kelvin sign and the dotted capital I to ASCII letters, so these are put aside first."""
    ascii_safe = F.replace(F.replace(text, F.lit("K"), F.lit("")), F.lit("İ"), F.lit(""))
    return F.array_remove(F.split(F.lower(ascii_safe), SEPARATORS), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def runs_of(words: Column) -> Column:
    """The runs of SHINGLE words in order."""
    at = F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - (SHINGLE - 1)))
    return F.transform(at, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, SHINGLE)]))


def blocks_of(runs: Column, block: int = BLOCK) -> Column:
    step = block // 2
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(runs) - step) / F.lit(step)).cast("int")))
    return F.transform(starts, lambda i: F.slice(runs, i * step + 1, block))


def run_order(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' runs by the number of texts(runs) that hold them, then by themselves. At most one row for each comes to the driver."""
    held = texts.select(F.explode(F.array_distinct(F.filter("runs", lambda r: r.isin(vocabulary)))).alias("run")).groupBy("run").count()
    found = {r["run"]: r["count"] for r in held.collect()}
    return sorted(vocabulary, key=lambda r: (found.get(r, 0), r))


def containment_join(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, block_no, label, containment of every block and template that meet the threshold and aren't given up for a related one. docs: doc_id, text_key, words."""
    sets = [template_runs(text) for _, text in templates]
    if max(map(len, sets)) > block // 2:
        raise ValueError("a template is longer than half a block")
    vocabulary, kin = sorted({r for runs in sets for r in runs}), related(sets)
    texts = docs.select("doc_id", "text_key", runs_of(F.col("words")).alias("runs"))
    order = run_order(texts, vocabulary)
    rank = {r: i for i, r in enumerate(order)}
    index, keys, least = [], {}, len(order)
    for k, (label, _) in enumerate(templates):
        runs = sorted(sets[k], key=rank.__getitem__)
        need = math.ceil(threshold * len(runs) - 1e-9)
        least = min(least, need)
        for at, r in enumerate(runs[: len(runs) - need + 1]):
            keys[r] = None
            index.append((r, at, need, k, label, runs))
    prefix = docs.sparkSession.createDataFrame(index, "run string, at int, need int, k int, label string, template array<string>")
    # a filter would be pushed below the projection and make the runs anew for each of their words
    some = F.when(F.exists("runs", lambda r: r.isin(list(keys))), blocks_of(F.col("runs"), block)).otherwise(F.array().cast("array<array<string>>"))
    blocks = texts.select("doc_id", "text_key", F.posexplode(some).alias("block_no", "block"))
    own = blocks.select("doc_id", "text_key", "block_no", F.array_intersect(_strings(order), "block").alias("own")).where(F.size("own") >= least)
    pairs = own.withColumn("run", F.explode(F.filter("own", lambda r: r.isin(list(keys))))).join(F.broadcast(prefix), "run")
    place = F.array_position("own", F.col("run")).cast("int")
    before, after = F.least(place - 1, F.col("at")), F.least(F.size("own") - place, F.size("template") - F.col("at") - 1)
    pairs = pairs.where((F.size("own") >= F.col("need")) & (before + 1 + after >= F.col("need")))
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("template", "own"))).where(F.col("overlap") >= F.col("need"))
    # at most one entry for each template
    hits = pairs.groupBy("doc_id", "text_key", "block_no").agg(F.collect_set(F.struct("k", "label", "overlap", F.size("template").alias("size"))).alias("hits"))
    kinds = F.array(*[F.array(*map(F.lit, own)).cast("array<int>") for own in kin])
    beaten = lambda t: F.exists("hits", lambda u: (u.overlap > t.overlap) & F.array_contains(F.get(kinds, t.k), u.k))
    left = hits.select("doc_id", "text_key", "block_no", F.explode(F.filter("hits", lambda t: (t.overlap == t["size"]) | ~beaten(t))).alias("h"))
    return left.select("doc_id", "text_key", "block_no", "h.label", (F.col("h.overlap") / F.col("h.size")).alias("containment"))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == p)
        return same

    return F.filter(at, here)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    keyed = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text", words_of(F.col("text")).alias("words"))
    found = containment_join(keyed.select("doc_id", "text_key", "words"), templates, threshold, block)
    found = found.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))

    low = F.lower("text")
    hinted = (low.contains(HINTS[0]) | low.contains(HINTS[1])) & (F.size("words") >= 4)
    short = (low.contains(HINTS[0]) | low.contains(HINTS[1])) & (F.size("words") >= 2)
    none = F.array().cast("array<int>")
    places = [F.when(hinted if len(p.split()) > 2 else short, _places(F.col("words"), p)).otherwise(none).alias(f"at_{i}") for i, (p, _) in enumerate(PHRASES)]
    base = keyed.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), *places)
    every = F.concat(*[F.col(f"at_{i}") for i in range(len(PHRASES))])
    labelled = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)])))
    base = base.select("doc_id", "text_key", "n_words", every.alias("every"), labelled.alias("base"))
    both = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.text_key") == F.col("f.text_key")), "left")
    return both.select(
        F.col("b.doc_id").alias("doc_id"),
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def scan_sql(templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> str:
    """The same by brute force: every block against every template."""
    sets = [template_runs(text) for _, text in templates]
    rows = ", ".join(f"({i}, '{label}', [{', '.join(repr(r) for r in sets[i])}], {kin}::INT[])" for i, ((label, _), kin) in enumerate(zip(templates, related(sets))))
    step = block // 2
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    templates(k, label, ws, kin) AS (VALUES {rows}),
    phrases(phrase, label, n) AS (VALUES {phrases}),
    runs AS (SELECT r, CASE WHEN len(w) < {SHINGLE} THEN []::VARCHAR[] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END AS g FROM t),
    starts AS (SELECT r, g, unnest(range(0, 1 + greatest(0, CAST(ceil((len(g) - {step}) / {step}.0) AS BIGINT)))) AS b FROM runs),
    blocks AS (SELECT r, b, list_distinct(g[b * {step} + 1 : b * {step} + {block}]) AS ws FROM starts),
    held AS (SELECT r, b, k, label, kin, len(templates.ws) AS size, len(list_intersect(templates.ws, blocks.ws)) AS n FROM blocks, templates),
    hits AS (SELECT * FROM held WHERE n >= ceil({threshold} * size - 1e-9)),
    method AS (SELECT r, list(DISTINCT label) AS ls, max(n / size) AS best FROM hits x
               WHERE n = size OR NOT EXISTS (SELECT 1 FROM hits y WHERE y.r = x.r AND y.b = x.b AND y.n > x.n AND list_contains(x.kin, y.k)) GROUP BY r),
    places AS (SELECT r, phrase, label, i - 1 AS place FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t) x, phrases
               WHERE w[i] = split_part(phrase, ' ', 1) AND array_to_string(w[i : i + n - 1], ' ') = phrase),
    base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS z, list(DISTINCT label) AS ls FROM places GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
      coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(method.ls, [])))), ','), '') AS labels,
      CAST(greatest(coalesce(best, 0), CASE WHEN n > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS score
    FROM t LEFT JOIN method USING (r) LEFT JOIN base USING (r)"""
