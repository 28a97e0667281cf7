"""Licence scans: lines, runs of lines and whole texts against licence templates by the Dice coefficient of word bigrams.

A notice of several lines inside a longer document is met by runs of lines that are about as long as the template. That
is dear, so it is done for documents only that hold as many of the templates' bigrams as any match must have; which is
exact, as a coefficient of t with n bigrams takes at least n * t / (2 - t) of them.

All of it is one projection of built-in expressions: no shuffle, no join and no Python, whatever the corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Templates of more words than this are looked for in runs of lines.
RUN_WORDS = 30

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_WARRANTY = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this {}. If not, see https://www.gnu.org/licenses/."
_GPL_TERMS = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."

#: Notices and texts by which licences are commonly stated.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL_TERMS.format("program", "General Public License", "3")),
    ("ISC", _ISC_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", _GRANT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", f"{_GRANT} {_AS_IS}"),
    ("MIT", f"MIT License {_GRANT} {_AS_IS}"),
    ("ISC", f"{_ISC_GRANT} {_ISC_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_AS_IS}"),
    ("GPL-3.0", f"{_GPL_TERMS.format('program', 'General Public License', '3')} {_WARRANTY.format('program', 'General Public License', 'General Public License', 'program')}"),
    ("GPL-2.0", f"{_GPL_TERMS.format('program', 'General Public License', '2')} {_WARRANTY.format('program', 'General Public License', 'General Public License', 'program')}"),
    ("LGPL-3.0", f"{_GPL_TERMS.format('library', 'Lesser General Public License', '3')} {_WARRANTY.format('library', 'Lesser General Public License', 'Lesser General Public License', 'library')}"),
    ("AGPL-3.0", f"{_GPL_TERMS.format('program', 'Affero General Public License', '3')} {_WARRANTY.format('program', 'Affero General Public License', 'Affero General Public License', 'program')}"),
]


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, threshold: float) -> tuple[float, float]:
    """A set of n bigrams can only have a Dice coefficient of ``threshold`` with one of ``size`` if low <= n <= high."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def _literal(templates: list[tuple[str, str]], threshold: float, least: int = 0) -> str:
    """Templates of more than ``least`` words as a SQL array of structs; text is made of a-z, 0-9 and spaces only."""
    rows = []
    for i, (_, text) in enumerate(templates):
        grams, words = template_bigrams(text), len(template_words(text))
        low, high = size_bounds(len(grams), threshold)
        if words > least:
            rows.append(f"named_struct('i', {i}, 'n', {len(grams)}, 'w', {words}, 'low', {low!r}D, 'high', {high!r}D, 'g', array({', '.join(repr(g) for g in grams)}))")
    return f"array({', '.join(rows)})"


def _grams(w: str) -> str:
    return f"if(size({w}) < 2, cast(array() AS array<string>), array_distinct(zip_with(slice({w}, 1, size({w}) - 1), slice({w}, 2, size({w}) - 1), (a, b) -> concat(a, ' ', b))))"


def _runs(templates: list[tuple[str, str]], threshold: float) -> str:
    """SQL of the runs of lines compared with each long template: structs (dice, -template, -first line, -lines).

    From each line that shares a bigram with the template two runs start: the shortest of as many words as it has, and
    that without its last line; runs of one line are left to the lines. x is (j, w): number and words of a line with any.
    """
    one = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"  # noqa: E731  a value for a name
    reach = "aggregate(slice(full, k + 1, t.w), named_struct('n', 0, 's', 0), (a, x) -> if(a.s >= t.w, a, named_struct('n', a.n + 1, 's', a.s + size(x.w)))).n"
    found = f"named_struct('dice', if(size(g) >= t.low AND size(g) <= t.high, 2.0D * size(array_intersect(g, t.g)) / (size(g) + t.n), 0.0D), 'i', -t.i, 'u', -full[k].j, 'm', -(full[k + m - 1].j - full[k].j + 1))"
    run = f"transform(filter(array(r, r - 1), m -> m > 1), m -> {one(one('flatten(transform(slice(full, k + 1, m), x -> x.w))', 'v', _grams('v')), 'g', found)})"
    starts = f"filter(sequence(0, size(full) - 1), k -> arrays_overlap({_grams('full[k].w')}, t.g))"
    of = f"flatten(transform({starts}, k -> {one(reach, 'r', run)}))"
    enough = f"size(array_intersect(element_at(grams, -1), t.g)) >= t.low"
    each = f"flatten(transform(filter({_literal(templates, threshold, RUN_WORDS)}, t -> {enough}), t -> {of}))"
    return one("filter(transform(words, (w, j) -> named_struct('j', j, 'w', w)), x -> size(x.w) > 0)", "full", each)


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, license, dice, unit, n_lines, n_matches) for each row of ``docs``.

    Units are the lines of the text, numbered from 0; the whole text (unit -1) if it has several lines; and for each
    template of more than RUN_WORDS words, from each line that shares a bigram with it, the shortest run of lines of at
    least as many words, and that run without its last line that has words. A unit is normalised to words of a-z and
    0-9, A-Z lower-cased, and matches a template if the Dice coefficient of their sets of word bigrams is at least
    ``threshold``; templates whose size excludes that are not compared. license, dice, unit (a run's first line) and
    n_lines are those of the best match: the highest coefficient, then the earliest template, then the earliest unit,
    then the fewest lines. n_matches counts matching (unit, template) pairs.

    Without a match license, dice, unit and n_lines are null and n_matches is 0; so it is for a null, empty or one-word
    text. Repeated rows and null keys come out as they come in; an empty table gives an empty one. Other columns are not
    read.
    """
    names = "array(" + ", ".join(repr(n) for n, _ in templates) + ")"
    long = [t for _, t in templates if len(template_words(t)) > RUN_WORDS]
    steps = docs.select(F.col(key).alias("k"), F.expr(f"split(lower(regexp_replace(coalesce(cast(`{text}` AS string), ''), '[^A-Za-z0-9\\n]+', ' ')), '\\n')").alias("lines"))
    steps = steps.select("k", F.expr("transform(lines, l -> filter(split(l, ' '), w -> w <> ''))").alias("words"))
    steps = steps.select("k", "words", F.expr("size(words)").alias("n"), F.expr("if(size(words) > 1, concat(words, array(flatten(words))), words)").alias("units"))
    steps = steps.select("k", "words", "n", F.expr(f"transform(units, w -> {_grams('w')})").alias("grams"))
    near = f"filter({_literal(templates, threshold)}, t -> size(g) >= t.low AND size(g) <= t.high)"
    dice = "2.0D * size(array_intersect(g, t.g)) / (size(g) + t.n)"
    alone = f"flatten(transform(grams, (g, u) -> transform({near}, t -> named_struct('dice', {dice}, 'i', -t.i, 'u', -u, 'm', if(u = n, -n, -1)))))"
    runs = "cast(array() AS array<struct<dice:double,i:int,u:int,m:int>>)"
    if long:
        known = ", ".join(repr(g) for g in sorted({g for t in long for g in template_bigrams(t)}))
        least = min(size_bounds(len(template_bigrams(t)), threshold)[0] for t in long)
        runs = f"if(n > 1 AND size(filter(element_at(grams, -1), g -> g IN ({known}))) >= {least!r}D, {_runs(templates, threshold)}, {runs})"
    steps = steps.select("k", "n", F.expr(alone).alias("alone"), F.expr(runs).alias("runs"))
    steps = steps.select("k", "n", F.expr(f"filter(concat(alone, runs), m -> m.dice >= {threshold!r}D)").alias("found"))
    steps = steps.select("k", "n", F.expr("array_max(found)").alias("best"), F.expr("cast(size(found) AS bigint)").alias("n_matches"))
    unit = F.expr("cast(if(-best.u = n, -1, -best.u) AS int)")
    return steps.select(F.col("k").alias(key), F.expr(f"if(best IS NULL, NULL, get({names}, -best.i))").alias("license"), F.col("best.dice").alias("dice"), unit.alias("unit"), F.expr("cast(-best.m AS int)").alias("n_lines"), "n_matches")


def oracle(threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL for license_scan over documents."""
    rows = ", ".join(f"({i}, {name!r}, {len(template_words(text))}, [{', '.join(repr(g) for g in template_bigrams(text))}])" for i, (name, text) in enumerate(templates))
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
        WITH t(i, license, n_words, g) AS (VALUES {rows}),
        d AS (SELECT row_number() OVER () AS r, doc_id, string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n]+', ' ', 'g')), chr(10)) AS lines FROM documents),
        l AS (SELECT r, list_filter(string_split(lines[j], ' '), lambda x: x <> '') AS w, (j - 1)::INTEGER AS line FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS j FROM d)),
        f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY line) AS k, {grams.format('w')} AS g FROM l WHERE len(w) > 0),
        s AS (SELECT DISTINCT r, k, i, n_words FROM (SELECT r, k, unnest(g) AS x FROM f) JOIN (SELECT i, n_words, unnest(g) AS x FROM t WHERE n_words > {RUN_WORDS}) USING (x)),
        c AS (SELECT s.r, s.k, s.i, s.n_words, f.k AS e, sum(len(w)) OVER (PARTITION BY s.r, s.k, s.i ORDER BY f.k) AS total FROM s JOIN f ON f.r = s.r AND f.k >= s.k AND f.k < s.k + s.n_words),
        o AS (SELECT r, k, i, coalesce(min(e) FILTER (total >= n_words), max(e)) AS e FROM c GROUP BY r, k, i),
        v AS (SELECT r, k, i, e FROM o UNION ALL SELECT r, k, i, e - 1 FROM o),
        rw AS (SELECT v.r, v.k, v.i, v.e, flatten(list(f.w ORDER BY f.k)) AS w, min(line) AS unit, (max(line) - min(line) + 1)::INTEGER AS n_lines
               FROM v JOIN f ON f.r = v.r AND f.k BETWEEN v.k AND v.e WHERE v.e > v.k GROUP BY v.r, v.k, v.i, v.e),
        u AS (SELECT r, w, line AS unit, 1 AS n_lines, NULL::INTEGER AS for_i FROM l
              UNION ALL SELECT r, list_filter(string_split(array_to_string(lines, ' '), ' '), lambda x: x <> ''), -1, len(lines)::INTEGER, NULL FROM d WHERE len(lines) > 1
              UNION ALL SELECT r, w, unit, n_lines, i FROM rw),
        g AS (SELECT r, unit, n_lines, for_i, {grams.format('w')} AS g FROM u WHERE len(w) > 1),
        m AS (SELECT r, unit, n_lines, i, license, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g JOIN t
              ON len(g.g) BETWEEN len(t.g) * {threshold!r} / {2 - threshold!r} - 1 AND len(t.g) * {2 - threshold!r} / {threshold!r} + 1 AND coalesce(for_i, i) = i),
        b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, i, CASE WHEN unit = -1 THEN 1 ELSE 0 END, unit, n_lines) AS place, count(*) OVER (PARTITION BY r) AS n
              FROM m WHERE dice >= {threshold!r}::DOUBLE)
        SELECT d.doc_id, b.license, b.dice, b.unit, b.n_lines, coalesce(b.n, 0)::BIGINT AS n_matches FROM d LEFT JOIN b ON d.r = b.r AND b.place = 1"""
