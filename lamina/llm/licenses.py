r"""License scans: runs of words against licence templates by Dice over word bigrams.

A text is normalised (A-Z folded, every other run than a-z and 0-9 one blank);
``FORMS`` has several notices a licence and licence texts, cut into passages of
at most ``PASSAGE`` words.  A *window* is a run of words anywhere, across line
ends or amid other words, and its distinct word bigrams are compared with a
passage's: ``2 * shared / (window + passage)``.  At a threshold t the sizes of
a match lie within a factor t / (2 - t) of each other, so a passage is compared
only with windows within that bound.

Most texts never get that far.  A match shares at least t / 2 of the two
sizes' sum, hence a fixed least number of the passage's own bigrams; so for
each passage a few *pivot* words are worked out, without which no window can
reach that number, and a text that holds no pivot anywhere is dropped by one
regular expression before it is split into words.  That loses nothing.  Long
words and numbers make good pivots: prose seldom holds them by accident.

A window begins and ends with a bigram of its passage (more words at its ends
would only lower its Dice) and holds a pivot; so all windows about each pivot
are compared, and none elsewhere.  The best window about each pivot is kept;
of those that overlap the better stays: higher Dice, then more shared bigrams,
then the smaller name.  Everything is SQL functions; a text is read once and
nothing is shuffled.

Defined results: null and blank texts give no rows; repeated rows give
repeated results; null ids stay null; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import table

THRESHOLD = 0.8
TEMPLATES = {
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "This work has been marked as dedicated to the public domain.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved. No part may be reproduced without written permission of the publisher.",
}
#: Words of a passage at most: longer forms are cut.
PASSAGE = 24
_GPL = "under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
#: Notices and texts by licence; what several licences of a family share has the family's name.
FORMS = {k: [v] for k, v in TEMPLATES.items()}
for _name, _more in {
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License v3.0.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "you can redistribute it and/or modify it " + _GPL.format("Affero ", 3),
    ],
    "apache-2.0": [
        "This project is licensed under the Apache License 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0."],
    "cc-by-nc-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "gpl-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "you can redistribute it and/or modify it " + _GPL.format("", 2),
    ],
    "gpl-3.0": [
        "Licensed under the GNU General Public License v3.0.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "you can redistribute it and/or modify it " + _GPL.format("", 3),
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "lgpl-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "you can redistribute it and/or modify it " + _GPL.format("Lesser ", "2.1"),
    ],
    "lgpl-3.0": [
        "Licensed under the GNU Lesser General Public License v3.0.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "you can redistribute it and/or modify it " + _GPL.format("Lesser ", 3),
    ],
    "mit": [
        "Licensed under the MIT License.",
        "This project is released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License 2.0.",
        "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": ["All rights reserved."],
}.items():
    FORMS.setdefault(_name, []).extend(_more)


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text, in order."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def least_shared(size: int, t: float = THRESHOLD) -> int:
    """Bigrams of a template of that size that any match has: reached by the smallest line allowed."""
    return next(s for s in range(1, size + 1) if 2 * s / (s + size) >= t)


def pivots(templates: dict[str, str], t: float = THRESHOLD) -> list[str]:
    """Words of which every line that matches some template has at least one."""
    chosen: set[str] = set()
    for text in templates.values():
        rest = [b for b in bigrams(text) if chosen.isdisjoint(b.split())]
        while len(rest) >= least_shared(len(bigrams(text)), t):
            counts = {w: sum(w in b.split() for b in rest) for b in rest for w in b.split()}
            best = max(counts, key=lambda w: (len(w) > 5 or w.isdigit(), counts[w], len(w), w))
            chosen.add(best)
            rest = [b for b in rest if best not in b.split()]
    return sorted(chosen)


def passages(text: str, most: int = PASSAGE) -> list[str]:
    """A form in pieces of nearly equal length, of at most most words."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    n = -(-len(words) // most)
    return [" ".join(words[len(words) * k // n : len(words) * (k + 1) // n]) for k in range(n)]


def _pieces(forms: dict[str, list[str]]) -> dict[tuple[str, int, int], str]:
    """Passages by licence, form and number."""
    return {(k, i, j): p for k, v in sorted(forms.items()) for i, form in enumerate(v) for j, p in enumerate(passages(form))}


def _let(value: F.Column, f: Callable[[F.Column], F.Column]) -> F.Column:
    """f of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scan(docs: DataFrame, forms: dict[str, list[str]] = FORMS, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no and last_line (from 0), license and dice of every run of words that matches a passage of a form."""
    pieces = _pieces(forms)
    wanted = pivots({str(k): p for k, p in pieces.items()}, threshold)
    bound = threshold / (2 - threshold)
    known = F.array(*[
        F.struct(
            F.lit(k[0]).alias("license"), F.array(*map(F.lit, bigrams(p))).alias("t"), F.array(*[F.lit(w) for w in wanted if w in p.split()]).alias("pivots"),
            F.lit(int((len(p.split()) - 1) / bound + 1e-9)).alias("span"), F.lit(least_shared(len(bigrams(p)), threshold)).alias("least"),
        )
        for k, p in pieces.items()
    ])
    pattern = "(?i)(?<![a-z0-9])(?:" + "|".join(wanted) + ")(?![a-z0-9])"

    def split(line: F.Column) -> F.Column:
        folded = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.array_remove(F.split(F.regexp_replace(folded, "[^a-z0-9]+", " "), " "), "")

    def pairs(w: F.Column) -> F.Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.element_at(w, i + 2)))

    def about(b: F.Column, at: F.Column, x: F.Column) -> F.Column:
        """The best window of bigrams b with word number at, for passage x."""
        near = F.sequence(F.greatest(at - x.span, F.lit(1)), F.least(at + x.span - 1, F.size(b)))

        def score(s: F.Column, e: F.Column) -> F.Column:
            def rate(d: F.Column) -> F.Column:
                return _let(F.size(F.array_intersect(d, x.t)), lambda n: F.struct((-2 * n / (F.size(d) + F.size(x.t))).alias("d"), (-n).alias("n"), x.license.alias("license"), s.alias("s"), e.alias("e")))

            return _let(F.array_distinct(F.slice(b, s, e - s + 1)), rate)

        def windows(hits: F.Column) -> F.Column:
            ends = lambda s: F.filter(hits, lambda e: (e >= s) & (e + 1 >= at) & (e - s < x.span))
            every = F.flatten(F.transform(F.filter(hits, lambda s: s <= at), lambda s: F.transform(ends(s), lambda e: score(s, e))))
            enough = F.size(F.array_distinct(F.transform(hits, lambda k: F.element_at(b, k)))) >= x.least
            return F.when(enough, F.array_min(every))

        return _let(F.filter(near, lambda k: F.array_contains(x.t, F.element_at(b, k))), windows)

    def matches(w: F.Column) -> F.Column:
        def of(b: F.Column) -> F.Column:
            pivot = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i).isin(wanted))
            mine = lambda i: F.filter(known, lambda x: F.array_contains(x.pivots, F.element_at(w, i)))
            found = F.flatten(F.transform(pivot, lambda i: F.transform(mine(i), lambda x: about(b, i, x))))
            return F.array_sort(F.array_distinct(F.filter(found, lambda m: m.d <= -threshold)))

        return F.when(F.size(w) > 1, _let(pairs(w), of))

    def apart(found: F.Column) -> F.Column:
        """Best first, those that share no word with a better one."""
        return F.aggregate(found, F.slice(found, 1, 0), lambda kept, m: F.when(F.exists(kept, lambda k: (k.s <= m.e + 1) & (m.s <= k.e + 1)), kept).otherwise(F.concat(kept, F.array(m))))

    def located(lines: F.Column) -> F.Column:
        line_of = F.flatten(F.transform(lines, lambda x, i: F.array_repeat(i, F.size(x))))
        rows = lambda at, kept: F.transform(kept, lambda m: F.struct(F.element_at(at, m.s).alias("line_no"), F.element_at(at, m.e + 1).alias("last_line"), m.license.alias("license"), (-m.d).alias("dice")))
        return _let(F.flatten(lines), lambda w: _let(matches(w), lambda found: F.when(F.size(found) > 0, _let(line_of, lambda at: rows(at, apart(found))))))

    got = _let(F.transform(F.split(F.col(text), "\n"), split), located)
    rows = docs.where(F.col(text).rlike(pattern)).select(F.col(id_column).alias("doc_id"), F.explode(got).alias("m"))
    return rows.select("doc_id", "m.line_no", "m.last_line", "m.license", "m.dice")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(forms: dict[str, list[str]] = FORMS, threshold: float = THRESHOLD) -> str:
    """The same windows by joins of a text's bigrams with the passages'."""
    pieces = _pieces(forms)
    wanted = pivots({str(k): p for k, p in pieces.items()}, threshold)
    bound = threshold / (2 - threshold)
    listed = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
    rows = ", ".join(
        f"({i}, '{k[0]}', {listed(bigrams(p))}, {listed([w for w in wanted if w in p.split()])}, {int((len(p.split()) - 1) / bound + 1e-9)}, {least_shared(len(bigrams(p)), threshold)})"
        for i, (k, p) in enumerate(pieces.items())
    )
    norm = "regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')"
    return f"""
WITH passages(p, license, t, pivots, span, least) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS d, doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT d, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line FROM d),
lw AS (SELECT d, line_no, list_filter(string_split({norm}, ' '), lambda x: x <> '') AS w FROM l),
wd AS (SELECT d, line_no, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM lw),
w AS (SELECT d, line_no, word, row_number() OVER o AS k, lead(word) OVER o AS after FROM wd WINDOW o AS (PARTITION BY d ORDER BY line_no, i)),
tg AS (SELECT p, unnest(t) AS gram FROM passages),
pw AS (SELECT p, unnest(pivots) AS word FROM passages),
about AS (SELECT w.d, pw.p, w.k AS pivot_at FROM w JOIN pw USING (word)),
g AS (SELECT d, k, word || ' ' || after AS gram FROM w WHERE after IS NOT NULL AND d IN (SELECT d FROM about)),
doc AS (SELECT d, list(gram ORDER BY k) AS grams FROM g GROUP BY d),
hit AS (SELECT g.d, tg.p, g.k, g.gram FROM g JOIN tg USING (gram)),
near AS (SELECT a.d, a.p, a.pivot_at, h.k, h.gram, s.span, s.least FROM about a JOIN passages s USING (p) JOIN hit h ON h.d = a.d AND h.p = a.p AND h.k BETWEEN a.pivot_at - s.span AND a.pivot_at + s.span - 1),
enough AS (SELECT d, p, pivot_at FROM near GROUP BY d, p, pivot_at HAVING count(DISTINCT gram) >= any_value(least)),
cand AS (
  SELECT a.d, a.p, a.pivot_at, a.k AS s, b.k AS e FROM near a JOIN near b ON a.d = b.d AND a.p = b.p AND a.pivot_at = b.pivot_at AND a.k <= a.pivot_at AND b.k >= a.k AND b.k + 1 >= a.pivot_at AND b.k - a.k < a.span
  SEMI JOIN enough x ON a.d = x.d AND a.p = x.p AND a.pivot_at = x.pivot_at
), rated AS (
  SELECT c.*, passages.license, len(list_intersect(list_distinct(grams[s:e]), t)) AS n, len(list_distinct(grams[s:e])) + len(t) AS total FROM cand c JOIN doc USING (d) JOIN passages USING (p)
), best AS (
  SELECT d, min(struct_pack(q := -(2 * n)::DOUBLE / total, n := -n, license := license, s := s, e := e)) AS m FROM rated GROUP BY d, p, pivot_at
), ranked AS (
  SELECT d, list_sort(list(DISTINCT m)) AS found FROM best WHERE m.q <= -{threshold}::DOUBLE GROUP BY d
), apart AS (
  SELECT d, unnest(list_reduce(list_transform(found, lambda m: [m]), lambda kept, y:
    CASE WHEN len(list_filter(kept, lambda k: k.s <= y[1].e + 1 AND y[1].s <= k.e + 1)) > 0 THEN kept ELSE list_concat(kept, y) END)) AS m FROM ranked
)
SELECT d.doc_id, f.line_no::INT AS line_no, z.line_no::INT AS last_line, m.license AS license, -m.q AS dice
FROM apart JOIN d USING (d) JOIN w f ON f.d = apart.d AND f.k = m.s JOIN w z ON z.d = apart.d AND z.k = m.e + 1
"""


ORACLE_SQL = oracle()
