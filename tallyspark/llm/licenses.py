"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

DataFrame functions only. Each line, each paragraph and the whole text is compared with the templates
whose size could reach the wanted similarity; on request also runs of words anywhere in the text, so that
notices over several paragraphs or inside a longer one are found."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence notices as their publishers word them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-line": "Released under the MIT License.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
}
#: Slack of bounds in floating point, so that none cuts off what lies on it.
EDGE = 1e-9
#: What counts as a word's character once letters are lower case.
NOT_WORD = r"(?:[^\p{L}\p{N}.]|\.(?![\p{L}\p{N}]))+"
MATCHES = "array<struct<license:string,dice:double,passage:string>>"


def normal(text: Column) -> Column:
    """Lower case, punctuation and blanks as one blank; dots inside words and versions stay."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words of a normalised text."""
    words = F.split(text, " ")
    n = F.size(words)
    return F.when(n > 1, F.array_distinct(F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(
        F.array().cast("array<string>")
    )


def template_words(text: str) -> list[str]:
    return re.sub(r"(?:[^a-z0-9.]|\.(?![a-z0-9]))+", " ", text.lower()).split()


def template_bigrams(text: str) -> set[str]:
    words = template_words(text)
    return set(map(" ".join, zip(words, words[1:], strict=False)))


def signal_words(templates: dict[str, str], similarity: float) -> list[str]:
    """Words of which any text that similar to a template has one at least.

    Such a text shares at least t/(2-t) of the template's bigrams; whatever is left out of a set of
    more than the rest, one of that set is shared. Words are taken, longest first, until those bigrams are enough."""
    chosen: set[str] = set()
    for text in templates.values():
        pairs = template_bigrams(text)
        spare = len(pairs) - len(pairs) * similarity / (2 - similarity) + EDGE
        words = sorted({w for p in pairs for w in p.split()}, key=lambda w: (w not in chosen, -len(w), w))
        for w in words:
            if len({p for p in pairs if chosen & set(p.split())}) > spare:
                break
            chosen.add(w)
    return sorted(chosen)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def runs(text: Column, sets: dict[str, list[str]], lengths: dict[str, int], similarity: float) -> Column:
    """Matches (license, dice, passage) of runs of words anywhere in a normalised text.

    Only runs that begin and end where a stretch of template pairs begins and ends are compared: moving an end over
    a pair of the template, or away from a foreign one, never lowers the coefficient, so the best run is among them.
    Of runs that overlap, the better one stays (ties: the earlier, then the shorter). A run has at most (2-t)/t times
    the template's words, or is one stretch; longer ones could match only by repeating their own pairs."""
    low, high = similarity / (2 - similarity) - EDGE, (2 - similarity) / similarity + EDGE
    every = sorted({p for pairs in sets.values() for p in pairs})

    def of_template(name: str, words: Column, pairs: Column, hits: Column) -> Column:
        t, most = len(sets[name]), math.floor(lengths[name] * high)
        need = max(1, math.ceil(t * low))
        at = lambda k: F.get(hits, k)["at"]
        numbered = F.transform(hits, lambda h, k: F.struct(k.alias("k"), h["at"].alias("at")))
        # A start is worth a look only if as many hits as are needed follow close enough.
        near = lambda s: at(s["k"] + (need - 1)) - s["at"] + 2 <= max(most, need + 1)
        starts = F.filter(numbered, lambda s: ((s["k"] == 0) | (at(s["k"] - 1) < s["at"] - 1)) & near(s))
        ends = F.filter(numbered, lambda e: (e["k"] == F.size(hits) - 1) | (at(e["k"] + 1) > e["at"] + 1))

        def measured(s: Column, e: Column) -> Column:
            n = F.size(F.array_distinct(F.slice(pairs, s["at"] + 1, e["at"] - s["at"] + 1)))
            shared = F.size(F.array_distinct(F.transform(F.slice(hits, s["k"] + 1, e["k"] - s["k"] + 1), lambda h: h["pair"])))
            return F.struct((-(2 * shared / (n + t))).alias("worse"), s["at"].alias("first"), e["at"].alias("last"))

        def from_start(s: Column, ends: Column) -> Column:
            reach = F.filter(ends, lambda e: (e["k"] - s["k"] >= need - 1) & ((e["at"] - s["at"] + 2 <= most) | (e["at"] - s["at"] == e["k"] - s["k"])))
            return F.filter(F.transform(reach, lambda e: measured(s, e)), lambda m: m["worse"] <= -similarity)

        found = F.flatten(let(ends, lambda ends: F.transform(starts, lambda s: from_start(s, ends))))
        chosen = F.aggregate(
            F.array_sort(found),
            F.array().cast("array<struct<worse:double,first:int,last:int>>"),
            lambda kept, m: F.when(F.exists(kept, lambda x: (x["first"] <= m["last"]) & (m["first"] <= x["last"])), kept).otherwise(F.concat(kept, F.array(m))),
        )
        out = F.transform(chosen, lambda m: F.struct(F.lit(name).alias("license"), (-m["worse"]).alias("dice"), F.array_join(F.slice(words, m["first"] + 1, m["last"] - m["first"] + 2), " ").alias("passage")))
        return F.when(F.size(hits) >= need, out).otherwise(F.array().cast(MATCHES))

    def of_hits(words: Column, pairs: Column, hits: Column) -> Column:
        def own(name: str) -> Column:
            return let(F.filter(hits, lambda h: h["pair"].isin(sets[name])), lambda h: of_template(name, words, pairs, h))

        return F.flatten(F.array(*map(own, sets)))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        hits = lambda pairs: F.filter(F.transform(pairs, lambda p, i: F.when(p.isin(every), F.struct(i.alias("at"), p.alias("pair")))), lambda h: h.isNotNull())
        return let(pairs, lambda pairs: let(hits(pairs), lambda hits: of_hits(words, pairs, hits)))

    return let(F.split(text, " "), of_words)


def scan_licenses(docs: DataFrame, similarity: float = 0.8, templates: dict[str, str] | None = None, inside: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): license (of the best match, ties to the name that
    sorts first; null without a match), dice, n_matches, and matches: array of (license, dice, passage).

    A passage is a line, a paragraph (between blank lines) or the whole text, each at most once, normalised;
    it matches a template at a Dice coefficient of ``similarity`` or more over their distinct word bigrams.
    With ``inside``, the best runs of words anywhere in the text (``runs``) are passages as well, whatever lines and
    paragraphs they cross. Null and empty texts match nothing. Repeated rows are answered each by itself; other columns are not
    read. No shuffle and no join: the templates are constants.

    Pruning is exact: only passages with one of the signal words are compared, and only with templates whose
    size lies within t/(2-t) and (2-t)/t of their own."""
    templates = TEMPLATES if templates is None else templates
    sets = {name: sorted(template_bigrams(text)) for name, text in sorted(templates.items())}
    low, high = similarity / (2 - similarity) - EDGE, (2 - similarity) / similarity + EDGE
    least, most = min(map(len, sets.values())) * low, max(map(len, sets.values())) * high
    signal = r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(w.replace(".", r"\.") for w in signal_words(templates, similarity)) + r")(?![\p{L}\p{N}])"
    text = F.coalesce(F.col("text"), F.lit(""))
    passages = F.array_distinct(F.concat(F.split(text, r"\n"), F.split(text, r"\n[\x20\t\r]*\n"), F.array(text)))
    # Shorter than that many characters has too few words.
    signalled = F.filter(passages, lambda p: (F.length(p) >= int(2 * least)) & p.rlike(signal))
    sized = F.filter(F.transform(F.array_distinct(F.transform(signalled, normal)), lambda p: F.struct(p.alias("passage"), bigrams(p).alias("pairs"))), lambda s: F.size(s["pairs"]).between(least, most))

    def against(s: Column) -> Column:
        found = []
        for name, pairs in sets.items():
            n = F.size(s["pairs"])
            dice = 2 * F.size(F.array_intersect(s["pairs"], F.lit(pairs))) / (n + len(pairs))
            fits = n.between(len(pairs) * low, len(pairs) * high)
            found.append(F.struct(F.lit(name).alias("license"), F.when(fits, dice).alias("dice"), s["passage"].alias("passage")))
        return F.filter(F.array(*found), lambda m: m["dice"] >= similarity)

    matched = F.flatten(F.transform(sized, against))
    if inside:
        lengths = {name: len(template_words(text)) for name, text in templates.items()}
        matched = F.array_distinct(F.concat(matched, runs(normal(text), sets, lengths, similarity)))
    found = docs.select("doc_id", F.when(text.rlike(signal), matched).alias("found"))
    matches = F.array_sort(
        F.coalesce("found", F.array().cast(MATCHES)),
        lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).when(a["passage"] < b["passage"], -1).when(a["passage"] > b["passage"], 1).otherwise(0),
    )
    return found.select("doc_id", matches.alias("matches")).select(
        "doc_id", F.get("matches", F.lit(0))["license"].alias("license"), F.get("matches", F.lit(0))["dice"].alias("dice"), F.size("matches").cast("long").alias("n_matches"), "matches"
    )
