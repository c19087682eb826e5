"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Terms are the words and word pairs of the templates. How many documents of the whole corpus hold
each term is counted first; rare terms weigh more: idf = ln((N + 1) / (df + 1)) + 1. A header is any
run of as many words as a template has, wherever it begins (a shorter text is one header). Its vector
has the terms it holds, and its other words count in its length as terms that no document holds. A
file's own licence is the template of the header with the highest cosine, if that reaches THRESHOLD.
Templates are notices and whole licence texts, so licence files are compared as files.

Most headers are ruled out without a cosine, and none that could be the best one: a cosine is at most
the length of the template's part on shared terms. Its square is summed over a text's different terms
first, then over the occurrences of each header by running sums.

A licence file (LICENSE, LICENCE, COPYING, NOTICE or UNLICENSE, with any ending) states the licence
of its directory. A file without one of its own takes that of the nearest directory above it that
has one: directories are joined with their ancestors' paths, and the deepest match wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import common

#: Public licence texts and notices by SPDX identifier; fixed values. The conditions come without names and dates.
_ASIS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_HELD = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "MIT": [
        "Released under the MIT License.",
        _MIT,
        _MIT + " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _HELD,
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _HELD,
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _HELD,
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _HELD,
    ],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", f"{_BSD} {_THIRD} {_ASIS}", f"{_BSD} {_THIRD}"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{_BSD} {_ASIS}"],
    "ISC": ["Licensed under the ISC License.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"],
    "0BSD": [f"{_ISC}. {_ISC_END}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Proprietary": ["All rights reserved."],
}
WORD = re.compile(r"[^\W_]+")
LICENSE_FILE = r"(?i)^(un)?licen[sc]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"
THRESHOLD = 0.75


def terms(text: str) -> tuple[Counter, list[str]]:
    words = WORD.findall(text.lower())
    return Counter([*words, *map(" ".join, zip(words, words[1:], strict=False))]), words


class Templates:
    def __init__(self, templates: dict[str, list[str]], df: dict[str, int] | None = None, n: int = 0):
        bodies = [(name, *terms(body)) for name, texts in templates.items() for body in texts]
        self.names, self.lengths = [b[0] for b in bodies], [len(b[2]) for b in bodies]
        self.vocabulary = frozenset(t for _, v, _ in bodies for t in v)
        self.words = {t: i for i, t in enumerate(sorted(t for t in self.vocabulary if " " not in t), 1)}  # 0: none of them
        self.idf = {t: math.log((n + 1) / ((df or {}).get(t, 0) + 1)) + 1 for t in self.vocabulary}
        self.unseen = math.log(n + 1) + 1
        pairs = sorted((self.words[a] * (len(self.words) + 1) + self.words[b], f"{a} {b}") for a, b in (t.split(" ") for t in self.vocabulary if " " in t))
        self.codes = np.array([c for c, _ in pairs], dtype=np.int64)
        self.terms = ["", *self.words, *[t for _, t in pairs]]  # by number: words, then pairs
        place = {t: i for i, t in enumerate(self.terms)}
        self.vectors: list[dict[str, float]] = []
        self.squares = np.zeros((len(bodies), len(self.terms)))  # of the templates' unit vectors
        for i, (_, counts, _) in enumerate(bodies):
            weights = {t: (1 + math.log(c)) * self.idf[t] for t, c in counts.items()}
            length = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / length for t, w in weights.items()})
            for t, w in self.vectors[-1].items():
                self.squares[i, place[t]] = w * w

    def cosine(self, i: int, words: list[str]) -> float:
        """Of template i and a header of these words."""
        known = [w in self.words for w in words]
        pairs = [f"{words[k]} {words[k + 1]}" for k in range(len(words) - 1) if known[k] and known[k + 1]]
        square = dot = 0.0
        for t, c in Counter([*words, *(p for p in pairs if p in self.idf)]).items():
            w = (1 + math.log(c)) * self.idf.get(t, self.unseen)
            square += w * w
            dot += w * self.vectors[i].get(t, 0.0)
        return dot / math.sqrt(square) if square else 0.0

    def numbered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The terms' numbers of the words, and of the pairs that they begin."""
        ids = np.fromiter(map(self.words.get, words, repeat(0)), dtype=np.int64, count=len(words))
        pairs = np.zeros(len(ids), dtype=np.int64)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[both] * (len(self.words) + 1) + ids[both + 1]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        pairs[both] = np.where(self.codes[at] == code, at + 1 + len(self.words), 0)
        return ids, pairs

    def scan(self, text: str | None) -> tuple[str | None, float]:
        """(licence, cosine) of the best header of a whole text; ties go to the first template. Without
        a header that reaches THRESHOLD: (None, 0)."""
        words = WORD.findall((text or "").lower())
        if not words:
            return None, 0.0
        ids, pairs = self.numbered(words)
        held = np.zeros(len(self.terms), dtype=bool)
        held[ids] = held[pairs] = True
        least = THRESHOLD**2 - 1e-9
        found, best = None, 0.0
        for i in np.flatnonzero(self.squares[:, held].sum(axis=1) >= least).tolist():
            m = min(self.lengths[i], len(words))
            ends = [np.append(0.0, np.cumsum(self.squares[i][x])) for x in (ids, pairs)]
            first = np.arange(len(words) - m + 1)
            bound = ends[0][first + m] - ends[0][first] + ends[1][first + m - 1] - ends[1][first]
            some = np.flatnonzero(bound >= max(least, best * best - 1e-9))
            for k in some[np.argsort(-bound[some], kind="stable")].tolist():
                if best >= 1 - 1e-9 or bound[k] < best * best - 1e-9:
                    break
                cosine = self.cosine(i, words[k : k + m])
                if cosine >= THRESHOLD and cosine > best + 1e-12:
                    found, best = self.names[i], cosine
        return found, min(best, 1.0)


def document_frequencies(files: DataFrame, templates: dict[str, list[str]], text: str) -> tuple[dict[str, int], int]:
    """How many rows of files hold each template term, and how many rows there are."""
    vocabulary = Templates(templates).vocabulary
    words = frozenset(t for t in vocabulary if " " not in t)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = Counter(), 0
        for batch in batches:
            for t in batch.column(0):
                found = WORD.findall((t.as_py() or "").lower())
                df.update(words.intersection(found))
                df.update({p for a, b in zip(found, found[1:], strict=False) if a in words and (p := f"{a} {b}") in vocabulary})
                n += 1
        df["\t"] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df)), pa.array(list(df.values()), pa.int64())], names=["t", "n"])

    got = {r.t: r.n for r in files.select(text).mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop("\t", 0)


def own_licenses(files: DataFrame, path: str, text: str, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """files' other columns but text, and own_license and own_score."""
    df, n = document_frequencies(files, templates, text)
    held = files.sparkSession.sparkContext.broadcast(Templates(templates, df, n))

    @F.arrow_udf("name string, score double")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [held.value.scan(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([round(s, 6) for _, s in found], pa.float64())], names=["name", "score"])

    rows = files.withColumn("__own", scan(F.col(text)))
    return rows.select(*[F.col(f"`{c}`") for c in files.columns if c != text], F.col("__own")["name"].alias("own_license"), F.col("__own")["score"].alias("own_score"))


def licensed(files: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(key, path, own_license, own_score, license, inherited_from) for each row of files.

    A null or empty text has no licence of its own; it can inherit. Texts of any length are read whole.
    Without a licence of its own a row's own_score is 0. A null path inherits nothing.
    Two licence files of a directory: the first by path, then by licence. inherited_from is the
    directory, null for own licences. Repeated rows stay rows of their own. Only key, path and text
    are read.
    """
    p = F.col("path")
    rows = files.select(F.col(key), F.col(path).alias("path"), F.col(text).alias("text"))
    scans = common.written(own_licenses(rows, "path", "text", templates), "own-licences")
    directory = F.regexp_replace(p, "/?[^/]*$", "")
    rows = scans.withColumn("__dir", directory)
    name = F.element_at(F.split(p, "/"), -1)
    stated = rows.where(F.col("own_license").isNotNull() & name.rlike(LICENSE_FILE)).groupBy(F.col("__dir").alias("__at")).agg(F.min(F.struct("path", "own_license"))["own_license"].alias("__stated"))
    # every directory with files, its ancestors, and the deepest that states a licence
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = F.array_distinct(F.concat(F.array(F.lit("")), above))
    places = rows.where(F.col("__dir").isNotNull()).select("__dir").distinct().select("__dir", F.explode(above).alias("__at"))
    nearest = places.join(stated, "__at").groupBy("__dir").agg(F.max(F.struct(F.length("__at").alias("depth"), F.col("__at").alias("at"), F.col("__stated").alias("license"))).alias("__near"))
    out = rows.join(nearest, "__dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select(key, "path", "own_license", "own_score", F.coalesce("own_license", F.col("__near")["license"]).alias("license"), F.when(inherits, F.col("__near")["at"]).alias("inherited_from"))
