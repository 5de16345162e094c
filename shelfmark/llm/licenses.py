"""License scan with a positional index of rare licence words.

Each template, a notice or a whole licence, is a sequence of words. The index
holds the positions of each template's ``rare`` words of highest inverse
frequency over all templates, words of more than half of them left out. In a file, its words are looked up from the
highest inverse frequency down, and each votes for (template, relative
position). A template whose distinct rare words reach half of their weight at
one relative position, give or take ``slack`` words and a tenth of the
template's length, is a candidate, and counts if all its mandatory key phrases
stand there. Repeated words vote once for each template word. Words are compared
after lower-casing A-Z.

Null and empty texts have no words and no labels. One row out for each row in,
repeated and null ids too. Columns other than the id and the text are not read.
An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The phrases of the base scan and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, notice as usually published, key phrases that must be present.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
        "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
        ("permission is hereby granted free of charge", "merge publish distribute sublicense", "fitness for a particular purpose and noninfringement"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in "
        "all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
        "the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or "
        "other tortious action arising out of or in connection with the use or performance of this software",
        ("with or without fee is hereby granted", "other tortious action"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be "
        "liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
        "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
        "software even if advised of the possibility of such damage",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to "
        "anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must "
        "not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not "
        "required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
        "compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
        ("free and unencumbered software", "the detriment of our heirs and successors"),
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2 0", "specific language governing permissions and limitations"),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness "
        "for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        ("gnu general public license", "in the hope that it will be useful"),
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce "
        "display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        ("reproduce display distribute execute and transmit",),
    ),
)


class Index:
    """Postings of the rarest words of each template."""

    def __init__(self, templates=TEMPLATES, rare: int = 16, slack: int = 3):
        self.labels = [t[0] for t in templates]
        self.words = [t[1].split() for t in templates]
        self.keys = [[k.split() for k in t[2]] for t in templates]
        self.drift = [slack + len(ws) // 10 for ws in self.words]
        df = Counter(w for ws in self.words for w in set(ws))
        self.idf = {w: math.log((1 + len(templates)) / n) for w, n in df.items()}
        self.postings = defaultdict(list)
        self.full = []
        for t, ws in enumerate(self.words):
            uncommon = [w for w in set(ws) if 2 * df[w] <= len(templates)]
            chosen = set(sorted(uncommon, key=lambda w: (-self.idf[w], ws.index(w)))[:rare])
            for p, w in enumerate(ws):
                if w in chosen:
                    self.postings[w].append((t, p))
            self.full.append(sum(self.idf[w] for w in chosen))

    def matches(self, ws: list[str]) -> dict[str, float]:
        """Label -> share of the template's words found in place, for each template that is verified."""
        at = defaultdict(list)
        for i, w in enumerate(ws):
            if w in self.postings:
                at[w].append(i)
        votes: dict[int, list[tuple[int, str]]] = defaultdict(list)  # template -> (relative position, word)
        for w in sorted(at, key=lambda w: (-self.idf[w], w)):
            for t, p in self.postings[w]:
                votes[t] += [(i - p, w) for i in at[w]]
        found: dict[str, float] = {}
        for t, cast in votes.items():
            if sum(self.idf[w] for w in {w for _, w in cast}) >= 0.5 * self.full[t] and (share := self.verified(t, sorted(cast), ws)):
                found[self.labels[t]] = max(found.get(self.labels[t], 0.0), share)
        return found

    def verified(self, t: int, cast: list[tuple[int, str]], ws: list[str]) -> float:
        """The best share of the template's words at a relative position where enough rare words meet and all key phrases stand; 0 for none."""
        width, best, first, weight = self.drift[t], 0.0, 0, 0.0
        inside: Counter = Counter()
        tried = -1
        for last, (place, w) in enumerate(cast):
            inside[w] += 1
            weight += self.idf[w] if inside[w] == 1 else 0
            while cast[first][0] < place - width:
                inside[cast[first][1]] -= 1
                weight -= 0 if inside[cast[first][1]] else self.idf[cast[first][1]]
                first += 1
            if weight >= 0.5 * self.full[t] - 1e-9 and cast[first][0] > tried:
                tried = place
                here = ws[max(0, cast[first][0] - width) : place + len(self.words[t]) + width]
                if all(places(here, key) for key in self.keys[t]):
                    wanted = set(self.words[t])
                    best = max(best, len(wanted.intersection(here)) / len(wanted))
        return best


def places(ws: list[str], phrase: list[str]) -> list[int]:
    """Every start at which the phrase's words stand consecutively."""
    n = len(phrase)
    return [i for i, w in enumerate(ws) if w == phrase[0] and ws[i : i + n] == phrase]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []


def scan(text: str | None, index: Index) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    ws = words(text)
    at, base = [], set()
    for phrase, label in BASE.items():
        if found := places(ws, phrase.split()):
            at += found
            base.add(label)
    shares = index.matches(ws)
    score = max([1.0 if base else 0.0, *shares.values()])
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | shares.keys())), score


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_columns(text: Column, templates=TEMPLATES) -> Column:
    """A struct of what the scan finds in a text."""
    index = Index(templates)
    fields = [f.split()[0] for f in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def look(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan(t, index) for t in texts], columns=fields)
        return out.astype({c: "Int64" for c in fields[:4]})

    return look(text)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """For each row: its id, word count, places and labels of licences, and how sure the best one is."""
    return docs.select(F.col(id_col), license_columns(F.col(text_col), templates).alias("found")).select(id_col, "found.*")
