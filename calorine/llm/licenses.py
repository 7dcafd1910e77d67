"""Licence scans: Dice coefficient over word bigrams against templates, with DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

THRESHOLD = 0.8
#: Licence notices and, where they are short, whole licence texts by public identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under the CC0 1.0 Universal Public Domain Dedication."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def _words(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of bigram sets that can reach the threshold against a template of n bigrams."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def anchors(text: str, threshold: float) -> list[str]:
    """Words of a template, of which any text that reaches the threshold holds one.

    A match shares at least n * threshold / (2 - threshold) of its n bigrams; words
    that together touch more bigrams than may be missing cannot all be absent.
    Longer words, which are rarer, come first.
    """
    grams = _bigrams(text)
    spare = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
    chosen: list[str] = []
    common = {"the", "this", "under", "version", "work", "any", "by", "and", "with", "for", "use", "that", "are"}
    for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in common, -len(w), w)):
        if sum(any(c in g.split() for c in chosen) for g in grams) > spare:
            break
        chosen.append(w)
    return chosen


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_words(text: Column) -> Column:
    """Runs of ASCII letters and digits, after lower-casing A-Z."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^0-9a-z]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    n = F.size(words) - 1
    both = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 0, F.array_distinct(both)).otherwise(F.array().cast("array<string>"))


def _table(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, list[str], list[str], int, int, list[str]]]:
    """(license, words, bigrams, least and greatest size of a set that can match, anchors) of each template."""
    return [(name, _words(t), _bigrams(t), *size_bounds(len(_bigrams(t)), threshold), anchors(t, threshold)) for name, texts in sorted(templates.items()) for t in texts]


#: Windows may begin so many words before their text.
SHIFT = 1 << 20


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each licence that a text holds: doc_id, license, dice, start_word, n_words (of the best place).

    A text is one run of normalised words, so line breaks, comment marks and
    punctuation do not matter, and a notice is found within prose or a longer file.
    Each word of a text that is an anchor of a template puts the template's length
    of words over the text, anchor on anchor; where the distinct bigrams of that
    window are within the bounds on their number, the window is compared. Any text
    that reaches the threshold holds one of the template's anchors, so only words
    moved against all anchors can hide a match. Of the windows of a licence the best
    stays; ties go to the first place, then to the first template. Of licences whose best
    windows overlap, as those of one family do, the better stays (ties go to the first name). Null and empty texts
    match nothing, and an empty table gives an empty result. Repeated rows give repeated
    results; other columns are ignored. All work is per row, so nothing is shuffled; the templates are a literal.
    """
    table = _table(templates or TEMPLATES, threshold)
    places: dict[str, list[int]] = {}
    for no, (_, words, _, _, _, chosen) in enumerate(table):
        for at, w in enumerate(words):
            if w in chosen:
                places.setdefault(w, []).append((no << 40) + SHIFT - at)
    names = sorted(places)
    by_word = F.create_map(*[x for w in names for x in (F.lit(w), F.array(*[F.lit(k).cast("long") for k in places[w]]))])
    infos = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(w)).alias("n"), F.lit(a).alias("low"), F.lit(b).alias("high"), F.array(*[F.lit(x) for x in g]).alias("grams")) for name, w, g, a, b, _ in table])

    def hint(text: Column) -> Column:
        """Whether a lower-cased text holds any of the words: plain searches, for one pattern of all is far slower."""
        out = F.lit(False)
        for w in names:
            out = out | F.contains(text, F.lit(w))
        return out

    def judged(words: Column, code: Column, kinds: Column) -> Column:
        no, start = F.shiftright(code, 40).cast("int"), (code % (1 << 40) - SHIFT).cast("int")
        first = F.greatest(start, F.lit(0))
        return let(F.get(kinds, no), lambda t: let(F.least(start + t["n"], F.size(words)) - first, lambda n: F.when(n > t["low"], let(bigrams(F.slice(words, first + 1, n)), lambda g: F.when(
            F.size(g).between(t["low"], t["high"]), F.struct(t["license"].alias("license"), (-2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"]))).alias("d"), first.alias("start_word"), no.alias("no"), n.alias("n_words"))
        )))))

    def by_score(r: Column) -> Column:
        return F.struct(r["d"].alias("d"), r["start_word"].alias("start_word"), r["no"].alias("no"), r["n_words"].alias("n_words"), r["license"].alias("license"))

    def beats(q: Column, r: Column) -> Column:
        over = (q["start_word"] < r["start_word"] + r["n_words"]) & (r["start_word"] < q["start_word"] + q["n_words"])
        return over & ((q["d"] < r["d"]) | ((q["d"] == r["d"]) & (q["license"] < r["license"])))

    def found(words: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(names))
        codes = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.element_at(by_word, F.get(words, i)), lambda k: k + i))))
        good = F.filter(F.transform(codes, lambda c: judged(words, c, F.col("kinds"))), lambda r: r["d"] <= -threshold)
        best = let(good, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda r: r["license"])), lambda name: F.array_min(F.transform(F.filter(all_, lambda r: r["license"] == name), by_score))))
        return let(best, lambda all_: F.filter(all_, lambda r: ~F.exists(all_, lambda q: beats(q, r))))

    held = F.exists(F.array(F.lower("text")), hint)  # lower-cases once, not once for each word
    slim = docs.select("doc_id", "text").where(held).select("doc_id", normal_words(F.col("text")).alias("words"), infos.alias("kinds")).where(F.size("words") > 1)
    # explode_outer, for explode would have the array computed a second time by a filter on its size.
    rows = slim.select("doc_id", F.explode_outer(found(F.col("words"))).alias("r"))
    return rows.where("r.license is not null").select("doc_id", "r.license", (-F.col("r.d")).alias("dice"), "r.start_word", "r.n_words")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(threshold: float = THRESHOLD) -> str:
    table = _table(TEMPLATES, threshold)
    rows = ", ".join(f"({no}, '{name}', {len(w)}, {a}, {b}, [{', '.join(repr(x) for x in g)}])" for no, (name, w, g, a, b, _) in enumerate(table))
    spots = ", ".join(f"('{w}', {no}, {at})" for no, (_, words, _, _, _, chosen) in enumerate(table) for at, w in enumerate(words) if w in chosen)
    return f"""
with templates(no, license, n, low, high, grams) as (values {rows}), anchors(word, no, spot) as (values {spots}),
texts as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]+'), lambda w: w <> '') as w from documents where text is not null),
hits as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from texts),
starts as (select distinct doc_id, no, i - spot as start from hits join anchors using (word)),
windows as (select doc_id, no, license, low, high, grams, greatest(start, 0) as start_word, w[greatest(start, 0) + 1 : least(start + n, len(w))] as v from starts join templates using (no) join texts using (doc_id)),
sets as (select *, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) as g from windows where len(v) > 1),
scores as (select *, 2 * len(list_intersect(g, grams)) / cast(len(g) + len(grams) as double) as dice from sets where len(g) between low and high),
best as (select doc_id, license, dice, start_word, len(v) as n_words from (select *, row_number() over (partition by doc_id, license order by dice desc, start_word, no) as r from scores where dice >= {threshold}) where r = 1)
select doc_id, license, dice, cast(start_word as integer) as start_word, cast(n_words as integer) as n_words from best r
where not exists (select 1 from best q where q.doc_id = r.doc_id and q.start_word < r.start_word + r.n_words and r.start_word < q.start_word + q.n_words and (q.dice > r.dice or q.dice = r.dice and q.license < r.license))
"""
