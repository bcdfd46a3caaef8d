"""Licence scans by a positional rare-token index, in DataFrame functions alone.

A template is a run of words with one mandatory key phrase in it. Document frequencies of the key phrases' words are
counted over the whole corpus, and each template is indexed by the two rarest (highest-IDF) words of its key phrase, with
their offsets. A file's postings are the places of indexed words; a word at place p that a template has at offset o votes
for the start p - o, and starts that both rare words vote for are candidates. A candidate counts if the key phrase
stands there word for word and at least `SHARE` of the template's words stand in their relative places.

As a key phrase holds its own rare words, no place is missed, and which words are rare changes the work, not the result.
All of it happens in array expressions within the row: a file's size or a word's frequency makes no shuffle and no skew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BETWEEN, lower_for_ascii

FOUND = "array<struct<label:string,base:boolean,places:array<struct<start:bigint,share:double>>>>"
#: Least share of a template's words that must stand in place.
SHARE = 0.6
#: Rare words by which a template is indexed.
RARE = 2


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # the mandatory phrase: words[key[0]:key[1]]
    base: bool = False


def template(label: str, text: str, base: bool = False) -> Template:
    """The key phrase stands in brackets; without brackets it is the whole."""
    before, _, rest = text.partition("[") if "[" in text else ("", "", text)
    key, _, after = rest.partition("]")
    b, k, a = before.split(), key.split(), after.split()
    return Template(label, (*b, *k, *a), (len(b), len(b) + len(k)), base)


TEMPLATES = (
    # The base phrases and their labels.
    template("mit", "mit license", True),
    template("apache", "apache license", True),
    template("gpl", "general public license", True),
    # Openings of well-known public licences, and notices that stand for one.
    template("apache-2.0", "licensed under the [apache license version 2 0]"),
    template("apache-text", "you may not use this file except in compliance with the license you may obtain a [copy of the license at http www apache org licenses license 2 0]"),
    template("artistic", "[artistic license]"),
    template("agpl-3.0", "gnu [affero general public license] version 3"),
    template("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    template("bsd-notice", "released under the [bsd license]"),
    template("bsl-1.0", "[boost software license] version 1 0"),
    template("cc0", "[cc0 1 0 universal]"),
    template("cc-by", "[creative commons attribution]"),
    template("cc-by-nc", "licensed under [cc by nc]"),
    template("cc-by-sa", "licensed under [cc by sa]"),
    template("epl", "[eclipse public license]"),
    template("eupl", "[european union public licence]"),
    template("gpl-2.0", "gnu [general public license version 2]"),
    template("gpl-3.0", "gnu [general public license version 3]"),
    template("gpl-text", "this program is [free software you can redistribute it] and or modify it under the terms of the gnu general public license"),
    template("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    template("lgpl", "gnu [lesser general public license]"),
    template("mit-text", "[permission is hereby granted free of charge to any person] obtaining a copy of this software and associated documentation files"),
    template("mpl-2.0", "[mozilla public license] v 2 0"),
    template("unlicense", "this is [free and unencumbered software released into the public domain]"),
    template("zlib", "this software is provided [as is without any express or implied warranty in no event will the authors be held liable] for any damages arising from the use of this software"),
    # Whole texts and notices, without what each user fills in: most of their words must stand.
    template("apache-2.0-notice", """licensed under the apache license version 2 0 the license [you may not use this file except in compliance with the license]
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license
        for the specific language governing permissions and limitations under the license"""),
    template("bsd-2-clause-full", """[redistribution and use in source and binary forms with or without modification are permitted] provided that the following conditions are met
        1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or
        implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event
        shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not
        limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability
        whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
        possibility of such damage"""),
    template("gpl-notice", """this program is free software [you can redistribute it and or modify it under the terms of the gnu general public license] as published by the
        free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be
        useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
        license for more details you should have received a copy of the gnu general public license along with this program"""),
    template("isc-full", """[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted] provided that the above copyright
        notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential
        damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising
        out of or in connection with the use or performance of this software"""),
    template("mit-full", """[permission is hereby granted free of charge to any person obtaining a copy of this software] and associated documentation files the software to deal in
        the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied
        including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
        holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
        software or the use or other dealings in the software"""),
    template("zlib-full", """this software is provided as is [without any express or implied warranty in no event will the authors be held liable] for any damages arising from the
        use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute
        it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original
        software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source
        versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any
        source distribution"""),
)


def words_of(text: Column) -> Column:
    """Split at what ALNUM leaves out, which is several times faster than extracting matches."""
    return F.array_remove(F.split(lower_for_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """Documents that hold each of the words; as many rows as there are words, at most, reach the driver."""
    held = F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(words)))
    return {r["w"]: r["n"] for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def rare_words(t: Template, df: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest words of the key phrase, and their offsets in the template."""
    return sorted(((t.words[k], k) for k in range(*t.key)), key=lambda x: (df.get(x[0], 0), x[1]))[:RARE]


def _array(items: list[str]) -> str:
    return f"array({', '.join(items)})"


def _found(templates: tuple[Template, ...], df: dict[str, int]) -> list[Column]:
    """The templates that count, from the columns `__words` and `__posts`: a lookup per posting, whatever the number of templates.

    The index maps a word to its entries: template, offset, and which of the template's rare words it is. A key phrase of
    one word has that word in both places.
    """
    index: dict[str, list[str]] = {}
    for k, t in enumerate(templates):
        for n, (w, o) in enumerate((rare_words(t, df) * RARE)[:RARE]):
            index.setdefault(w, []).append(f"named_struct('t', {k}, 'o', {o}, 'n', {n})")
    entries = "map(" + ", ".join(f"'{w}', {_array(e)}" for w, e in sorted(index.items())) + ")"
    words = F.expr(_array([_array([f"'{w}'" for w in t.words]) for t in templates]))
    keys = F.expr(_array([f"sequence({t.key[0]}, {t.key[1] - 1})" for t in templates]))
    sizes, labels, bases = (F.expr(_array([f(t) for t in templates])) for f in (lambda t: str(len(t.words)), lambda t: f"'{t.label}'", lambda t: str(t.base).lower()))
    votes = F.flatten(F.transform("__posts", lambda p: F.transform(F.element_at(F.expr(entries), p["w"]), lambda e: F.struct(e["t"].alias("t"), (p["i"] - e["o"]).alias("s"), e["n"].alias("n")))))
    of = lambda n: F.transform(F.filter("__votes", lambda v: v["n"] == n), lambda v: F.struct(v["t"], v["s"]))

    def judged(c: Column) -> Column:
        own = F.get(words, c["t"])
        same = lambda k: F.coalesce(F.get("__words", c["s"] + k) == F.get(own, k), F.lit(False))
        size = F.get(sizes, c["t"])
        agree = F.size(F.filter(F.sequence(F.lit(0), size - 1), same))
        share = F.when(F.forall(F.get(keys, c["t"]), same), agree.cast("double") / size)
        return F.struct(c["t"].alias("t"), (c["s"] + F.get(F.get(keys, c["t"]), F.lit(0))).cast("long").alias("start"), share.alias("share"))

    voted = reduce(F.array_intersect, map(of, range(RARE)))
    counted = F.filter(F.transform(voted, judged), lambda s: F.coalesce(s["share"] >= SHARE, F.lit(False)))
    places = lambda t: F.transform(F.filter("__hits", lambda h: h["t"] == t), lambda h: F.struct(h["start"].alias("start"), h["share"].alias("share")))
    found = F.transform(F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["t"]))), lambda t: F.struct(F.get(labels, t).alias("label"), F.get(bases, t).alias("base"), places(t).alias("places")))
    return [votes, counted, found]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, and `found`: structs (label, base, starts of the key phrase, share of the best).

    A null text is an empty one; texts of any length are scanned whole. Rows are judged each on its own, so repeats come
    back as often as they are and ties between places don't matter: all are returned. An empty table gives an empty one;
    other columns are not read.
    """
    df = frequencies(docs, sorted({t.words[k] for t in templates for k in range(*t.key)}), text_col)
    indexed = sorted({w for t in templates for w, _ in rare_words(t, df)})
    posts = F.filter(F.transform("__words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(indexed))
    held = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("__words")).withColumn("__posts", posts)
    none = F.array().cast(FOUND)
    for name, c in zip(("__votes", "__hits", "__found"), _found(templates, df), strict=True):
        held = held.withColumn(name, c)
    # Most files hold no indexed word.
    return held.select("doc_id", F.size("__words").cast("long").alias("n_words"), F.when(F.size("__posts") > 0, F.col("__found")).otherwise(none).alias("found"))


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns; `scan` says what becomes of odd rows."""
    found = scan(docs)
    base = F.flatten(F.transform(F.filter("found", lambda f: f["base"]), lambda f: F.transform(f["places"], lambda p: p["start"])))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda f: f["label"]))), ",")
    best = F.array_max(F.flatten(F.transform("found", lambda f: F.transform(f["places"], lambda p: p["share"]))))
    return found.withColumn("__base", base).select(
        "doc_id",
        "n_words",
        F.size("__base").cast("long").alias("n_base"),
        F.array_min("__base").alias("first_word"),
        F.array_max("__base").alias("last_word"),
        joined(F.filter("found", lambda f: f["base"])).alias("base_labels"),
        joined("found").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
