"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised and looked up in a table of known licence sentences; what is found
gives the document's sequence of sentence ids.  A licence rule is an ordered list of ids: it fits if these ids come
in this order, with others allowed between them.  A rule that another fitting rule contains as a part of its
list says less, and is left out, unless it fits more often than that one in hits of their own: then it also stands elsewhere.

Sentences end at line ends and after . ! ? or ;.  A second cut reads the lines between two blank ones as one paragraph, for texts that
are wrapped inside sentences.  What either cut finds counts, in the order of the text; what both find at one place counts once.  Places are
counted in letters a to z and digits, which are the same in both cuts.  Only sentences with one of CUES are looked up; every known sentence has one.

Nulls and odd rows: no text, and a text without a known sentence, has an empty sequence and no licence.
A sentence said again counts again; order is that of the text.  SQL knows neither the merging of the cuts nor the counting of fits: it
takes the longer cut, and leaves a contained rule out everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and their usual notices, already normalised.
SENTENCES = {
    1: "all rights reserved",
    2: "released under the mit license",
    3: "licensed under the mit license",
    4: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    5: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    6: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    7: "licensed under the apache license version 2 0",
    8: "licensed under the apache license version 2 0 the license",
    9: "you may not use this file except in compliance with the license",
    10: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    11: "see the license for the specific language governing permissions and limitations under the license",
    12: "this work is licensed under the gnu general public license version 3",
    13: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    14: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    15: "either version 3 of the license or at your option any later version",
    16: "either version 2 of the license or at your option any later version",
    17: "this program is distributed in the hope that it will be useful but without any warranty",
    18: "licensed under cc by nc 4 0",
    19: "licensed under cc by 4 0",
    20: "licensed under cc by sa 4 0",
    21: "this work is licensed under a creative commons attribution 4 0 international license",
    22: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    23: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    24: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    25: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    26: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    27: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    28: "this source code form is subject to the terms of the mozilla public license v 2 0",
    29: "this is free and unencumbered software released into the public domain",
    30: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    31: "spdx license identifier mit",
    32: "spdx license identifier apache 2 0",
    33: "spdx license identifier gpl 3 0 or later",
    34: "spdx license identifier gpl 3 0 only",
}
# Licences as ordered sentence ids, and what each asks for.
RULES = [
    ("all-rights-reserved", "proprietary", [1]),
    ("mit", "permissive", [2]),
    ("mit", "permissive", [3]),
    ("mit", "permissive", [4, 5, 6]),
    ("mit", "permissive", [31]),
    ("apache-2.0", "permissive", [7]),
    ("apache-2.0", "permissive", [8, 9]),
    ("apache-2.0", "permissive", [8, 9, 10, 11]),
    ("apache-2.0", "permissive", [32]),
    ("gpl-3.0", "copyleft", [12]),
    ("gpl-3.0-or-later", "copyleft", [13]),
    ("gpl-3.0-or-later", "copyleft", [14, 15]),
    ("gpl-3.0-or-later", "copyleft", [33]),
    ("gpl-3.0", "copyleft", [34]),
    ("gpl-2.0-or-later", "copyleft", [14, 16]),
    ("cc-by-nc-4.0", "noncommercial", [18]),
    ("cc-by-nc-4.0", "noncommercial", [22]),
    ("cc-by-4.0", "attribution", [19]),
    ("cc-by-4.0", "attribution", [21]),
    ("cc-by-sa-4.0", "copyleft", [20]),
    ("cc-by-sa-4.0", "copyleft", [23]),
    ("bsd-2-clause", "permissive", [24, 25, 26]),
    ("bsd-3-clause", "permissive", [24, 25, 26, 27]),
    ("mpl-2.0", "copyleft", [28]),
    ("unlicense", "public-domain", [29]),
    ("isc", "permissive", [30, 6]),
    ("isc", "permissive", [30]),
]
CUES = "licen|copyright|reserved|warrant|permission|permitted|redistribut|public domain|at your option"

ENDS = r"([.!?;])[ \t\n\r]+"
GAP = r"\n[ \t\r]*\n"
WRAP = r"[ \t\r]*\n[ \t]*([#*]+|//+)?[ \t]*"


def normalised(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def _known(sentences: Column, table: Column) -> Column:
    """(at, end, id) of the known sentences among all of a text, in order."""
    none = F.array().cast("array<struct<at:int,end:int,id:int>>")

    def step(so_far: Column, sentence: Column) -> Column:
        end = so_far["at"] + F.length(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", ""))
        id = F.when(F.lower(sentence).rlike(CUES), F.element_at(table, normalised(sentence)))
        hit = F.array(F.struct(so_far["at"].alias("at"), end.alias("end"), id.alias("id")))
        return F.struct(end.alias("at"), F.when(id.isNull(), so_far["hits"]).otherwise(F.concat(so_far["hits"], hit)).alias("hits"))

    return F.aggregate(sentences, F.struct(F.lit(0).alias("at"), none.alias("hits")), step, lambda x: x["hits"])


def sentence_ids(text: Column) -> Column:
    """What the two cuts find, in the order of the text."""
    table = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    cut = lambda t: F.split(F.regexp_replace(t, ENDS, "$1\n"), "\n")
    by_line, joined = _known(cut(text), table), _known(cut(F.regexp_replace(F.regexp_replace(text, GAP, ". "), WRAP, " ")), table)
    both = F.transform(F.array_sort(F.array_union(by_line, joined)), lambda hit: hit["id"])
    return F.when(F.lower(text).rlike(CUES), both).otherwise(F.array().cast("array<int>"))


def _inside(small: list[int], large: list[int]) -> bool:
    rest = iter(large)
    return small != large and all(i in rest for i in small)


def _fits(marks: Column, ids: list[int]) -> Column:
    return marks.like("%" + "%".join(f"<{i}>" for i in ids) + "%")


def _times(found: Column, ids: list[int]) -> Column:
    """How many fits of a rule there are that share no hit; its ids are different."""

    def step(open_: Column, id: Column) -> Column:
        # open_[k]: fits that have come as far as their k-th id
        goes = [(id == i) & (F.lit(True) if k == 0 else open_[k - 1] > 0) for k, i in enumerate(ids)]
        left = [*goes[1:], F.lit(False)]
        return F.array(*(open_[k] + goes[k].cast("int") - left[k].cast("int") for k in range(len(ids))))

    return F.aggregate(found, F.array(*(F.lit(0) for _ in ids)), step, lambda x: x[len(ids) - 1])


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, kinds) of every row; the last two are sorted and joined by commas."""
    rows = docs.select(F.col(id).alias("doc_id"), sentence_ids(F.coalesce(F.col(text), F.lit(""))).alias("_ids"))
    marks = F.concat(F.lit(""), F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), ""))
    rows = rows.withColumn("_marks", marks)
    found = []
    for name, kind, ids in RULES:
        over = [larger for _, _, larger in RULES if _inside(ids, larger)]
        fits = _fits(F.col("_marks"), ids)
        for larger in over:
            fits = fits & (~_fits(F.col("_marks"), larger) | (_times(F.col("_ids"), ids) > _times(F.col("_ids"), larger)))
        found.append(F.when(fits, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))))
    hits = F.filter(F.array(*found), lambda r: r.isNotNull())
    rows = rows.withColumn("_hits", F.when(F.size("_ids") == 0, F.array().cast("array<struct<name:string,kind:string>>")).otherwise(hits))
    sort = lambda field: F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda r: r[field]))), ",")
    return rows.select("doc_id", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("sentence_ids"), sort("name").alias("licenses"), sort("kind").alias("kinds"))


def _sql() -> str:
    values = ", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())
    cases = []
    for name, kind, ids in RULES:
        like = lambda x: "marks like '%" + "%".join(f"<{i}>" for i in x) + "%'"
        over = "".join(f" and not {like(larger)}" for _, _, larger in RULES if _inside(ids, larger))
        cases.append(f"select r, '{name}' as name, '{kind}' as kind from m where {like(ids)}{over}")
    cut = lambda t: f"string_split(regexp_replace({t}, '([.!?;])[ \\t\\n\\r]+', '\\1' || chr(10), 'g'), chr(10))"
    wrap = "regexp_replace(regexp_replace(t, '\\n[ \\t\\r]*\\n', '. ', 'g'), '[ \\t\\r]*\\n[ \\t]*([#*]+|//+)?[ \\t]*', ' ', 'g')"
    part = lambda way, source: (
        f"select r, {way} as way, unnest({source}) as s, generate_subscripts({source}, 1) as pos from d"
    )
    return f"""
with known(i, sentence) as (values {values}),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as ({part(0, cut("t"))} union all {part(1, cut(wrap))}),
f as (select s.r, s.way, s.pos, k.i from s join known k
      on k.sentence = trim(regexp_replace(lower(s.s), '[^a-z0-9]+', ' ', 'g'))),
w as (select r, way, count(*) as n, string_agg(i::varchar, ',' order by pos) as ids,
             string_agg('<' || i || '>', '' order by pos) as marks from f group by r, way),
m as (select r, max_by(ids, n * 2 - way) as ids, max_by(marks, n * 2 - way) as marks from w group by r),
h as ({" union all ".join(cases)}),
g as (select r, string_agg(distinct name, ',' order by name) as licenses, string_agg(distinct kind, ',' order by kind) as kinds from h group by r)
select d.doc_id, coalesce(m.ids, '') as sentence_ids, coalesce(g.licenses, '') as licenses, coalesce(g.kinds, '') as kinds
from d left join m on m.r = d.r left join g on g.r = d.r
"""


SQL = _sql()
