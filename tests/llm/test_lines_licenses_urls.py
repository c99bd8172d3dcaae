"""The native operators: odd rows, and brute force where SQL does not reach."""

from collections import Counter

from allelegate.llm import licenses, line_dedup, url_rules
from allelegate.llm.queries import URL_RULES


def dedup_rows():
    rows = [(i, f"menu\nonly {i}\n\nmenu", "a") for i in range(30)]
    rows += [(100 + i, "copy\ncopied line", "a") for i in range(40)]
    rows += [(200, None, "a"), (201, "", "a"), (202, "menu", "a"), (203, "menu\nx", None), (204, "menu\nx", "b"), (None, "menu", "a")]
    return rows


def test_lines(spark):
    """More than 8 % of a host's different texts, and at least 4; copies of a page count once."""
    docs = spark.createDataFrame([(*r, 9, "h") for r in dedup_rows()], "doc_id long, text string, source string, n_lines long, _host string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[3]["text"] == "only 3\n" and (got[3]["n_lines"], got[3]["n_dropped"]) == (4, 2)
    assert got[105]["text"] == "copy\ncopied line"
    assert got[200]["text"] is None and got[200]["n_lines"] == 0
    assert got[201]["text"] == "" and got[202]["text"] == "" and got[203]["text"] == got[204]["text"] == "menu\nx"
    assert got[None]["text"] == ""
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_every_known_sentence_has_a_cue_and_is_normal(spark):
    rows = spark.createDataFrame([(i, s) for i, s in licenses.SENTENCES.items()], "i int, s string")
    bad = rows.where(~rows.s.rlike(licenses.CUES) | (licenses.normalised(rows.s) != rows.s)).collect()
    assert not bad


def test_licenses(spark):
    mit = (
        "Copyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated"
        ' documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\n"
        "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\n"
        'copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED,'
        " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    )
    rows = [
        (1, None), (2, ""), (3, "x\nReleased under the MIT License."), (4, "Prose here. Licensed under CC BY-NC 4.0. All rights reserved."),
        (5, mit), (6, "the license of all rights"), (7, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
        (8, "y " * 40_000 + "\nLicensed under the Apache License, Version 2.0."), (9, '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.'),
    ]
    docs = spark.createDataFrame([(*r, "z") for r in [*rows, rows[2]]], "doc_id long, text string, licenses string")
    got = Counter((r["doc_id"], r["licenses"], r["kinds"]) for r in licenses.scanned(docs).collect())
    want = {1: "", 2: "", 3: "mit", 4: "all-rights-reserved,cc-by-nc-4.0", 5: "mit", 6: "", 7: "", 8: "apache-2.0", 9: "apache-2.0"}
    assert {k[0]: k[1] for k in got} == want
    assert got[3, "mit", "permissive"] == 2
    assert licenses.scanned(docs.limit(0)).count() == 0


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def judge(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    urls = [None, "", "no host", "http://", "http://?q=1", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/x?y#z", "http://a.example.com/en/", "http://notexample.com/en/",
            "http://com/x", "http://com", "x://a.net/es/1", "x://a.net/fr", "x://a.net/fr/", "http://a.org://b.net/es/", "http://É.com/\nx", "http://a.com#/en/", "http://u@h.com:80/a"]
    urls += [f"http://s{i % 3}.spam.net/es/{i}" for i in range(40)] + [f"http://s{i % 3}.good.com/de/{i}" for i in range(60)] + ["http://s1.spam.org/q", "http://s1.good.org/q", "http://s1.good.org/q"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.judged(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = split(u)
        verdict, rule = judge(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict or rule is None
    assert [got[len(urls) - k]["verdict"] for k in (3, 2, 1)] == ["block", "allow", "allow"]
    assert got[0]["verdict"] == got[1]["verdict"] == "allow" and got[0]["mined_rule"] is None


def test_mined_rules_are_the_frequent_confident_ones(spark):
    """Confidence and support of every mined rule, counted by hand."""
    baskets = [(["a", "b"], "block")] * 9 + [(["a"], "allow")] * 8 + [(["b", "c"], "allow")] + [(["c"], "allow")] * 6
    rows = spark.createDataFrame(baskets, "_tokens array<string>, _verdict string")
    got = {(tuple(sorted(r["antecedent"])), r["verdict"]): (round(r["confidence"], 6), round(r["support"], 6)) for r in url_rules.mined(rows).collect()}
    assert got == {(("a", "b"), "block"): (1.0, 0.375), (("b",), "block"): (0.9, 0.375), (("c",), "allow"): (1.0, round(7 / 24, 6))}


def test_urls_of_an_empty_table(spark):
    assert url_rules.judged(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_licenses_of_mixed_documents(spark):
    """What either cut finds counts, and a contained rule that also stands elsewhere."""
    mit = "\n".join(licenses.SENTENCES[i].replace(" software ", " software\n", 1).capitalize() + "." for i in (4, 5, 6))
    gpl = "This work is licensed under the GNU General\nPublic License version 3."
    bsd = [". ".join(licenses.SENTENCES[i] for i in ids) + ".\n" for ids in ([24, 25, 26], [24, 25, 26, 27])]
    rows = [
        (1, "Licensed under CC BY 4.0\nfurther prose\n\n" + mit, "19,4,5,6", "cc-by-4.0,mit"),
        (2, "All rights reserved\nmore prose\n\n" + gpl, "1,12", "all-rights-reserved,gpl-3.0"),
        (3, gpl + "\n\nAll rights reserved\nmore prose", "12,1", "all-rights-reserved,gpl-3.0"),
        (4, bsd[0] + bsd[1], "24,25,26,24,25,26,27", "bsd-2-clause,bsd-3-clause"),
        (5, bsd[1] + bsd[0], "24,25,26,27,24,25,26", "bsd-2-clause,bsd-3-clause"),
        (6, bsd[1] + bsd[1], "24,25,26,27,24,25,26,27", "bsd-3-clause"),
        (7, "Released under the MIT License.\nReleased under the MIT License.", "2,2", "mit"),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.scanned(docs).collect()}
    assert got == {i: (ids, names) for i, _, ids, names in rows}
