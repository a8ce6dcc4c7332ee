import random
import re

from tallymill.llm import licenses as L


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base, labels, share = [], set(), 0.0
    own = set()
    for label, is_base, template, phrase in L.TEMPLATES:
        whole, key = template.split(), phrase.split()
        lead = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        for i in range(len(w) - len(key) + 1):
            if w[i : i + len(key)] == key:
                labels.add(label)
                if is_base:
                    base.append(i)
                    own.add(label)
                share = max(share, sum(0 <= i - lead + j < len(w) and w[i - lead + j] == x for j, x in enumerate(whole)) / len(whole))
    return len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), round(share, 6)


def texts():
    rng = random.Random(12)
    pieces = [t[2] for t in L.TEMPLATES] + [t[3] for t in L.TEMPLATES] + ["license", "cc", "by", "all rights", "the of and", "Ünder ß", "x1 2 0", "GNU", "public"]
    out = [None, "", " ,.;", "CC-BY", "cc by", "All Rights Reserved.", "cc cc by by cc by", "ccby cc éby", "the mit\nLICENSE", "Licensed under the Apache License, Version 2.0."]
    for _ in range(300):
        t = rng.choice([" ", "-", ", "]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        out.append(t.title() if rng.random() < 0.5 else t)
    return out + ["cc by " * 3000]


def test_scan_is_the_plain_one(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, labels int")
    for r in L.scan(df).collect():
        assert tuple(r)[1:] == plain(rows[r.doc_id][1]), rows[r.doc_id][1]


def test_index_takes_the_rarest_words():
    index = L.postings({"license": 1000, "general": 3, "public": 900, "cc": 5, "by": 10**6})
    assert (1, 0) in index["general"] and (0, 0) in index["cc"] and (0, 1) in index["by"]
    assert all(len(places) for places in index.values())


def test_odd_tables_and_plan(spark):
    df = spark.createDataFrame([(None, "cc by"), (1, None), (1, None)], "doc_id long, text string")
    got = L.scan(df)
    assert sorted(((r.doc_id, r.n_base) for r in got.collect()), key=str) == [(1, 0), (1, 0), (None, 1)]
    assert L.scan(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_licences_are_known_by_their_own_words(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"
    gpl = "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."
    apache = 'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,'
    texts = [mit, bsd, isc, gpl, apache, "permission is hereby granted to any person", mit + "\n" + bsd]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(df).collect()}
    assert [got[k][0] for k in range(7)] == ["mit", "bsd,bsd-3-clause", "isc", "gpl,gpl-3.0-or-later", "apache-2.0", "", "bsd,bsd-3-clause,mit"]
    assert all(got[k][1] == 1.0 for k in (0, 1, 2, 3, 4)) and got[5][1] == 0.0
