from __future__ import annotations

import re

from quern.llm import licenses, queries

from .tables import AWKWARD, clashing, docs_of

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words_of(text)
    places = sorted((k, label) for phrase, label in licenses.BASE for n in [phrase.split()] for k in range(len(w)) if w[k : k + len(n)] == n)
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


PLANTED = [
    (30, "This work is licensed under the GNU General Public License, version 3. All rights\nreserved."),
    (31, "Licensed under CC BY-NC 4.0. cc-by! XCC BY, cc byte; cc  by"),
    (32, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
    (33, "mit freundlichen Grüßen; the ruby gem; all rights reserveds; éall rights reserved"),
    (34, "SPDX-License-Identifier: BSD-3-Clause"),
]


MORE = [
    "gpl-3.0-or-later", "GPLv3 licensed", "GPL v2", "apache-2.0 on its own", "bsd-licensed", "(c) 2020 Foo Inc", "© 2019 Bar", "Copyright (C) 2001, 2004 by Someone",
    "GNU Lesser General Public License, version 2.1", "Mozilla Public License v. 2.0", "https://www.apache.org/licenses/LICENSE-2.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "dedicated to the public domain", "Alle Rechte vorbehalten. Tous droits réservés",
    "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: Foo-9", "for personal use only", "proprietary and confidential", "the 3-clause BSD license", "Licence Ouverte 2.0",
]


def test_rules_are_hundreds_and_gated_by_what_they_need():
    rules = licenses.rules()
    assert len(rules) > 350 and len({(r.form, r.label, r.base) for r in rules}) == len(rules)
    assert sum(r.keyword in licenses.COMMON for r in rules) < 0.05 * len(rules)


def plain(low):
    """Every rule tried on the whole text, then every detection compared with every other."""
    every = [(m.start(), m.end(), r) for r in licenses.rules() for m in r.pattern().finditer(low)]
    every.sort(key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].form))
    kept = []
    for x in every:
        if x[2].base or not any(not y[2].base and y[0] <= x[0] and x[1] <= y[1] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].form))


def test_detections_equal_a_plain_loop_over_all_rules(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + MORE + [t or "" for _, t in AWKWARD + PLANTED] + [" ".join(MORE), "\n".join(MORE * 3)]
    for r in licenses.rules():
        words = re.sub(r"\(\?:([^()|]*)[^()]*\)\??|\[(.)[^]]*\]|[?*+]|\{[^}]*\}", r"\1\2", r.form)
        texts += [words, f"xx {words}, yy", f"{words.replace(' ', '-')}s"]
    found = 0
    for t in texts:
        low = t.lower().encode()
        got = licenses.detect(low)
        assert got == plain(low), t
        found += len(got)
    assert found > 1000


def test_versions_tags_and_copyright_lines_are_told():
    labels = {t: sorted({r.label for _, _, r in licenses.detect(t.lower().encode())}) for t in MORE}
    assert all(labels.values())
    assert labels["gpl-3.0-or-later"] == ["gpl-3.0"] and labels["apache-2.0 on its own"] == ["apache-2.0"] and labels["bsd-licensed"] == ["bsd"]
    assert labels["(c) 2020 Foo Inc"] == labels["© 2019 Bar"] == ["copyright"] and labels["SPDX-License-Identifier: Foo-9"] == ["spdx-tag"]
    assert labels["GNU Lesser General Public License, version 2.1"] == ["gpl", "lgpl-2.1"]  # the base phrase is always told
    assert labels["the 3-clause BSD license"] == ["bsd-3-clause"]


def test_query_equals_brute_force_on_base_columns(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op9_license_scan(spark, sf_dir).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_planted_and_awkward(spark):
    rows = AWKWARD + PLANTED
    got = licenses.scan(clashing(docs_of(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        if i is not None:
            base = [d for d in by[i].detections if d.base]
            assert (by[i].n_words, len(base)) == brute(t)[:2]
    labels = {i: sorted({d.label for d in by[i].detections}) for i, _ in PLANTED}
    assert labels == {30: ["gpl", "gpl-3.0", "reserved"], 31: ["cc-by", "cc-by-nc"], 32: ["apache", "apache-2.0", "mit"], 33: [], 34: ["bsd-3-clause", "spdx-tag"]}
    assert by[1].score == by[33].score == 0 and by[30].score > 0.9
    assert licenses.scan(docs_of(spark, rows).limit(0)).collect() == []
