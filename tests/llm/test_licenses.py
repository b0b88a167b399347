"""Licence scans against a brute-force lookup."""
import re

from llm_cases import SF01, documents
from flowsight.llm import licenses as lc

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, to sub-license it, and to permit persons to do so."""


def slow_canonical(text):
    keep = []
    for line in text.split("\n"):
        bare = re.sub(r"^[^\w©(]+|^\((?!c\))+", "", line, flags=re.I).lower()
        bare = bare.lstrip(" #/*")
        notice = (bare.startswith(("copyright", "(c)", "©")) and ("(c)" in bare or "©" in bare or re.search(r"\d{4}", bare)))
        if not notice and not re.fullmatch(r"all rights reserved\W*", bare):
            keep.append(line)
    words = re.sub(r"[\x00-\x7f]", lambda m: m.group().lower() if m.group().isalnum() else " ", "\n".join(keep))
    words = " ".join(lc.SPELLINGS.get(w, w) for w in re.split("[\\s ·‐-―‘’“”•…﻿]+", words) if w)
    for a, b in sorted(lc.PAIRS.items(), key=lambda x: -len(x[0])):
        words = re.sub(rf"\b{a}\b", b, words)
    return words


def brute(text, known):
    names = lambda t: {n for n, k in known if slow_canonical(t) and slow_canonical(k) == slow_canonical(t)}
    whole = names(text or "")
    lines = set().union(*[names(x) for x in (text or "").split("\n")]) if "\n" in (text or "") else set()
    return sorted(whole) or None, sorted(lines)


def test_equivalent_forms_have_one_digest():
    want = lc.canonical(MIT)
    assert want.startswith("mit license permission is hereby") and "sublicense" in want
    for other in (MIT.upper(), MIT.replace("License", "Licence"), MIT.replace("2020 Somebody", "1999-2024 A, B"),
                  "// " + MIT.replace("\n", "\n// "), MIT.replace("sub-license", "sublicence"),
                  MIT.replace("Copyright (c) 2020 Somebody", "© Else\nAll rights reserved.")):
        assert lc.canonical(other) == want
    assert lc.canonical(MIT + " not") != want
    assert lc.canonical("Copyright 2020 A\n(c) B") == "" and lc.digest("") is None


def test_whole_table_against_brute_force(spark):
    docs = documents(spark, SF01)
    got = {r.doc_id: (r.licences, r.line_licences) for r in lc.scan(docs).collect()}
    canon = {}
    for n, k in lc.NOTICES:
        canon.setdefault(slow_canonical(k), set()).add(n)
    for d in docs.collect():
        whole = canon.get(slow_canonical(d.text))
        lines = set().union(*[canon.get(slow_canonical(x), set()) for x in d.text.split("\n")]) if "\n" in d.text else set()
        assert got[d.doc_id] == (sorted(whole) if whole else None, sorted(lines))
    assert sum(bool(x[1]) for x in got.values()) > 10


def test_own_table_awkward_and_empty(spark, awkward, empty):
    known = [("MIT", MIT), ("X11", MIT.lower()), ("none", ""), (None, "one"), ("n3", "one two three four"), ("one", "ONE!"),
             ("four", "four"), ("null", None)]
    table = spark.createDataFrame(known, "licence string, text string")
    docs = awkward.select("doc_id", "text", "source", "size").unionByName(spark.createDataFrame(
        [(20, "(c) 2001 Me\n" + MIT, "s", 1), (21, "x\nONE.\n", "s", 1)], "doc_id long, text string, source string, size int"))
    named = [(n, k) for n, k in known if n and k]
    got = sorted(((r.doc_id, r.licences, r.line_licences) for r in lc.scan(docs, table).collect()), key=str)
    assert got == sorted(((d.doc_id, *brute(d.text, named)) for d in docs.collect()), key=str)
    assert lc.scan(empty, table).count() == 0
    assert lc.scan(awkward, table.limit(0)).where("licences is not null or size(line_licences) > 0").count() == 0


def test_full_texts_and_notices_of_several_lines(spark):
    """Full licence texts are known, and found inside other text however wrapped."""
    full = dict(reversed(lc.full_texts()))
    apache = dict(lc.HEADERS)["Apache-2.0"]
    wrapped = "\n".join("# " + " ".join(apache.split()[i:i + 5]) for i in range(0, len(apache.split()), 5))
    rows = [(i, "Copyright (c) 2021 Me\n\n" + t) for i, t in enumerate(full.values())]
    rows += [(100, "Some code\n" + full["MIT"] + "\nmore"), (101, "#!/bin/sh\n" + wrapped + "\n\nx=1\n"),
             (102, "MIT License\n\n(c) 2020 A\n\n" + full["MIT"]), (103, "intro\n" + full["MIT"].strip() + " not\nmore"),
             (104, "a\n" + full["BSD-3-Clause"].replace("\n", "\n// ") + "\nb\n" + full["GPL-3.0"] + "\nc")]
    got = {r.doc_id: (r.licences, r.line_licences) for r in lc.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(len(full))] == [[k] for k in full]
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0"} <= set(full)
    assert got[100] == (None, ["MIT"]) and got[102][0] == ["MIT"] and got[103] == (None, [])
    assert got[101] == (None, ["Apache-2.0"])
    assert {"BSD-3-Clause", "GPL-3.0"} <= set(got[104][1])
    short = spark.createDataFrame([("n", "one two"), ("p", "sublicense of it")], "licence string, text string")
    docs = spark.createDataFrame([(1, "x\none\n\ntwo\nthree"), (2, "x\nsub\nlicence of\nit\ny"), (3, "one\ntwos\n")], "doc_id int, text string")
    assert sorted((r.doc_id, r.line_licences) for r in lc.scan(docs, short).collect()) == [(1, ["n"]), (2, ["p"]), (3, [])]
