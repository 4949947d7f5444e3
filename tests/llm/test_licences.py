import textwrap

import duckdb

from presswork.llm import licence_texts, licences
from presswork.llm.oracles import ORACLES
from tests.llm import cases


def scanned(spark, texts, known=None):
    docs = cases.documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    return [
        (r.licence, r.n_notices, r.notices)
        for r in licences.scan(docs, known).orderBy("doc_id").collect()
    ]


def test_equal_up_to_the_normalisation(spark):
    mit = licences.MIT
    texts = [
        mit,
        mit.upper().replace(" ", "  \t").replace("\n", "\r\n\r\n"),
        "Copyright (c) 2024 Some One\n(C) 2023\n  © 1999 x. All rights reserved.\n" + mit,
        mit.replace('"', "“").replace("sublicense", "sub-licence").replace(",", " ,"),
        mit.replace("\n", " "),
        mit + " More.",
        mit.replace("free of charge", "for a charge"),
        licences.ISC,
    ]
    got = [x[0] for x in scanned(spark, texts)]
    assert got == ["MIT", "MIT", "MIT", None, "MIT", None, None, "ISC"]
    # Typographic quotes are letters of other scripts to the normalisation; plain ones are not.
    assert scanned(spark, [mit.replace('"', "'").replace("sublicense", "sub-licence")])[0][0] == "MIT"


def test_notices_in_documents(spark):
    text = "prose\nLicensed under the Apache Licence, Version 2.0.\nmore\nReleased under the MIT License.\n"
    inside = "we are Licensed under the Apache License, Version 2.0."
    assert scanned(spark, [text, inside, "CC-BY 4.0", text + text]) == [
        (None, 2, "Apache-2.0,MIT"),
        (None, 0, None),
        ("CC-BY-4.0", 1, "CC-BY-4.0"),
        (None, 4, "Apache-2.0,MIT"),
    ]


def test_lists_of_the_caller(spark):
    assert scanned(spark, ["House  RULES!", ""], [("house", "house rules"), ("zz", "House-Rules")]) == [
        ("house", 1, "house"),
        (None, 0, None),
    ]
    assert scanned(spark, [None, ""], [("empty", " \n ")]) == [("empty", 1, "empty")] * 2


def test_odd_rows(spark):
    docs = cases.clashing(spark, ["digest", "row", "licence", "lines", "form"])
    got = licences.scan(docs).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((r[0] for r in cases.ROWS), key=repr)
    assert len({r.digest for r in got if r.doc_id in (4, 5, 8)}) == 1
    assert licences.scan(cases.documents(spark, [])).count() == 0


def test_wherever_lines_break(spark):
    texts, want = [], []
    for name, whole in (("MIT", licences.MIT), ("ISC", licences.ISC)):
        for width in range(20, 100, 3):
            for text in (whole, whole.upper()):
                texts.append("\n".join(textwrap.fill(x, width) for x in text.split("\n")))
                want.append(name)
    assert [x[0] for x in scanned(spark, texts)] == want


def test_copyright_statements_and_what_stands_behind_them(spark):
    head, body = licences.MIT.split("\n", 1)
    for line in (
        "Copyright 2020 X", "Copyright © X", "* Copyright (C) X", "Copyright The X Authors",
        "Copyright by X", "© X", "(c) 2020 X", "All Rights Reserved.", "Copyright, 2020, X",
    ):
        assert scanned(spark, [f"{head}\n{line}\n{body}"])[0][0] == "MIT", line
    line = "Copyright 2020 X Co., Ltd. Licensed under the MIT License"
    assert scanned(spark, [f"a\n{line}\nb", "(c) us who do this\n", "copyright law is old"]) == [
        (None, 1, "MIT"),
        (None, 0, None),
        (None, 0, None),
    ]
    with_notice = scanned(spark, [f"{head}\n{line}\n{body}"])[0]
    assert with_notice[0] == "MIT" and with_notice[2] == "MIT"
    kept = [("house", "copyright law is old"), ("c", "(c) us who do this")]
    assert [x[0] for x in scanned(spark, ["Copyright\nlaw is old", "Copyright law\nis old"], kept)] == [
        "house",
        "house",
    ]


def test_whole_texts_of_common_licences(spark):
    mit, isc = licences.MIT.split("\n", 1)[1], licences.ISC.split("\n", 1)[1]
    texts = [("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2015 X Y\n\n" + mit)]
    texts += [("ISC", isc), ("ISC", "The ISC License\n\nCopyright (c) X\n\n" + isc)]
    for name, text in licence_texts.TEXTS.items():
        lines = "\n\n".join(textwrap.fill(" ".join(x.split()), 61) for x in text.split("\n\n"))
        texts += [(name, "Copyright 2020 X\n" + text), (name, text.upper())]
        if name.startswith(("BSD", "Un")):
            texts += [(name, lines), (name, licences.TITLES[name][0] + "\n\n" + text)]
    bsd = licence_texts.TEXTS["BSD-3-Clause"]
    texts += [("BSD-3-Clause", bsd.replace("1.", "*").replace("2.", "*").replace("3.", "*"))]
    apache = licence_texts.TEXTS["Apache-2.0"]
    texts += [("Apache-2.0", apache.split("APPENDIX")[0]), (None, apache.replace("royalty", "royal"))]
    assert [x[0] for x in scanned(spark, [t for _, t in texts])] == [n for n, _ in texts]


def test_sql_states_the_same_rule(spark):
    head, body = licences.MIT.split("\n", 1)
    lines = [
        "Copyright 2020 X", "Copyright © X", "* Copyright (C) X", "Copyright The X Authors", "© X",
        "(c) 2020 X", "All Rights Reserved.", "all rights reserved by us", "copyright law is old",
        "(c) us who do this", "Copyright 2020 X Co., Ltd. Licensed under the MIT License",
        "Copyright yyyy x", "see (c) 2020", "Copyright\tnotices", "copyright ©, 1 x", "COPYRIGHTS 2020",
        "© X. This software is licensed under the Apache License, Version 2.0", "Copyright", "(c)",
    ]
    texts = [f"{head}\n{line}\n{body}" for line in lines] + [f"a\r\n {x}\r\nb" for x in lines]
    texts += ["\n".join(lines), "", None, "CC0\nversion\n1.0", textwrap.fill(licences.ISC, 31)]
    texts += ["Released under the\nMIT License", "Mozilla Public License,\nVersion\n2.0", "“MIT” licence"]
    docs = cases.documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    columns = ["doc_id", "digest", "licence", "n_notices", "notices"]
    want = db.sql(ORACLES["op3_licence_scan"]).select(*columns).fetchall()
    got = [tuple(r) for r in licences.scan(docs).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[2] == "MIT" for r in got) > 8 and sum(r[3] for r in got) > 4
