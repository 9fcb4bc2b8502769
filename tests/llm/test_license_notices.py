"""Notices of one line, alone and inside prose."""

import pytest

from helixframe.llm import licenses

NOTICES = [("All rights reserved.", "Proprietary"), ("Copyright 2020. All rights reserved.", "Proprietary")]
NOTICES += [(f"{mark}SPDX-License-Identifier: {name}{end}", name) for name in licenses._SPDX for mark, end in (("", ""), ("// ", ""), ("# ", "\r"))]
NOTICES += [(t[1], t[0]) for t in licenses.TEMPLATES]


def test_notices(spark):
    prose = "Some words about the weather go here, and many more of them follow. {} The day ended well and everyone went home to sleep."
    texts = [f"first line\n{t}\nlast line" for t, _ in NOTICES] + [prose.format(t) for t, n in NOTICES if t.endswith(".") and "\r" not in t and t.count(". ") == 0]
    names = [n for _, n in NOTICES] + [n for t, n in NOTICES if t.endswith(".") and t.count(". ") == 0]
    files = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r.key: r.license for r in licenses.own_licenses(files).collect()}
    assert [(t, got.get(i)) for i, t in enumerate(texts)] == [(t, n) for t, n in zip(texts, names)]


@pytest.mark.parametrize("text", ["The rights of the people were not the point.", "SPDX-License-Identifier: Zlib", "Wir gehen heute durch den Wald. Mit! Dann kommen wir wieder nach Hause.", "a driving license and an identifier", "The software is free.", "They found it in the source code.", "all rights"])
def test_no_notice(spark, text):
    assert licenses.own_licenses(spark.createDataFrame([(1, text)], "key long, text string")).count() == 0


GNU = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful."
BSD = "Copyright (c) 2010, X. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice."
FILES = [
    (GNU.format("General Public License", 2), "GPL-2.0-or-later"),
    (GNU.format("General Public License", 3), "GPL-3.0-or-later"),
    (GNU.format("Lesser General Public License", "2.1"), "LGPL-2.1-or-later"),
    (GNU.format("Affero General Public License", 3), "AGPL-3.0-or-later"),
    (BSD, "BSD-2-Clause"),
    (BSD + "\n\n3. Neither the name of Foo Corp nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.", "BSD-3-Clause"),
    ("ISC License\n\nCopyright X\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989", "GPL-2.0"),
    ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n", "AGPL-3.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n", "Apache-2.0"),
]


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- "])
def test_headers_and_licence_files(spark, mark):
    texts = [("#!/bin/sh\n" if mark == "# " else "") + "\n".join((mark + x).rstrip() for x in t.split("\n")) for t, _ in FILES]
    files = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r.key: r.license for r in licenses.own_licenses(files).collect()}
    assert [got.get(i) for i in range(len(FILES))] == [n for _, n in FILES]


def test_null_and_repeated_ids_and_long_texts(spark, monkeypatch):
    from helixframe.llm import common

    long_ = "words of the weather and the sea go on. " * 20_000
    rows = [(None, "a/x.c", FILES[0][0]), (None, "a/y.c", "nothing"), (1, "a/LICENSE", FILES[5][0]), (1, "a/b/z.c", "none"), (1, "a/b/c/z.c", FILES[6][0]), (2, "q/r.c", "no"), (3, "a/long", long_ + "\nReleased under the MIT License."), (3, "a/long", long_ + "\nReleased under the MIT License."), (4, None, None), (5, "a/b/d", "")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    want = [(None, "a/x.c", "GPL-2.0-or-later", "header", None), (None, "a/y.c", "BSD-3-Clause", "inherited", "a"), (1, "a/LICENSE", "BSD-3-Clause", "header", None), (1, "a/b/c/z.c", "ISC", "header", None), (1, "a/b/z.c", "BSD-3-Clause", "inherited", "a"), (2, "q/r.c", None, None, None), (3, "a/long", "MIT", "header", None), (3, "a/long", "MIT", "header", None), (4, "", None, None, None), (5, "a/b/d", "BSD-3-Clause", "inherited", "a")]
    for hot in (20_000, 1):
        monkeypatch.setattr(common, "HOT", hot)
        got = licenses.scan(files, "doc_id").collect()
        assert sorted(((r.doc_id, r.path, r.license, r.origin, r.license_dir) for r in got), key=repr) == sorted(want, key=repr)
    assert licenses.scan(files.where("false"), "doc_id").count() == 0
