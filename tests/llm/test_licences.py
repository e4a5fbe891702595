"""Known licence texts are found in full."""

import textwrap

import duckdb
from pyspark.sql import functions as F

from athanor.llm.licence_texts import BOOST, BSD_2, BSD_3, ISC, MIT, MIT_0, UNLICENSE, ZLIB
from athanor.llm.licences import digest, scan_licences
from athanor.llm.queries import ORACLES


def _ids(spark, texts):
    rows = scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [r.license_id for r in rows]


def test_published_texts_are_known(spark):
    from athanor.llm.published_texts import PUBLISHED

    ids = [i for i, _ in PUBLISHED]
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"} <= set(ids)
    assert _ids(spark, [t for _, t in PUBLISHED]) == ids
    assert _ids(spark, ["\n".join(f" * {x}" for x in t.split("\n")) for _, t in PUBLISHED]) == ids
    assert _ids(spark, [t + "\nand more" for _, t in PUBLISHED]) == [None] * len(ids)


def test_known_texts_are_found_at_any_width_and_below_any_statement(spark):
    texts, want = [], []
    heads = ("", "Copyright (c) 2019 A. Holder\n", "Copyright 2019 Andrew Inman\nAll rights reserved.\n", "Copyright Jane Doe\n(c) 2020 The Others\n", "© Someone\nAll Rights Reserved\n")
    for i, t in (("MIT", MIT), ("ISC", ISC), ("BSD-2-Clause", BSD_2), ("BSD-3-Clause", BSD_3), ("Zlib", ZLIB), ("Unlicense", UNLICENSE), ("BSL-1.0", BOOST), ("MIT-0", MIT_0)):
        for width in range(30, 121):
            body = "\n\n".join(textwrap.fill(x, width) for x in t.split("\n\n"))
            head = heads[width % len(heads)]
            texts.append("\n".join(f"// {x}" for x in (head + "\n" + body).split("\n")) if width % 2 else head + "\n" + body)
            want.append(i)
    assert _ids(spark, texts) == want


def test_lists_and_statements_of_published_texts(spark):
    from athanor.llm.published_texts import PUBLISHED

    texts = dict(PUBLISHED)
    moved = texts["Apache-2.0"].replace("      (c) You must retain, in the Source form", "      (c)\n      You must retain, in the Source form")
    assert _ids(spark, [moved, MIT + "\nCopyright laws apply."]) == ["Apache-2.0", None]


def test_statements_are_dropped_alike_in_sql(spark):
    lines = ("Copyright notice", "copyright holders and", "COPYRIGHT 2020 Andrew", "copyright, 2020", "copyright, patent", "Copyright: X", "copyright", "copyrighted by", "copyrights 2", "(c) You", "(c)", "(c) X", "© y", "all rights reserved.", "All Rights Reserved\r", "copyright the\r", "copyright é")
    texts = [f"{mark}{a}\n# {b}" for mark in ("", "// ") for a in lines for b in lines] + [None, "", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r[0] for r in docs.orderBy("doc_id").select(digest(F.col("text"))).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == [r[1] for r in con.execute(ORACLES["op9_licences"] + " ORDER BY 1").fetchall()]
