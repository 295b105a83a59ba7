"""License lookup: what canonical forms hold equal, units, and both ways of joining."""

import hashlib
import textwrap

from pyspark.sql import functions as F

from leaselight.llm import licenses


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit string")
    return sorted((r.doc_id, r.unit, r.license_id) for r in licenses.scan(docs, licenses.known_notices(spark), **more).collect())


def test_canonical_equality(spark):
    mit = licenses.known_texts()["MIT.txt"][1]
    rows = [
        (1, "Copyright (c) 2024 Someone\n\n" + mit, "x"),
        (2, mit.upper().replace(",", " ;").replace("\n", "\n * "), "x"),
        (3, mit + "\nand one more condition", "x"),
        (4, mit.replace("sublicense", "sub-license"), "x"),
        (5, "released under the MIT licence", "x"),
        (6, "Some prose.\n-- Licensed under CC BY-NC 4.0 --\nAll rights reserved.\nMore prose.", "x"),
        (6, "Some prose.\n-- Licensed under CC BY-NC 4.0 --\nAll rights reserved.\nMore prose.", "x"),
        (7, "We spoke of how it was licensed under CC BY-NC 4.0.", "x"),
        (8, None, None),
        (9, "", None),
        (10, "***\n(c) 2020\n", None),
        (None, "Released under the MIT License.\n", "x"),
        (11, "word " * 200_000 + "\nReleased under the MIT License.", "x"),
    ]
    want = [(1, "text", "MIT"), (2, "text", "MIT"), (4, "text", "MIT"), (5, "text", "MIT"), (6, "line", "CC-BY-NC-4.0"), (6, "line", "CC-BY-NC-4.0"), (11, "line", "MIT")]
    docs = [r for r in rows if r[0] is not None]
    assert found(spark, docs) == want
    assert found(spark, docs, broadcast_texts=0) == want
    assert licenses.scan(spark.createDataFrame(rows[11:12], "doc_id long, text string, unit string"), licenses.known_notices(spark)).first().license_id == "MIT"


def test_other_scripts_and_word_edges(spark):
    mit = licenses.known_texts()["MIT.txt"][1]
    rows = [
        (1, "许可" * 3000 + "\n" + mit + "\nпункт договора" * 500, "x"),
        (2, "许可 Released under the MIT License.", "x"),
        (3, "Released under the MIT License. 许可", "x"),
        (4, "Released under the MIT licenceé.", "x"),
        (5, "Released under the MIT Licence", "x"),
        (6, mit.replace("Software", "super center"), "x"),
    ]
    assert found(spark, rows) == [(5, "text", "MIT")]
    forms = spark.createDataFrame([("Super center; sub-licence, sub licence (licence licence) favours",)], "t string")
    assert forms.select(licenses.canonical_lines(F.col("t"))).first()[0] == ["super center sublicense sublicense license license favours"]


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))


def test_published_wrappings(spark):
    """Whole texts are known however their lines are cut, with title and copyright statement or without."""
    known = licenses.known_texts()
    rows, want = [], []
    for i, (name, title) in enumerate({"ISC.txt": "ISC License", "MIT.txt": "The MIT License (MIT)", "BSD-3-Clause.txt": "BSD 3-Clause License", "Zlib.txt": "zlib License", "BSD-2-Clause.txt": "BSD 2-Clause License"}.items()):
        for k, width in enumerate((30, 60, 76, 10_000)):
            for j, head in enumerate(("", f"{title}\n\n", f"{title}\n\nCopyright (c) 2021-2024 The Authors <a@b.c>\nAll rights reserved.\n\n", "Copyright 2020 Some Holder and contributors\n\n")):
                rows.append((i * 100 + k * 10 + j, head + wrapped(known[name][1], width), "x"))
                want.append((rows[-1][0], "text", known[name][0]))
    assert found(spark, rows) == sorted(want)


def test_all_known_texts(spark):
    """Each known text is found under its license; the two ways to its form agree."""
    known = list(licenses.known_texts().values())
    assert len({name for name, _ in known}) >= 50
    rows = [(i, text, None) for i, (_, text) in enumerate(known)]
    got = {i: license_id for i, unit, license_id in found(spark, rows) if unit == "text"}
    forms = [licenses.plain_form(text) for _, text in known]
    assert got == {i: min(name for (name, _), form in zip(known, forms) if form == forms[i]) for i in range(len(known))}
    digests = {r.doc_id: r.digest for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, unit string"), licenses.known_notices(spark)).where("unit = 'text'").collect()}
    assert digests == {i: hashlib.sha256(f.encode()).hexdigest() for i, f in enumerate(forms)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert licenses.scan(docs.where(F.lit(False)), licenses.known_notices(spark)).count() == 0
    assert licenses.scan(docs, licenses.known_notices(spark).where(F.lit(False))).count() == 0


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.scan(docs, licenses.known_notices(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
