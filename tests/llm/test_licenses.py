"""Labels of license notices: the specific license comes out, generic notices give way, and prose has none."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import licenses

NOTICES = [
    ("released under the MIT license", {"mit"}),
    ("distributed under the BSD license", {"bsd"}),
    ("available under the Apache License", {"apache"}),
    ("published under the GNU General Public License", {"gpl"}),
    ("licensed under the terms of the MIT license, see the license file", {"mit", "license"}),
    ("available under a very permissive license", {"license"}),
    ("for license information ask us", {"license"}),
    ("GPL-3.0-or-later", {"gpl-3-or-later"}),
    ("GPL-2.0-only", {"gpl-2-only"}),
    ("LGPL version 2.1 or later", {"lgpl-2.1-or-later"}),
    ("LGPL 2.1", {"lgpl-2.1"}),
    ("AGPL v3", {"agpl-3"}),
    ("SPDX: MIT OR Apache-2.0", {"mit", "apache-2-0"}),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2-0"}),
    ("He left the room without permission, and she did too.", set()),
    ("He asked for written permission before the walk.", set()),
    ("No copies may be distributed to others without permission", {"no-redistribution"}),
    ("The licence plate of the car was seen in the file.", set()),
    ("mit or apache 2 0 without a tag", set()),
]


def labels(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: {d["label"] for d in r["detections"]} for r in licenses.scan_licenses(rows).collect()}


def test_notices(spark):
    got = labels(spark, [t for t, _ in NOTICES])
    assert {t: got[i] for i, (t, _) in enumerate(NOTICES)} == dict(NOTICES)


def test_mit_notices_of_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.lower("text").contains("mit license"))
    got = [{d["label"] for d in r["detections"]} for r in licenses.scan_licenses(docs).collect()]
    assert len(got) == 10 and all("mit" in g and "license" not in g for g in got)


@pytest.mark.parametrize("seed", range(3))
def test_generic_notices_give_way_to_all_they_overlap(spark, seed):
    """Spans made up and judged by brute force."""
    r = random.Random(seed)
    rows = []
    for i in range(60):
        dets = [(a := r.randint(0, 60), a + r.randint(1, 12), r.choice((2, 4, licenses.GENERIC, licenses.GENERIC)), k, f"l{k}", 0.5, "w") for k in range(r.randint(0, 12))]
        rows.append((i, dets))
    df = spark.createDataFrame(rows, f"i int, dets array<{licenses.DETECTION}>")
    got = {x["i"]: {d["rule"] for d in x["kept"]} for x in df.select("i", licenses._specific(F.col("dets")).alias("kept")).collect()}
    for i, dets in rows:
        special = [d for d in dets if d[2] != licenses.GENERIC]
        assert got[i] == {d[3] for d in dets if d in special or not any(d[0] < s[1] and s[0] < d[1] for s in special)}
