import re

import pytest

from procspark.llm.licenses import PHRASES, TEMPLATES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


ROWS = [
    (1, "Some prose.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."),
    (3, "x y. Licensed under CC BY-NC 4.0. all rights, reserved"), (4, "the mit of the license is under this of that"),
    (5, "General  PUBLIC\nLicense general public license"), (6, None), (7, ""), (8, "Évé 12a b"),
    (9, "so, permission is hereby\n * granted free of charge to any person obtaining one copy of this software and "
        "associated documentation files the software to deal in the software without any restriction"),
    (10, "cc by " * 2000), (10, "All Rights Reserved"), (None, "ACC BYE cc"),
]


def test_base_and_labels(spark):
    df = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, score int")
    got = scan_licenses(df).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(d), *map(str, base(t))) for d, t in ROWS)
    assert sorted((str(r.doc_id), *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)))
                  for r in got) == want
    labels = {(r.doc_id, r.n_words): (r.labels, r.score) for r in got}
    by = {d: x for (d, _), x in labels.items()}
    assert by[1][0] == "mit" and by[2][0] == "apache-2.0" and by[9][0] == "mit" and by[4] == ("", 0.0)
    assert by[3][0] == "cc-by,cc-by-nc,reserved" and by[3][1] == 1.0
    assert by[6] == by[7] == ("", 0.0)
    assert all(0 <= r.score <= 1 for r in got)
    assert scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [0, 3])
def test_every_template_is_found_in_its_own_text(spark, noise):
    rows = [(i, "aaa bbb " * noise + t + " ccc" * noise) for i, (_, t, _) in enumerate(TEMPLATES)]
    got = {r.doc_id: r.labels.split(",") for r in
           scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(TEMPLATES[i][0] in got[i] for i in got)


def test_chunks_without_a_phrase_and_other_text_column(spark):
    """Of the chunks of one batch some have no phrase, so no places at all."""
    long = "plain words only " * 150_000
    rows = [(1, "x", "All rights reserved here"), (2, "x", long), (3, "x", "cc by cc-by"), (4, "x", long), (5, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string").coalesce(1)
    got = {r.doc_id: r for r in scan_licenses(df, "body").collect()}
    assert {d: (r.text, r.n_base, r.first_word, r.last_word) for d, r in got.items()} == {
        1: ("x", 1, 0, 0), 2: ("x", 0, None, None), 3: ("x", 2, 0, 2), 4: ("x", 0, None, None), 5: ("x", 0, None, None)}
    quoted = "filler words " * 30
    one, two = (scan_licenses(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().score for t in (
        quoted + "Permission is hereby granted, free of charge", "Permission is hereby granted, free of charge " + quoted))
    assert one == two
