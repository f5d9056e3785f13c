"""Every notice is named as its own license, also beside notices that share most of their words."""

import pytest

from shelfcast.llm import licenses

FILLER = " ".join(f"f{i}" for i in range(120))


def named(docs):
    out = {}
    for r in licenses.scan_licenses(docs).collect():
        out.setdefault(r.doc_id, set()).add(r.license_id)
    return out


def test_every_notice_is_named_as_its_own(make_docs):
    assert len({k for k, _, _ in licenses.TEMPLATES}) >= 25
    docs = make_docs((i, f"{FILLER}\n{t}\n{FILLER}") for i, (_, t, _) in enumerate(licenses.TEMPLATES))
    assert named(docs) == {i: {k} for i, (k, _, _) in enumerate(licenses.TEMPLATES)}


def test_other_versions_and_names_are_not_taken_for_known_ones(make_docs):
    notices = {k: [t for name, t, _ in licenses.TEMPLATES if name == k and len(t) > 60] for k in ("GPL-3.0", "LGPL-3.0", "Apache-2.0", "MPL-2.0")}
    changed = [
        notices["GPL-3.0"][0].replace("version 3", "version 4"), notices["GPL-3.0"][1].replace("version 3", "version 4"),
        notices["LGPL-3.0"][0].replace("Lesser", "Library"), notices["Apache-2.0"][0].replace("2.0", "1.1"),
        notices["MPL-2.0"][0].replace("2.0", "1.1"), "Licensed under CC BY-NC 3.0.", "Released under the NIT License.",
    ]
    assert named(make_docs(enumerate(f"{FILLER} {t} {FILLER}" for t in changed))) == {}


@pytest.mark.parametrize("wanted", ["GPL-2.0-or-later", "AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "BSD-2-Clause"])
def test_torn_notices_keep_their_name(make_docs, wanted):
    text = next(t for k, t, _ in licenses.TEMPLATES if k == wanted and len(t) > 200)
    torn = text.replace("redistribute it", "share it").replace("in source and", "as source and").upper()
    assert torn != text.upper() and named(make_docs([(1, f"{FILLER} {torn} {FILLER}")])) == {1: {wanted}}


def test_telling_phrases_of_given_templates(spark, make_docs):
    rows = [("one", "a b c d e f g h i j k l", "b c d e f| |x"), ("two", "a b c d e f g h i j k l", None), ("three", "a b c d e f g h i j k l", "not in the template at all")]
    templates = spark.createDataFrame(rows, "license_id string, template string, telling string")
    docs = make_docs([(1, "a b c d e f g h i j k l"), (2, "z a b c X e f g h i j k l m n")])
    found = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(docs, templates, min_containment=0.2).collect()}
    assert found == {(1, "two"), (2, "two")}  # "x" stands alone as a phrase and is in no window
    rows[0] = (*rows[0][:2], "b c d e f| |")
    templates = spark.createDataFrame(rows, "license_id string, template string, telling string")
    found = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(docs, templates, min_containment=0.2).collect()}
    assert found == {(1, "one"), (1, "two"), (2, "two")}
