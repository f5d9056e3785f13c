"""Disguised addresses of any length, and the verdict of the quality rules over the whole table."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfcast.llm import pii, quality
from shelfcast.llm import queries as Q

# ---------------------------------------------------------------- addresses


def found(text):
    return [(value, text[start:end]) for start, _, end, value, _ in pii.find(text)]


@pytest.mark.parametrize(
    "text, value",
    [
        ("j.o.h.n.s.m [at] example.com", "j.o.h.n.s.m@example.com"),
        ("a.b.c.d.e.f[at]x[dot]com", "a.b.c.d.e.f@x.com"),
        ("x (at) a.b.c.d.e.f.g.h.i", "x@a.b.c.d.e.f.g.h.i"),
        ("u at v dot w dot x dot y dot z dot a dot b dot com", "u@v.w.x.y.z.a.b.com"),
        ("jane_at_example.com", "jane@example.com"),
        ("jane_doe_at_example_dot_com", "jane_doe@example.com"),
        ("JANE {AT} EXAMPLE <DOT> COM", "JANE@EXAMPLE.COM"),
    ],
)
def test_addresses_of_any_length(text, value):
    for around in ("{}", "to {}, or", "é {}\n"):
        assert found(around.format(text)) == [(value, text)]


def test_at_as_a_word_needs_a_disguised_dot():
    for text in ("look at example.com", "we were at home. dot it", "at dot", "a at b", "[at]", "x [at] y", "[at] x.com"):
        assert found(text) == []


LABELS = st.text("ab1", min_size=1, max_size=3)
DOTS = st.sampled_from([".", "[dot]", " dot ", "_dot_", " (.) ", "{ DOT }"])
ATS = st.sampled_from(["[at]", " (at) ", "{@}", "_at_", "< AT >", " @ "])


@settings(max_examples=300, deadline=None)
@given(st.lists(LABELS, min_size=1, max_size=12), st.lists(LABELS, min_size=2, max_size=12), ATS, st.randoms(), DOTS)
def test_disguises_are_undone(local, domain, at, rnd, dot):
    def joined(labels):
        return labels[0] + "".join((dot if rnd.random() < 0.6 else ".") + label for label in labels[1:])

    text = joined(local) + at + joined(domain)
    if at == " @ " and "dot" not in text.lower():
        text += " or x[dot]y"  # nothing else tells that signs are disguised
    assert (".".join(local) + "@" + ".".join(domain)) in [v for v, _ in found(text)]


@pytest.mark.parametrize("text", ["a dot " * 40_000, "a_dot_" * 40_000, "a at b " * 40_000, ("a dot " * 50 + "at ") * 800, "x[at]" + "a." * 100_000, "a." * 100_000 + "[at]b.c", "_" * 300_000, "a[at]" * 50_000])
def test_long_runs_take_linear_time(text):
    begin = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - begin < 10


# ---------------------------------------------------------------- quality


def measures(text, least=quality.MIN_REPEAT_WORDS):
    """(words, covered, longest) by comparing the words with themselves at every distance."""
    words = text.encode().split()
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    cells, n = np.array([ids[w] for w in words], np.int64), len(words)
    covered, longest = np.zeros(n, bool), 0
    for d in range(1, n):
        same = np.concatenate([[0], (cells[d:] == cells[:-d]).astype(np.int8), [0]])
        steps = np.flatnonzero(np.diff(same))
        for begin, end in zip(steps[::2], steps[1::2], strict=True):
            if end - begin >= least:
                longest = max(longest, int(end - begin))
                covered[begin:end] = covered[begin + d : end + d] = True
    return n, int(covered.sum()), longest


def base_failed(text):
    words = text.encode().split()
    seen, twice = {}, set()
    for i in range(len(words) - 2):
        first = seen.setdefault(tuple(words[i : i + 3]), i)
        if first != i:
            twice |= {first, first + 1, first + 2, i, i + 1, i + 2}
    return len(words) < 50 or 100 * len(twice) > 50 * len(words)


def verdict(text):
    n, covered, longest = measures(text)
    return not (base_failed(text) or covered > quality.MAX_COVERED * n or longest > quality.MAX_LONGEST * n or longest > quality.MAX_REPEAT_WORDS)


def test_verdict_over_the_whole_table(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in Q.quality(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        assert (rows[i].base_failed, rows[i].kept) == (base_failed(text), verdict(text)), i


def test_texts_that_only_the_suffix_array_rejects(make_docs):
    unique = [f"w{i}" for i in range(700)]
    pasted = unique[:60]
    often = " ".join(unique[:400] + pasted + unique[400:500] + pasted + unique[500:600] + pasted)
    long_once = " ".join(unique[:300] + unique[:90] + unique[300:400])
    longer = " ".join(unique + unique[100:220] + [f"v{i}" for i in range(2000)])
    fine = " ".join(unique + unique[100:160])
    docs = make_docs([(1, often), (2, long_once), (3, longer), (4, fine), (5, " ".join(unique))])
    found = {r.doc_id: r.quality for r in quality.add_quality(docs).collect()}
    assert not any(q.base_failed for q in found.values())
    assert [i for i, q in sorted(found.items()) if q.kept] == [4, 5]
    for i, text in ((1, often), (2, long_once), (3, longer), (4, fine)):
        assert (found[i].n_words, found[i].repeat_covered, found[i].longest_repeat) == measures(text)
    assert {r.doc_id for r in quality.kept_by_quality(docs, max_covered=1.0, max_longest=1.0, max_repeat_words=10**6).collect()} == {1, 2, 3, 4, 5}


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", max_size=120), st.sampled_from([2, 3, 5]))
def test_measures_equal_brute_force(text, least):
    import pyarrow as pa

    found = quality.repetition(pa.array([text]), least)[0].as_py()
    assert (found["n_words"], found["repeat_covered"], found["longest_repeat"]) == measures(text, least)
