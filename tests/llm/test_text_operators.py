"""Operators that judge documents one by one, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfcast.llm import decontaminate, pii, quality, secrets
from shelfcast.llm import queries as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def digest(rows, kinds):
    text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(rows))
    return hashlib.sha256(text.encode()).hexdigest()


def plain_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    rows = [(m.start(), 0, m.end()) for m in re.finditer(email, text)]
    ip = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    rows += [(m.start(), 1, m.end()) for m in re.finditer(ip, text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0])):
            rows.append((m.start(), 2, m.end()))
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    rows += [(m.start(), 3, m.end()) for m in re.finditer(phone, text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(rows)


def plain_secrets(text):
    keyword = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rows = [(m.start(), 0, m.end()) for m in re.finditer(keyword, text) if len(m[2]) >= 6]
    rows += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(rows + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_pii_query(spark, sf_dir, texts):
    found = {r.doc_id: r for r in Q.pii(spark, sf_dir).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        rows = plain_pii(text)
        counts = Counter(pii.KINDS[k] for _, k, _ in rows)
        assert found[i].base_sha256 == digest(rows, pii.KINDS)
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [counts[k] for k in pii.KINDS]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.2@-+ (5)é9,", max_size=60))
def test_plain_pii_is_leftmost(text):
    assert pii.detect(text) == plain_pii(text)


@pytest.mark.parametrize(
    ("text", "kind", "source", "value"),
    [
        ("write jane [at] example [dot] org now", "email", "jane [at] example [dot] org", "jane@example.org"),
        ("so jane dot doe at mail dot example dot com!", "email", "jane dot doe at mail dot example dot com", "jane.doe@mail.example.com"),
        ("à me@example dot com", "email", "me@example dot com", "me@example.com"),
        ("x jоhn@exаmple.com", "email", "jоhn@exаmple.com", "john@example.com"),
        ("x jоhn@example.com", "email", "jоhn@example.com", "john@example.com"),
        ("call plus four one five five five five one two three four five", "phone", "plus four one five five five five one two three four five", "+41555512345"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１", "4111 1111 1111 1111"),
        ("at 10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1", "10.0.0.1"),
    ],
)
def test_disguises_map_back(text, kind, source, value):
    found = [(pii.KINDS[k], text[s:e], v) for s, k, e, v, hidden in pii.find(text) if hidden]
    assert (kind, source, value) in found


@pytest.mark.parametrize("text", ["look at home.The dog", "un dos tres", "one at a time. Two dots", "naïve – déjà vu · ok"])
def test_prose_has_no_disguises(text):
    assert pii.find(text) == []


def test_long_runs_of_disguised_dots_take_linear_time():
    text = "x_dot_" * 20_000 + " then ann_dot_lee_at_mail_dot_org dot"
    found = pii.find(text)
    assert [(text[s:e], value) for s, _, e, value, _ in found] == [("ann_dot_lee_at_mail_dot_org", "ann.lee@mail.org")]


@pytest.mark.parametrize(
    ("text", "kind", "source", "value"),
    [
        ("host 192.168.one.one", "ip", "192.168.one.one", "192.168.1.1"),
        ("call +1 four one five 555 0199 now", "phone", "+1 four one five 555 0199", "+1 415 555 0199"),
        ("card 4111 1111 1111 111 one.", "card", "4111 1111 1111 111 one", "4111 1111 1111 111 1"),
        ("…NEUF.Fünf.0.1", "ip", "NEUF.Fünf.0.1", "9.5.0.1"),
        ("SİX.0.0.1", "ip", "SİX.0.0.1", "6.0.0.1"),
        ("to ⓙohn@example.com", "email", "ⓙohn@example.com", "john@example.com"),
        ("call +४१ 555 ४५६ 7890", "phone", "+४१ 555 ४५६ 7890", "+41 555 456 7890"),
    ],
)
def test_few_spelled_digits_and_any_script(text, kind, source, value):
    found = [(pii.KINDS[k], text[s:e], v) for s, k, e, v, hidden in pii.find(text) if hidden]
    assert (kind, source, value) in found


MIXED = [*pii.DIGIT_WORDS, *"0123456789", *"٣४４𝟓²ⓙ\u0130ſ…é", *".-+@_ ,()", " at ", " dot ", "[dot]", "(at)", "_dot_", "com", "jane", "plus "]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(MIXED) | st.characters(exclude_categories=["Cs"]), max_size=25))
def test_gate_is_implied_by_the_transducers(parts):
    text = "".join(parts)
    for given_text in (text, text.upper()):
        out = pii.normalise(given_text)
        assert any(pii._hints(given_text)) or out.text == given_text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a1é.​ ", max_size=30), st.randoms())
def test_offsets_survive_edits(text, random):
    out = pii.Normalised(text)
    for _ in range(3):
        cuts = sorted(random.sample(range(len(out.text) + 1), min(4, len(out.text) + 1)))
        out.replace([(a, b, random.choice(["", "x", "yy"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False) if a < b])
    for i, c in enumerate(out.text):
        a, b = out.source(i, i + 1)
        assert 0 <= a < b <= len(text)
        if c not in "xy":
            assert text[a:b] == c


def test_secrets_query(spark, sf_dir, texts):
    kinds = ("assign", "access", "hex")
    found = {r.doc_id: r for r in Q.secret_scan(spark, sf_dir).collect()}
    for i, text in texts.items():
        rows = plain_secrets(text)
        assert found[i].base_sha256 == digest(rows, kinds)
        assert [found[i][f"n_{k}"] for k in kinds] == [sum(x[1] == k for x in rows) for k in range(3)]


SECRETS = [
    'API_Key: "abcdef123"', "tokentoken = x/y+z_1", "passwd=12345", "AKIA" + "A1" * 8, "AKIAAKIA", "é" + "0af" * 9, "f" * 23,
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "toKen:'aaaaaa", "ſecret=abcdefg",
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*SECRETS, " ", "\n", "token", "=", "0", "é"]), max_size=6).map("".join), max_size=5))
def test_index_loses_no_match(rows):
    scan = secrets.SecretScan()
    found = scan.scan(pa.array(rows, pa.string())).to_pylist()
    for text, spans in zip(rows, found, strict=True):
        every = []
        for k, rule in enumerate(scan.rules):
            for m in scan.patterns[k].finditer(text):
                if len(m[rule.group]) >= rule.least:
                    every.append((m.start(), k, m.end()))
        assert [(s["start"], s["kind"], s["end"]) for s in spans] == [(a, scan.rules[k].kind, b) for a, k, b in sorted(every)]


def test_queries_hold_mandatory_trigrams():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets._trigrams(secrets.trigram_query("AKIA[A-Z0-9]+")) == {"aki", "kia"}
    assert secrets.trigram_query("(ab|c)?x*") is True
    kind, _, parts = secrets.trigram_query("(?:abcd|efg)[0-9]+")
    assert (kind, len(parts)) == ("or", 2)


def test_redaction(make_docs):
    docs = make_docs([(1, "a token=abcdef123 b"), (2, None), (3, "clean")])
    found = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert found == {1: "a [SECRET:assign] b", 2: None, 3: "clean"}


def plain_quality(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    symbols = sum(text.count(s) for s in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(covered), repeats(words, 5)


def repeats(words, least):
    """(maximal repeats, words covered, longest) by comparing all pairs of suffixes."""
    n, covered, found = len(words), set(), {}
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                covered |= {*range(i, i + k), *range(j, j + k)}
                if i == 0 or words[i - 1] != words[j - 1]:
                    found[tuple(words[i : i + k])] = k
    return len(found), len(covered), max(found.values(), default=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "#x", "\n"]), max_size=30).map(" ".join), max_size=4))
def test_quality_measures(rows):
    found = quality.repetition(pa.array(rows, pa.string())).to_pylist()
    for text, got in zip(rows, found, strict=True):
        *base, (many, covered, longest) = plain_quality(text)
        assert [got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == base
        assert (got["n_repeats"], got["repeat_covered"], got["longest_repeat"]) == (many, covered, longest)


def test_quality_query(spark, sf_dir, texts):
    found = {r.doc_id: r for r in Q.quality(spark, sf_dir).collect()}
    for i, text in texts.items():
        words, chars, symbols, dup, repeated, _ = plain_quality(text) if len(text) < 4000 else (*[None] * 5, None)
        if words is not None:
            got = found[i]
            assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (words, chars, symbols, dup, repeated)
            assert got.base_failed == (words < 50 or 100 * repeated > 50 * words)


def test_quality_verdict(make_docs):
    fresh = " ".join(f"w{i}" for i in range(300))
    passage = " ".join(f"p{i}" for i in range(120))
    docs = make_docs([(1, fresh), (2, f"{fresh} {passage} {fresh[:40]} {passage}"), (3, "short"), (4, None)])
    assert {r.doc_id for r in quality.kept_by_quality(docs).collect()} == {1}


def test_search_in_blocks_equals_one(spark, make_docs):
    items = [(i, " ".join(f"k{i}x{j}" for j in range(20))) for i in range(6)] + [(6, None), (7, "..."), (None, "lone item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(1, items[0][1] + " and " + items[3][1]), (2, "A LONE. item, here"), (3, None), (4, "nothing"), (5, "lone " * 40)])
    one = decontaminate.add_benchmark_hits(docs, bench).select("doc_id", "hits.*").orderBy("doc_id").collect()
    many = decontaminate.add_benchmark_hits(docs, bench, block_bytes=200).select("doc_id", "hits.*").orderBy("doc_id").collect()
    assert one == many
    assert [(r.n_hit, r["items"], r.contaminated) for r in one] == [
        (40, ["0", "3"], True), (2, [""], True), (0, [], False), (0, [], False), (0, [], False),
    ]
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()} == {3, 4, 5}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), min_size=1, max_size=3), st.lists(st.sampled_from("abcd"), max_size=40))
def test_every_occurrence_is_found(items, words):
    search = decontaminate.WindowSearch([(str(i), " ".join(x)) for i, x in enumerate(items)], window=4)
    found = search.search(pa.array([" ".join(words)])).to_pylist()[0]
    hit, names = set(), set()
    for i, item in enumerate(items):
        m = min(4, len(item))
        for k in range(len(item) - m + 1):
            for at in range(len(words) - m + 1):
                if words[at : at + m] == item[k : k + m]:
                    hit |= set(range(at, at + m))
                    names.add(str(i))
    assert {w for s in found["spans"] for w in range(s["start"], s["end"])} == hit
    assert found["items"] == sorted(names)


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([("1", "word1 filler1")], "item_id string, text string")
    for run in (
        pii.add_pii, secrets.add_secrets, quality.add_quality, lambda d: decontaminate.add_benchmark_hits(d, bench),
        secrets.redact_secrets,
    ):
        assert run(odd_docs).count() == 10
        assert run(odd_docs).select("item_id", "start").count() == 10
        assert run(no_docs).collect() == []
    assert decontaminate.add_benchmark_hits(odd_docs, bench.limit(0)).where("hits.n_hit > 0").count() == 0
    assert np.all([r.kept is False for r in quality.add_quality(odd_docs).where("text is null").select("quality.kept").collect()])
