"""Filter interactions, periodic runs and binary token files, against brute force and round trips."""

import hashlib
import io
import itertools
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.llm import filter_audit, periodic_runs, token_files
from shelfcast.llm import queries as Q

MODEL = Tokenizer.from_file(Q.WORD_TOKENIZER)
ASCII_SPACE = " \t\n\r\x0b\x0c"


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


# ---------------------------------------------------------------- filter audit

PIECES = ["a", "B", "ab", "longer-than-eight", "longer-than-eighT", " ", "\t", "\n", "\x0b", "é", "漢字", "😀", "#", "$", "x" * 300, "\x00", "\xa0", "\x1c"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=5))
def test_measures_of_the_transducer(texts):
    found = filter_audit.text_measures(pa.array(texts, pa.string())).to_pylist()
    for text, m in zip(texts, found, strict=True):
        text, words = text or "", words_of(text)
        assert m == {
            "n_words": len(words), "n_distinct": len(set(words)), "n_capitals": sum("A" <= c <= "Z" for c in text),
            "n_points": len(text), "n_symbols": sum(c in "#$%&*|" for c in text),
        }


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit.Spans, "_hash", lambda self: np.zeros(len(self.begins), np.uint64))
    texts = [" ".join(random.Random(1).choices(["one", "other-longer-word", "other-longer-worD", "y" * 400, "y" * 399 + "z"], k=60)), "one one two"]
    found = filter_audit.text_measures(pa.array(texts)).to_pylist()
    assert [m["n_distinct"] for m in found] == [5, 2]


def test_measures_of_a_very_long_text():
    text = " ".join(f"w{i % 5000}" for i in range(600_000)) + " " + "z" * 3_000_000
    m = filter_audit.text_measures(pa.array([text, "A b"])).to_pylist()
    assert (m[0]["n_words"], m[0]["n_distinct"], m[0]["n_points"]) == (600_001, 5001, len(text))
    assert m[1]["n_words"] == 2 and m[1]["n_capitals"] == 1


def plain_audit(docs, labels):
    """{(part, order, step): counts}; docs: (doc_id, text, part), labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text, words = text or "", words_of(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and i > least[text]}
        rows.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for order in itertools.permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                own = [r for r in rows if r[0] == part]
                out[part, "".join(order), k + 1] = [
                    len(left), len(removed), sum(f in r[1] for r in own) - len(removed), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in removed), sum(r[3] for r in removed),
                ]
    shapley = Counter()
    for (part, order, step), counts in out.items():
        shapley[part, order[step - 1]] += counts[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(300))
    docs = [
        (1, None, "a", "x"), (2, "", None, "x"), (None, "", "a", "x"), (3, long_text, "", "x"), (3, long_text, "a", "x"),
        (4, long_text, "a", "x"), (4, long_text, "a", "x"), (5, "A B C # # #", "b", "x"), (6, "same " * 400, "b", "x"),
        (7, long_text, "a", "x"), (None, long_text, None, "x"), (None, None, "b", "x"), (5, "A B C # # #", "b", "x"),
    ]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, None), (5, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, digest string").withColumn("part", F.lit("other"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit_orders(filter_audit.count_failures(table, marks)).collect()
    want = plain_audit([d[:3] for d in docs], [x for x in labels if x[0] is not None])
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in found} == want
    assert len(found) == 3 * 600
    none = filter_audit.audit_orders(filter_audit.count_failures(table.limit(0), marks))
    assert none.collect() == []
    unlabelled = filter_audit.audit_orders(filter_audit.count_failures(table, marks.limit(0))).agg(F.sum("good_lost")).first()[0]
    assert unlabelled == 0


def test_audit_of_other_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 1), ("p", 2, 1, 0, 0), ("p", 3, 1, 0, 0)], "part string, failed int, docs long, good long, toxic long")
    found = {(r.filter_order, r.step): r for r in filter_audit.audit_orders(counts, "XY").collect()}
    assert len(found) == 4 and found["XY", 1].removed == 3 and found["XY", 2].removed == 1 and found["YX", 1].removed == 4
    assert found["YX", 2].redundant == 3 and found["XY", 1].shapley == 3 and found["YX", 1].shapley == 5
    with pytest.raises(ValueError):
        filter_audit.audit_orders(counts, "ABCDEFG")
    with pytest.raises(ValueError):
        filter_audit.audit_orders(counts, "AA")


# ---------------------------------------------------------------- periodic runs


def plain_runs(words, least=12):
    """(start, length, period), by trying every period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = set()
    for s, n, q in runs:
        gone |= set(range(s + q, s + n))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


BLOCKS = st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9)).map(lambda b: b[0] * b[1])
RUNNY = st.lists(st.text("ab", max_size=14) | BLOCKS, max_size=6).map("".join).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(RUNNY, min_size=1, max_size=4), st.sampled_from([2, 3, 5, 12]))
def test_runs_equal_brute_force(texts, least):
    for text, r in zip(texts, periodic_runs.periodic_runs(pa.array(texts), least).to_pylist(), strict=True):
        words = text.split()
        want = plain_runs(words, least)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
        assert r["n_words"] == len(words) and r["collapsed"] == plain_collapsed(words, want)


def test_runs_of_long_repetitive_texts():
    rnd = random.Random(5)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = ["a " * 50_000, " ".join(fibonacci[-1]), " ".join(rnd.choices("ab", k=900)), " ".join(f"x{i} same words again and once more y{i}" for i in range(3000))]
    found = periodic_runs.periodic_runs(pa.array(texts)).to_pylist()
    assert [tuple(r.values()) for r in found[0]["runs"]] == [(0, 50_000, 1)] and found[0]["collapsed"] == "a"
    for k in (1, 2):
        assert [(r["start"], r["length"], r["period"]) for r in found[k]["runs"]] == plain_runs(texts[k].split())
    assert found[3]["runs"] == []


def test_runs_odd_rows(odd_docs, no_docs):
    found = periodic_runs.add_runs(odd_docs, into="kind")
    assert found.columns == odd_docs.columns
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["kind"].n_words == len(words_of(r.text)) and (r.text or r["kind"].collapsed == "")
    assert periodic_runs.add_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.add_runs(no_docs, min_words=1)


def looped(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def check_runs_query(rows, texts):
    for r in rows:
        words = looped(r.doc_id, words_of(texts[r.doc_id]))
        runs = plain_runs(words) if len(words) < 1500 else None
        if runs is None:
            continue
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)


def test_runs_query(spark, sf_dir, texts):
    rows = Q.periodic_runs(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert sum(r.n_runs > 0 for r in rows) > 10
    check_runs_query(rows, texts)


def test_looped_texts(spark):
    texts = {i: t for i, t in enumerate([None, "", " \t ", "one", "é b  c\x0bd\xa0e f g h"] * 30)}
    docs = spark.createDataFrame(list(texts.items()) + [(None, "a b")], "doc_id long, text string")
    for r in Q.looped_texts(docs).collect():
        words = words_of("a b" if r.doc_id is None else texts[r.doc_id])
        assert words_of(r.text) == (words if r.doc_id is None else looped(r.doc_id, words))


# ---------------------------------------------------------------- token files


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, (1 << b) - 1), max_size=70))), st.randoms())
def test_packed_ids_round_trip(case, rnd):
    bits, ids = case
    data = token_files.pack_ids(np.array(ids, np.uint32), bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    as_number = sum(i << bits * k for k, i in enumerate(ids))
    assert int.from_bytes(data.tobytes(), "little") == as_number
    at = [rnd.randrange(len(ids)) for _ in range(20)] if ids else []
    assert token_files.unpack_ids(data, bits, np.array(at, np.int64)).tolist() == [ids[k] for k in at]


def test_bits_of_a_vocabulary():
    assert [token_files.id_bits(n) for n in (1, 2, 3, 256, 257, 49_408, 1 << 32)] == [1, 1, 2, 8, 9, 16, 32]
    with pytest.raises(ValueError):
        token_files.id_bits(0)
    with pytest.raises(ValueError):
        token_files.pack_ids(np.array([8], np.uint32), 3)


@pytest.mark.parametrize("sizes", [[], [0], [3, 0, 5], [64, 64], [1, 500, 63, 64, 65, 0, 0, 2000]])
def test_file_round_trip_and_random_access(sizes):
    rnd = np.random.default_rng(7)
    docs = [(None if k < 2 else -k, rnd.integers(0, 8000, n).astype(np.uint32)) for k, n in enumerate(sizes)]
    out = io.BytesIO()
    target = token_files.TokenFileWriter(out, 13, 64)
    for doc_id, ids in docs:
        target.add(doc_id, ids)
    target.close()
    file = token_files.TokenFile(out, out.tell())
    everything = np.concatenate([ids for _, ids in docs] or [np.zeros(0, np.uint32)])
    found = list(file.documents())
    assert [(i, ids.tolist()) for i, _, ids in found] == [(i, ids.tolist()) for i, ids in docs]
    assert [s for _, s, _ in found] == np.concatenate([[0], np.cumsum(sizes)])[: len(sizes)].tolist()
    for _ in range(30):
        a, b = sorted(rnd.integers(0, len(everything) + 1, 2).tolist())
        assert file.ids(a, b).tolist() == everything[a:b].tolist()
    with pytest.raises(IndexError):
        file.ids(0, len(everything) + 1)
    broken = out.getvalue()[:-9] + b"wrong" + out.getvalue()[-4:]
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(broken[:-70]), len(broken) - 70)


TOKEN_PIECES = ["a", "B", "'s", "'LL", "é", "É", "ß", "1", ".", "<|", "|>", "<|endoftext|>", " ", "\n", "\x85", "　", "Σ", "İ", "é", "́", "×", "ª", "漢", "\x00", "y" * 70]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(TOKEN_PIECES), max_size=14).map("".join), max_size=4), st.sampled_from([2, 1 << 19]))
def test_ids_of_words_equal_those_of_texts(texts, keep):
    encoder = token_files.WordEncoder(Q.WORD_TOKENIZER, 2, keep)
    for text in texts:
        assert encoder.encode(text).tolist() == [*MODEL.encode(text, add_special_tokens=False).ids, 2]
    assert encoder.encode(None).tolist() == [2] and encoder.split


def test_other_tokenizer_files_are_encoded_word_by_word():
    assert token_files._plain_split({"normalizer": None, "pre_tokenizer": None, "model": {"type": "BPE"}}) is None


def check_files(rows, ids_of):
    """ids_of: (doc_id, ids) in any order."""
    want = Counter((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for i, ids in ids_of)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))


def test_token_files_query(spark, sf_dir, texts):
    rows = Q.token_files(spark, sf_dir).collect()
    check_files(rows, [(i, [*MODEL.encode(t, add_special_tokens=False).ids, 2]) for i, t in texts.items()])


def written_rows(spark, docs, folder, **options):
    token_files.write_token_files(docs, folder, Q.WORD_TOKENIZER, Q.WORD_VOCABULARY, Q.WORD_END, **options)
    n = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return token_files.read_token_files(spark, folder).select("doc_id", "start", n, F.crc32("ids").alias("ids_crc32")).collect()


def test_token_files_odd_rows(spark, odd_docs, no_docs, tmp_path):
    ids_of = [(r.doc_id, [*MODEL.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in odd_docs.collect()]
    check_files(written_rows(spark, odd_docs, f"{tmp_path}/a"), ids_of)
    folder = f"file://{tmp_path}/many"
    check_files(written_rows(spark, odd_docs, folder, file_bytes=1000), ids_of)
    listed = token_files.read_manifest(folder)
    assert listed["bits"] == 16 and len(listed["files"]) > 3
    everything = b"".join(r.ids for r in sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start))
    everything = np.frombuffer(everything, "<u4")
    for a, b in ((0, 0), (0, 5), (len(everything) // 3, len(everything) - 1)):
        assert token_files.ids_at(folder, a, b).tolist() == everything[a:b].tolist()
    assert written_rows(spark, no_docs, f"{tmp_path}/none") == []


def test_rows_of_one_id_go_to_several_files(spark, make_docs, tmp_path):
    docs = make_docs([(1, "some words here " * 20)] * 400 + [(2, "other")])
    rows = written_rows(spark, docs, f"{tmp_path}/hot", file_bytes=4096)
    assert len(rows) == 401 and max(r.doc_id for r in rows) == 2
    sizes = [f["n_docs"] for f in token_files.read_manifest(f"{tmp_path}/hot")["files"]]
    assert len(sizes) > 5 and max(sizes) < 200 and sum(sizes) == 401
