"""Operators over the whole corpus, against brute force and round trips."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check_oracles import TABLES, compare
from shelfcast.llm import chat, fixity, licenses, packing, simhash, suffix_core, suffix_dedup
from shelfcast.llm import queries as Q
from shelfcast.llm.common import components
from shelfcast.llm.tokens import Encoder

ENCODER = Encoder(Q.TOKENIZER)
MODEL = Tokenizer.from_file(Q.TOKENIZER)
MODEL.encode_special_tokens = True
# As op2_packing is asked for: added tokens of the file keep their ids.
CONTROL_ENCODER = Encoder(Q.TOKENIZER, controls=True)
DEFAULT = Tokenizer.from_file(Q.TOKENIZER)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_its_counterpart(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert compare(Q.QUERIES[name](spark, sf_dir).toPandas(), con.execute(Q.ORACLES[name]).df()) == "ok"


# ---------------------------------------------------------------- packing


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\té's9!漢\x1c\x85　<|endoftext|>", max_size=30))
def test_ids_equal_the_tokenizer(text):
    assert ENCODER.ids(text) == MODEL.encode(text, add_special_tokens=False).ids


CONTROLS = st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "a", " b", "\n", "漢", "é", "  ", "'s"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(CONTROLS.map("".join))
def test_ids_of_added_tokens_equal_the_tokenizer(text):
    assert CONTROL_ENCODER.ids(text) == DEFAULT.encode(text, add_special_tokens=False).ids


def test_packing_of_added_tokens(make_docs):
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "漢<|endoftext|>  x", 4: "plain"}
    ids = {i: [*DEFAULT.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    assert ids[1] == [64, 220, 50256, 275, 1]
    check_packing(packing.pack_documents(make_docs(texts.items()), Q.TOKENIZER).collect(), ids)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=8), st.integers(1, 60))
def test_best_fill_is_closest(counts, room):
    sums = {0}
    for length, many in counts.items():
        sums |= {s + length * k for s in sums for k in range(many + 1)}
    taken = packing.best_fill(counts, sorted(counts, reverse=True), room)
    assert sum(k * v for k, v in taken.items()) == max(s for s in sums if s <= room)
    assert all(v <= counts[k] for k, v in taken.items())


def check_packing(rows, ids_of):
    """ids_of: one list of ids per row, by document."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            own = ids[at : at + r.length]
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing_query(spark, sf_dir, texts):
    ids = {i: [*MODEL.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    assert check_packing(Q.packing(spark, sf_dir).collect(), ids) < 2 * 2048


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, Q.TOKENIZER).collect()
    per_sequence = Counter()
    for r in rows:
        per_sequence[r.sequence_id] += r.length
    assert max(per_sequence.values()) <= 2048
    assert sum(r.start == 0 for r in rows) == odd_docs.count()
    again = packing.pack_documents(odd_docs.repartition(3), Q.TOKENIZER).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert packing.pack_documents(no_docs, Q.TOKENIZER).collect() == []


def test_copies_of_one_row_go_to_several_groups(spark, make_docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_COPIES", 50)
    docs = make_docs([(1, "same words")] * 420 + [(None, None)] * 101 + [(2, "other")])
    rows = packing.pack_documents(docs, Q.TOKENIZER, group_documents=64).collect()
    assert Counter(r.doc_id for r in rows) == {1: 420, None: 101, 2: 1}
    groups = Counter(r.sequence_id >> 32 for r in rows if r.doc_id == 1)
    assert len(groups) > 2 and all(n % 50 in (0, 20) for n in groups.values())
    for pieces in Counter((r.sequence_id, r.offset) for r in rows).values():
        assert pieces == 1


# ---------------------------------------------------------------- suffix sorting


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60) | st.text("ab", min_size=1, max_size=80).map(str.encode), min_size=1, max_size=4), st.sampled_from([3, 5, 9, 17]))
def test_two_stage_sort(parts, length):
    raw = b"".join(parts)
    data = np.frombuffer(raw, np.uint8)
    assert suffix_core.two_stage_suffix_array(data, len(raw)).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    found = suffix_core.repeated_begins([np.frombuffer(p, np.uint8) for p in parts], length)
    for part, begins in zip(parts, found, strict=True):
        assert begins.tolist() == [i for i in range(len(part) - length + 1) if seen[part[i : i + length]] > 1]


def plain_dedup(texts, length):
    raw = [t.encode() for t in texts]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    for b in raw:
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                mark[s : s + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        yield len(b), len(b) - len(kept), len(re.findall(b"\1+", mark)), hashlib.sha256(kept).hexdigest()


def dedup_rows(df):
    return sorted(
        (r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), r.kept_sha256) for r in df.collect()
    )


def test_dedup_query(spark, sf_dir, texts):
    found = {r.doc_id: tuple(r)[1:] for r in Q.suffix_dedup(spark, sf_dir).collect()}
    assert found == dict(zip(texts, plain_dedup(texts.values(), 400), strict=True))


@pytest.mark.parametrize("stretches", [1, 3, 1024])
def test_dedup_by_sorting_and_by_counting(make_docs, stretches):
    """Many stretches of one anchor, judged by suffix sorting or by counting single windows, give the same."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdeé"), 5))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(12)) + passage[k:] + word() * (k % 3) for k in range(0, 24, 2)]
    texts += [texts[0], "a" * 300, "ab" * 200, "", passage + passage]
    docs = make_docs(list(enumerate(texts)))
    expected = [(i, *x) for i, x in enumerate(plain_dedup(texts, 60))]
    found = suffix_dedup.without_repeats(docs, length=60, gram=20, sort_bytes=500, stretches=stretches)
    assert dedup_rows(found) == expected


@pytest.mark.parametrize("stretches", [1, 1024])
def test_dedup_cuts_stretches_of_copies_once(make_docs, monkeypatch, tmp_path, stretches):
    """However many copies a row has, with or without an id, each of its stretches is fetched once."""
    folder, counted = str(tmp_path), "_sort_blocks" if stretches > 1 else "_single_windows"
    real = getattr(suffix_dedup, counted)

    def watched(*args):
        run = real(*args)

        def noted(batches):
            import uuid

            def seen():
                for batch in batches:
                    with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                        for row in batch.select(["gram", "stretch", "lead", "spread"]).to_pylist():
                            file.write(f"{tuple(row.values())}\n")
                    yield batch

            yield from run(seen())

        return noted

    monkeypatch.setattr(suffix_dedup, counted, watched)
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdeé "), 200))
    other = "".join(rng.choice(list("xyzwé "), 200))
    pairs = [(1, passage)] * 20 + [(None, other)] * 20 + [(2, "1" + passage[9:] + "2"), (None, "3" + other[9:] + "4")]
    docs = make_docs(pairs)
    found = suffix_dedup.without_repeats(docs, length=60, gram=20, stretches=stretches).collect()
    own = lambda rows: sorted(rows, key=str)
    found = [(r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), r.kept_sha256) for r in found]
    assert own(found) == own((i, *x) for (i, _), x in zip(pairs, plain_dedup([t for _, t in pairs], 60), strict=True))
    times = Counter(line for path in tmp_path.iterdir() for line in path.read_text().splitlines())
    uses = 1 if stretches > 1 else 2  # single windows are counted, then looked up
    assert len(times) >= 4 and set(times.values()) == {uses}


def test_dedup_odd_rows(odd_docs, no_docs):
    rows = suffix_dedup.without_repeats(odd_docs).collect()
    assert len(rows) == 10
    assert {r.doc_id for r in rows if r.removed} == {4, 8}  # copies of each other
    spans = suffix_dedup.repeated_spans(odd_docs.unionByName(odd_docs).unionByName(odd_docs))
    for r in spans.collect():  # each range once, however many copies the row has
        assert len({tuple(w) for w in r.windows}) == len(r.windows)
    assert suffix_dedup.without_repeats(no_docs).collect() == []


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text, shingle=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    grams = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=4):
    ids, parent = list(prints), {i: i for i in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits):
            a, b = top(i), top(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_simhash_query(spark, sf_dir, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    expected = plain_components(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.simhash(spark, sf_dir).collect()}
    assert found == {i: (f"{prints[i]:016x}", expected[i]) for i in texts}


@pytest.mark.parametrize("chunk", [8, 50_000])
@pytest.mark.parametrize("parts", [2, 3, 4])
def test_every_plan_and_split_links_the_same(spark, monkeypatch, parts, chunk):
    rng = np.random.default_rng(parts)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = {int(x) for x in seeds} | {0}
    for _ in range(150):  # chains and dense groups around the seeds
        x = int(rng.choice(list(values)))
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values = sorted(values)
    bounds = [64 * i // parts for i in range(parts + 1)]
    radii = {2: [2, 1], 3: [1, 1, 0], 4: [1, 0, 0, 0]}[parts]
    monkeypatch.setattr(simhash, "segments", lambda n, bits: [(bounds[i], bounds[i + 1] - bounds[i], radii[i]) for i in range(parts)])
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    labels = {r.node: r.component for r in components(simhash.fingerprint_links(fps, chunk=chunk)).collect()}
    expected = plain_components(dict(enumerate(values)))
    groups = lambda label: sorted(sorted(g) for g in label.values())
    found, wanted = defaultdict(list), defaultdict(list)
    for k, v in enumerate(signed):
        found[labels.get(v, v)].append(k)
        wanted[expected[k]].append(k)
    assert groups(found) == groups(wanted)


@pytest.mark.parametrize("n", [0, 1, 10**4, 10**7, 10**10, 10**14])
def test_radii_miss_nothing(n):
    plan = simhash.segments(n, 4)
    assert sum(width for _, width, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) == 5


def test_components_of_a_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    extra = spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(edges.unionByName(extra)).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_simhash_odd_rows(odd_docs, no_docs):
    rows = simhash.add_components(odd_docs).collect()
    assert len(rows) == 10
    wordless = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(wordless) == 4 and {r.component_id for r in wordless} == {1}
    kept = simhash.one_of_each(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 4), (False, 5), (False, 5), (True, 0)]
    assert simhash.one_of_each(no_docs).collect() == []


# ---------------------------------------------------------------- chat


@settings(max_examples=200, deadline=None)
@given(st.text("<|\\n\nim_end>", max_size=20), st.text("<|\\n\nim_start>", max_size=12))
def test_turns_round_trip(text, role):
    formatted, _ = chat.laid_out([chat.Turn(role, text, 0), chat.Turn("user", text, 0)], 0)
    assert chat.read_turns(formatted) == [(role, text), ("user", text)]


def test_chat_query(spark, sf_dir):
    sql = f"SELECT conv_id, role, coalesce(text, '') FROM '{sf_dir}/conversations.parquet' ORDER BY conv_id, turn"
    turns = defaultdict(list)
    for conv, role, text in duckdb.sql(sql).fetchall():
        turns[conv].append((role, text))
    turns[-1] = [("user", Q.CONTROL_TEXT), ("assistant", Q.CONTROL_TEXT)]
    found = {r.conv_id: r for r in Q.chat(spark, sf_dir).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found.keys() == turns.keys()
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        got = found[conv]
        assert (got.n_turns, got.turns_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (got.loss_chars, got.loss_sha256) == (len(loss), sha(loss))


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * 20) for i in range(1, 30)]
    rows += [(2, 0, "user", "word " * 400), (2, 1, "assistant", None), (None, None, None, "x"), (2, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat.format_windows(df, Q.TOKENIZER, budget=200, history=60).collect()
    first = sorted((w for w in windows if w.conv_id == 1), key=lambda w: w.window)
    assert len(first) > 3 and all(w.n_tokens <= 200 for w in first)
    seen = []
    for w in first:
        turns = chat.read_turns(w.text)
        assert turns[0] == ("system", "be brief") and len(turns) == w.n_turns
        assert w.window == 0 or w.repeated_turns >= 2
        assert w.first_turn == len(seen)
        spans = [chat.unescape(w.text[s.start : s.end]) for s in w.loss]
        assert spans == [t for r, t in turns[w.repeated_turns :] if r == "assistant"]
        seen += turns[w.repeated_turns :]
    assert seen == [(r, t) for _, _, r, t in rows[:30]]
    assert sum(w.n_turns - w.repeated_turns for w in windows if w.conv_id == 2) == 3
    assert [chat.read_turns(w.text) for w in windows if w.conv_id is None] == [[("", "x")]]
    assert chat.format_windows(df.limit(0), Q.TOKENIZER).collect() == []


# ---------------------------------------------------------------- fixity


def test_audit_finds_what_differs_and_no_more(spark):
    pages = spark.range(300).select("id", F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("html"))
    records = lambda df: fixity.archive_records(df, F.col("id"), F.col("url"), F.col("html"), F.floor(F.col("id") / 100))
    left = records(pages)
    assert fixity.audit(left, left, 2000, 3).count() == 0
    right = left.withColumn("digest", F.when(F.col("record_id") == 42, F.lit("0")).otherwise(F.col("digest")))
    right = right.where("record_id <> 150").unionByName(left.where("record_id = 7").withColumn("offset", F.lit(10**6)))
    found = {(r.record_id, r.status) for r in fixity.audit(left, right, 2000, 3).collect()}
    assert found == {(42, "changed"), (150, "missing"), (7, "added")}
    gone = fixity.audit(left, left.where("archive <> 1"), 2000, 3)
    assert gone.count() == 100 and gone.where("status = 'missing'").count() == 100
    assert fixity.audit(left.limit(0), left.limit(0)).count() == 0


def test_audit_odd_rows(spark):
    rows = [(None, None, None), (1, "u", None), (1, "u", None), (2, None, "")]
    pages = spark.createDataFrame(rows, "id long, url string, html string")
    left = fixity.archive_records(pages, F.col("id"), F.col("url"), F.col("html"), F.lit(None).cast("long"))
    assert left.count() == 4 and fixity.audit(left, left).count() == 0
    assert fixity.audit(left, left.where("record_id = 2")).count() == 3


# ---------------------------------------------------------------- licenses


def test_bands_are_certain_enough():
    for n in range(1, 400):
        w = licenses.WindowSize.of(n)
        assert n <= w.largest and w.width >= n + w.stride - 1  # one window holds any occurrence
        s = w.similarity(n, 0.8)
        bands = licenses.bands_needed(s, licenses.ROWS, 0.9999)
        assert 1 - (1 - s**licenses.ROWS) ** bands >= 0.9999


def test_licenses_amid_text(spark, make_docs):
    filler = " ".join(f"f{i}" for i in range(200))
    gpl = next(t for k, t, told in licenses.TEMPLATES if k == "GPL-3.0" and len(t) > 200)
    torn = gpl.replace("redistribute", "share")  # 5 of 36 shingles differ
    docs = make_docs([(1, f"{filler} {gpl} {filler}"), (2, f"{filler}\n{torn.upper()}"), (3, filler), (4, None), (5, "the MIT License")])
    found = {(r.doc_id, r.license_id): r.containment for r in licenses.scan_licenses(docs).collect()}
    assert found[1, "GPL-3.0"] == 1.0 and 0.8 <= found[2, "GPL-3.0"] < 1 and len(found) == 2
    again = licenses.scan_licenses(docs, pass_shingles=10)
    assert {(r.doc_id, r.license_id): r.containment for r in again.collect()} == found
    none = spark.createDataFrame([("x", None), (None, "  ")], "license_id string, template string")
    assert licenses.scan_licenses(docs, none).collect() == []


def test_licenses_odd_rows(odd_docs, no_docs, spark):
    templates = spark.createDataFrame([("short", "Same Text"), (None, "no id")], "license_id string, template string")
    found = licenses.scan_licenses(odd_docs, templates).collect()
    assert {(r.doc_id, r.license_id) for r in found} == {(None, "")}
    assert licenses.scan_licenses(no_docs).collect() == []


def test_license_scan_is_native(spark, sf_dir):
    plan = Q.license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_its_parts(spark, sf_dir, texts):
    from test_text_operators import plain_quality, plain_secrets

    rows = duckdb.sql(f"SELECT doc_id, contaminated FROM ({Q.ORACLES['op5_decontamination'].replace('FROM documents', f'''FROM '{sf_dir}/documents.parquet' ''').replace('FROM benchmark', f'''FROM '{sf_dir}/benchmark.parquet' ''')})").fetchall()
    contaminated = {i for i, c in rows if c}
    kept = {}
    for i, text in texts.items():
        n, _, _, _, repeated, _ = plain_quality(text) if len(text) < 6000 else (1000, 0, 0, 0, 0, None)
        if n >= 50 and 100 * repeated <= 50 * n:
            kept[i] = text
    verdict = {r.doc_id for r in Q.quality(spark, sf_dir).where("kept").collect()}
    assert verdict <= kept.keys() and len(verdict) > 0.97 * len(kept)
    groups = plain_components({i: plain_fingerprint(texts[i]) for i in verdict})
    left = {i for i in verdict if groups[i] == i} - contaminated
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in found} == left
    clean = {i: texts[i] for i in left if not plain_secrets(texts[i])}
    ids = {i: [*MODEL.encode(t, add_special_tokens=False).ids, 1] for i, t in clean.items()}
    check_packing([r for r in found], ids)


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, sf_dir).columns == odd_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs.limit(0), sf_dir).collect() == []


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    names = ["_id", "_digest", "_own_id", "_Own_Digest", "_quality", "_hits", "node", "fp", "component", "least"]
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(i, words[i % 3], *[f"{n} {i}" for n in names]) for i in range(6)]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == rows[: 3 if number == 1 else 6]


def test_repeated_rows_leave_one(make_docs):
    docs = make_docs([(1, "a b c"), (1, "a b c"), (None, "x y"), (None, "x y"), (2, "a b c"), (3, None), (3, "")])
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == [(0, "x y"), (1, "a b c")]
    assert [r.doc_id for r in kept if not r.text] == [3]
