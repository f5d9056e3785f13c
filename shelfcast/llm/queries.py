"""One query per operator over its whole table, and the DuckDB counterparts of those that SQL can express."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import licenses
from shelfcast.llm.chat import format_windows, read_turns, unescape
from shelfcast.llm.common import shared_folder, table
from shelfcast.llm.decontaminate import add_benchmark_hits
from shelfcast.llm.filter_audit import audit_orders, count_failures
from shelfcast.llm.fixity import archive_records, audit
from shelfcast.llm.packing import pack_documents
from shelfcast.llm.periodic_runs import add_runs
from shelfcast.llm.pii import KINDS, add_pii
from shelfcast.llm.quality import add_quality
from shelfcast.llm.secrets import add_secrets
from shelfcast.llm.simhash import add_components
from shelfcast.llm.suffix_dedup import without_repeats
from shelfcast.llm.token_files import read_token_files, write_token_files
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Tokenizer of the binary files, its number of ids and the id put after a document.
WORD_TOKENIZER, WORD_VOCABULARY, WORD_END = public_tokenizers.path("word_bpe_49k.json"), 49_408, 2
#: Pages that share an archive file, by id.
ARCHIVE_PAGES = 4096
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = add_pii(table(spark, sf_dir, "documents"))
    base = F.filter("pii", lambda s: ~s["disguised"])
    return found.select(
        "doc_id",
        *(_count(base, k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
    )


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER).drop("digest")


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256"
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = add_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.col("quality")[n].alias(n) for n in names))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = add_benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        "hits.contaminated",
    )


def fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages in archives, against a replica where the payload of every 97th page begins with another byte and
    every 211th record is a hole."""
    pages = table(spark, sf_dir, "pages")
    number = F.floor(F.coalesce("page_id", F.lit(-1)) / ARCHIVE_PAGES)
    rotten = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("!"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    left = archive_records(pages, F.col("page_id"), F.col("url"), F.col("html"), number)
    right = archive_records(pages, F.col("page_id"), F.col("url"), rotten, number)
    right = right.where(F.coalesce(F.col("record_id") % 211 != 7, F.lit(True)))
    found = audit(left, right).withColumnRenamed("record_id", "page_id")
    return found.fillna(0, ["left_length", "right_length"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its windows, which come one after the other."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows, conv, state = [], None, None

    def closed():
        n, turns, chars, loss, formatted = state
        return dict(zip(names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted), strict=True))

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    for batch in batches:
        for window in batch.to_pylist():
            if state is None or window["conv_id"] != conv:
                if state is not None:
                    rows.append(closed())
                conv, state = window["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(window["text"])[window["repeated_turns"] :]:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in window["loss"]:
                own = unescape(window["text"][span["start"] : span["end"]])
                state[2] += len(own)
                state[3].update(own.encode())
            state[4] += len(window["text"])
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if state is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return format_windows(turns, TOKENIZER).mapInArrow(_read_back, schema)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "license_id",
        F.round("containment", 6).alias("containment"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        "n_windows",
    )


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = add_secrets(table(spark, sf_dir, "documents"))
    kinds = ("assign", "access", "hex")
    base = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(_count(F.col("secrets"), k).alias(f"n_{k}") for k in kinds),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("secrets")).alias("spans"),
    )


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_orders(count_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def looped_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``. Where the CRC-32 h of the decimal id ends in 0 and the text has n words, all words from
    number n' = floor(h / 10) mod n on are the first 1 + floor((n - n') / (3 + floor(h / 10) mod 8)) of them, over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, looped = F.floor(h / 10), F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(looped, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    rows = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    first = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    rows = rows.withColumn("a", first.cast("int"))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int")
    rows = rows.withColumn("p", period)
    rest = F.col("n") - F.col("a")
    loop = F.slice("words", F.col("a") + 1, F.col("p"))
    loops = F.slice(F.flatten(F.array_repeat(loop, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), loops), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = add_runs(looped_texts(table(spark, sf_dir, "documents")))
    runs = F.col("periodic.runs")
    rank = F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        F.array_max(rank).alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )
    length, start, period = F.col("best.length"), -F.col("best.col2"), -F.col("best.col3")
    best = (start.alias("start"), length.alias("length"), period.alias("period"))
    milli = F.floor(1000 * length / period).cast("bigint").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", *best, milli, "runs_sha256", "collapsed_sha256")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder, WORD_TOKENIZER, WORD_VOCABULARY, WORD_END)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return read_token_files(spark, folder).select("doc_id", "start", n_tokens, F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii,
    "op2_packing": packing,
    "op3_suffix_dedup": suffix_dedup,
    "op4_quality": quality,
    "op5_decontamination": decontamination,
    "op6_fixity": fixity,
    "op7_chat": chat,
    "op8_licenses": license_scan,
    "op9_secrets": secret_scan,
    "op10_simhash": simhash,
    "op11_filter_audit": filter_interactions,
    "op12_periodic_runs": periodic_runs,
    "op13_token_files": token_files,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLDED = (
    "regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _UPPER.lower() + "'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLDED} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, 2 + greatest(0, len(w) - 13))) AS t(i) WHERE len(w) > 0
),
places AS (
  SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM d, (SELECT DISTINCT m FROM windows) AS sizes, unnest(range(1, greatest(1, len(w) - m + 2))) AS t(i)
),
met AS (SELECT r, i, p.m, item FROM places p JOIN windows v ON p.m = v.m AND p.s = v.s),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM met, unnest(range(0, m)) AS t(k) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM met) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_RECORD_SQL = (
    "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' "
    "|| coalesce(CAST(page_id AS VARCHAR), 'null') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') "
    "|| chr(13) || chr(10) || 'Content-Length: ' || strlen({body}) || chr(13) || chr(10) || chr(13) || chr(10) || {body} "
    "|| chr(13) || chr(10) || chr(13) || chr(10)"
)
_FIXITY_SQL = f"""
WITH records AS (
  SELECT page_id, CAST(floor(coalesce(page_id, -1) / {ARCHIVE_PAGES}) AS BIGINT) AS archive,
    {_RECORD_SQL.format(body="coalesce(html, '')")} AS l, {_RECORD_SQL.format(body="('!' || substring(html, 2))")} AS r
  FROM pages
),
placed AS (
  SELECT *, CAST(strlen(l) AS BIGINT) AS length, CAST(coalesce(sum(strlen(l)) OVER
    (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM records
)
SELECT archive, "offset", page_id, sha256(l) AS left_digest,
  CASE WHEN page_id % 211 <> 7 THEN sha256(r) END AS right_digest, length AS left_length,
  CASE WHEN page_id % 211 <> 7 THEN CAST(strlen(r) AS BIGINT) ELSE 0 END AS right_length,
  CASE WHEN page_id % 211 <> 7 THEN 'changed' ELSE 'missing' END AS status
FROM placed WHERE page_id % 97 = 5 OR page_id % 211 = 7
"""


_FILTER_AUDIT_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
least AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS failed
  FROM w JOIN least USING (t) LEFT JOIN marks ON w.doc_id = marks.doc_id
),
cells AS (SELECT part, failed, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS f, substr(filter_order, 1, k - 1) AS earlier
  FROM orders, unnest(range(1, 6)) AS u(k)
),
states AS (
  SELECT part, filter_order, step, docs, good, toxic, failed = f AS only_this, contains(failed, f) AS fails,
    len(failed) > len(translate(failed, earlier, '')) AS gone, f
  FROM cells, steps
),
summed AS (
  SELECT part, filter_order, step, any_value(f) AS f, sum(CASE WHEN NOT fails AND NOT gone THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN fails AND NOT gone THEN docs ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN only_this THEN docs ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM states GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    size = licenses.SHINGLE_WORDS
    split = r"[x FOR x IN string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+') IF x <> '']"
    rows = ", ".join(f"({i}, {_quoted(k)}, {_quoted(t)})" for i, (k, t, _) in enumerate(licenses.TEMPLATES))
    phrases = [(i, p) for i, (_, _, told) in enumerate(licenses.TEMPLATES) for p in told.split("|") if p]
    phrases = ", ".join(f"({i}, {_quoted(p)})" for i, p in phrases)
    steps = sorted({n: licenses.WindowSize.of(n) for n in range(1, 200)}.items())
    sizes = ", ".join(f"({n}, {w.largest}, {w.stride}, {w.width})" for n, w in steps)
    cut = (
        "SELECT {key}, i, array_to_string(w[i + 1 : i + {size}], ' ') AS s FROM {source}, "
        "unnest(range(0, greatest(1, len(w) - {size} + 1))) AS t(i) WHERE len(w) > 0"
    )
    return f"""
WITH templates(t, license_id, template) AS (VALUES {rows}),
phrases(t, phrase) AS (VALUES {phrases}),
pw AS (SELECT t, {split.format("phrase")} AS w FROM phrases),
ps AS (SELECT DISTINCT t, s, TRUE AS tells FROM ({cut.format(key="t", source="pw", size=size)})),
pn AS (SELECT t, count(*) AS n_tells FROM ps GROUP BY t),
window_sizes(n, largest, stride, width) AS (VALUES {sizes}),
tw AS (SELECT t, license_id, {split.format("template")} AS w FROM templates),
ts AS (SELECT DISTINCT t, license_id, s FROM ({cut.format(key="t, license_id", source="tw", size=size)})),
tn AS (SELECT t, count(*) AS n FROM ts GROUP BY t),
d AS (SELECT doc_id, {split.format("text")} AS w FROM documents),
ds AS ({cut.format(key="doc_id, len(w) AS words", source="d", size=size)}),
hits AS (
  SELECT doc_id, words, i, s, t, license_id, n, largest, stride, width, coalesce(tells, FALSE) AS tells, coalesce(n_tells, 0) AS n_tells
  FROM ds JOIN ts USING (s) JOIN tn USING (t) JOIN window_sizes USING (n) LEFT JOIN ps USING (t, s) LEFT JOIN pn USING (t)
),
met AS (
  SELECT doc_id, license_id, t, words, n, width, k * stride AS first, count(DISTINCT s) / n AS containment,
    count(DISTINCT s) FILTER (tells) = any_value(n_tells) AS told
  FROM hits, unnest(range(greatest(0, CAST(ceil((i - (width - 1)) / stride) AS BIGINT)), i // stride + 1)) AS u(k)
  GROUP BY doc_id, license_id, t, words, n, width, k * stride
)
SELECT doc_id, license_id, round(max(containment), 6) AS containment, CAST(min(first) AS BIGINT) AS first_word,
  CAST(max(least(first + width + {size - 1}, words)) AS BIGINT) AS last_word, count(*) AS n_windows
FROM met WHERE told AND containment >= {licenses.MIN_CONTAINMENT} GROUP BY doc_id, license_id
"""


ORACLES: dict[str, str] = {
    "op5_decontamination": _DECONTAMINATION_SQL,
    "op6_fixity": _FIXITY_SQL,
    "op8_licenses": _license_sql(),
    "op11_filter_audit": _FILTER_AUDIT_SQL,
}
