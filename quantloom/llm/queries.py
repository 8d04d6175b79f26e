"""The registered queries of the subpackage, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, factorisation, licenses, lines, minhash, mixing, preference, quality, ranked, repeats, simhash, spelling, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"({k}, '{label}', {_listed(own)}, {licenses.need(len(own))}, {licenses.width(t)})" for k, (label, t, own) in enumerate((x, t, licenses.words_of(t)) for x, t in licenses.TEMPLATES))
_PLACES = [(label, " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))) for p, label in licenses.PHRASES.items()]

_OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w, {_LOW} AS low FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {test}) AS {label}" for label, test in _PLACES)} FROM d),
t(k, label, own, need, width) AS (VALUES {_TEMPLATES}),
v AS (SELECT k, label, len(own) AS size, need, width, unnest(own) AS word FROM t),
o AS (SELECT DISTINCT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
m AS (SELECT doc_id, label, size, need, count(DISTINCT word) OVER (PARTITION BY doc_id, k ORDER BY i RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS n FROM o JOIN v USING (word)),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(n / size) AS share FROM m WHERE n >= need GROUP BY doc_id),
j AS (SELECT p.*, found, share, list_concat(mit, apache, gpl) AS places, list_filter([CASE WHEN len(mit) > 0 THEN 'mit' END, CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END], lambda x: x IS NOT NULL) AS base
      FROM p LEFT JOIN f USING (doc_id))
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM j
"""

_BITS = "list_aggregate(list_transform(range(1, 41), lambda j: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, j, 1)) - 1) + 1, 4)), 'string_agg', '')"
_FIVE = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))

_OP7 = f"""
WITH r AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
s AS (SELECT *, {_BITS} AS bits, max(page_id) OVER (PARTITION BY h) AS largest FROM r)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_FIVE} + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM s
"""


@_query("op1_suffix_array_dedup")
def _op1(table):
    left = repeats.without_repeats(table("documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return left.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query("op2_license_scans", _OP2)
def _op2(table):
    return licenses.scan(table("documents"))


@_query("op3_quality_classifier")
def _op3(table):
    docs = table("documents")
    return factorisation.score(docs, factorisation.train(docs, table("labels")))


@_query("op4_chat_formatting")
def _op4(table):
    return preference.formatted(preference.swapped_replies(preference.conversations(table("conversations"))))


@_query("op5_mixing_sources")
def _op5(table):
    return mixing.mix(table("documents"))


@_query("op6_quality_rules")
def _op6(table):
    docs = table("documents")
    judged = quality.judge(docs, quality.train(docs, table("labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@_query("op7_warc", _OP7)
def _op7(table):
    return warc.round_trip(table("pages"))


@_query("op8_line_dedup")
def _op8(table):
    return lines.line_report(table("documents"))


_OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, k, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS phrase
      FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, i, k, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS phrase
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
m AS (SELECT g.doc_id, g.i, g.k, p.item_id FROM g JOIN p USING (k, phrase)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@_query("op9_benchmark_decontamination", _OP9)
def _op9(table):
    found = decontaminate.contamination(table("documents"), table("benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_query("op10_simhash_near_dedup")
def _op10(table):
    found = simhash.near_duplicates(table("documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_OP11 = rf"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(times * (w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * docs) // terms))))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), a GROUP BY item_id, doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 20
"""


@_query("op11_ranked_search", _OP11)
def _op11(table):
    return ranked.search(table("documents"), table("benchmark"))


# crc32 byte by byte over "<doc_id>:<word>": a table of 256 remainders, made bit by bit; U+00C0 to U+00FF are the bytes 195, code - 64
_CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))"
_CRC_BYTES = "flatten(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c) - 64] END))"
_OP12 = rf"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
t AS MATERIALIZED (SELECT {_CRC_TABLE} AS tbl),
h AS (SELECT run, times, xor(list_reduce(list_concat([4294967295], {_CRC_BYTES}), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM r, t WHERE length(run) >= 5),
c AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, times FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
x AS MATERIALIZED (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word, w.word AS other, w.n AS other_n FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word
      UNION SELECT x.word, y.word, y.n FROM x JOIN x AS y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
o AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM w LEFT JOIN (SELECT * FROM o WHERE place = 1) USING (word)),
g AS (SELECT word, word AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.at AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word JOIN f AS e ON e.word = g.at WHERE e.form IS NULL
"""


@_query("op12_spelling_variants", _OP12)
def _op12(table):
    found = spelling.variants(spelling.vocabulary(table("documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


_OP13 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS shingle FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS k FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n AS a ON a.doc_id = u JOIN n AS c ON c.doc_id = v WHERE 100 * k >= 85 * (a.n + c.n - k)),
g AS (SELECT doc_id, doc_id AS to_id FROM d UNION SELECT g.doc_id, e.v FROM g JOIN e ON e.u = g.to_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM g GROUP BY doc_id) AS c USING (doc_id)
"""


@_query("op13_minhash_near_dedup", _OP13)
def _op13(table):
    return minhash.near_duplicates(table("documents"))
