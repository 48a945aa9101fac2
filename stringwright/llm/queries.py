"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwright.llm.attribution import attributed
from stringwright.llm.decontaminate import contamination
from stringwright.llm.lines import digest as line_digest
from stringwright.llm.lines import without_shared_lines
from stringwright.llm.mixing import mixed
from stringwright.llm.near_dedup import near_duplicates
from stringwright.llm.periods import digest as run_digest
from stringwright.llm.periods import periodic_runs, planted
from stringwright.llm.personal import digest, personal_data
from stringwright.llm.ppm import language_scores
from stringwright.llm.quality import judged
from stringwright.llm.repeats import without_repeats
from stringwright.llm.secrets import digest as secret_digest
from stringwright.llm.secrets import secrets
from stringwright.llm.store import ship
from stringwright.llm.token_files import token_files
from stringwright.llm.trie import grafted, prefix_trie, turns_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: CRC-32 of the text ``{x}``, bit by bit.
CRC32 = """xor(4294967295::UBIGINT, list_reduce(
        list_concat([4294967295::UBIGINT], list_transform(string_split({x}, ''), lambda c: ascii(c)::UBIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda k: 0::UBIGINT)),
                                 lambda s, z: xor(s >> 1, 3988292384::UBIGINT * (s & 1::UBIGINT)))))::BIGINT"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query(
    "op1_near_dedup",
    r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(list_transform(range(greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_id AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN least_id c ON s.doc_id = c.doc_id
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(table(spark, sf_dir, "documents")))


@query(
    "op7_mixing",
    r"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT *, (sum(source_size) OVER ()
               - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)
), targets AS (
    SELECT source, source_size,
           least(CAST(3 * source_size AS DOUBLE), weight * max(level) OVER ()) AS target
    FROM levels
), placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size * size
            + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM placed
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), carry=False).drop("doc")


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = attributed(docs, path, ["source", "lang", "text"], lines_of="text", rule="most")
    of_field = lambda name: F.aggregate(
        F.filter("sections", lambda s: s["field"] == name), F.lit(0.0), lambda n, s: n + s["tokens"]
    ).cast("long")
    return found.select(
        "doc_id", "n_tokens", "n_crossing",
        *[of_field(f).alias(f"{f}_tokens") for f in ("source", "lang", "text")],
        F.size("sections").cast("long").alias("n_sections"),
        F.array_max(F.transform("sections", lambda s: s["tokens"])).cast("long").alias("most_tokens"),
    )


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secrets(table(spark, sf_dir, "documents")))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("distance", "grp")


@query(
    "op2_decontaminate",
    r"""
WITH words AS (
    SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
           lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
           lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1:i + 10], ' '))) AS phrase
    FROM item_words WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT size FROM windows
), starts AS (
    SELECT doc_id, size, unnest(range(len(w) - size + 1)) AS place, w FROM words, sizes WHERE len(w) >= size
), found AS (
    SELECT s.doc_id, s.place, s.size, x.item_id FROM starts s JOIN windows x ON x.size = s.size AND x.phrase = array_to_string(w[place + 1:place + s.size], ' ')
), hits AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS word FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM found WHERE item_id IS NOT NULL GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id LEFT JOIN items i ON i.doc_id = w.doc_id
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@query("op5_language_model")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return language_scores(table(spark, sf_dir, "documents"), held_out)


@query(
    "op3_repeats",
    r"""
WITH texts AS (
    SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), starts AS (
    SELECT doc_id, b, unnest(range(1, n - 398)) AS s FROM texts WHERE n >= 400
), named AS (
    SELECT doc_id, s, md5(array_slice(b, s, s + 399)) AS name FROM starts
), twice AS (
    SELECT doc_id, s FROM named WHERE name IN (SELECT name FROM named GROUP BY name HAVING count(*) > 1)
), islands AS (
    SELECT doc_id, min(s) AS lo, max(s) + 400 AS hi FROM (
        SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (
            SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM twice))
    GROUP BY doc_id, island
), gone AS (
    SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM islands GROUP BY doc_id
), pieces AS (
    SELECT i.doc_id, lo AS place, array_slice(b, coalesce(lag(hi) OVER (PARTITION BY i.doc_id ORDER BY lo), 1), lo - 1) AS piece
    FROM islands i JOIN texts t ON t.doc_id = i.doc_id
    UNION ALL SELECT t.doc_id, n + 1, array_slice(b, max(hi), n) FROM islands i JOIN texts t ON t.doc_id = i.doc_id GROUP BY t.doc_id, b, n
), kept AS (
    SELECT doc_id, list_reduce(list(piece ORDER BY place), lambda x, y: x || y) AS b FROM pieces GROUP BY doc_id
)
SELECT t.doc_id, t.n AS n_bytes, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, coalesce(g.n_spans, 0) AS n_spans,
       sha256(coalesce(k.b, t.b)) AS kept_sha256
FROM texts t LEFT JOIN gone g ON g.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


@query(
    "op12_line_dedup",
    r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(without_shared_lines(table(spark, sf_dir, "documents")))


@query(
    "op11_periodic_runs",
    r"""
WITH texts AS (
    SELECT doc_id, CRC AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sized AS (
    SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts
), planted AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
           w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
    FROM sized
), words AS (
    SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM planted
), pairs AS (
    SELECT a.doc_id, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word
    AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), stretches AS (
    SELECT doc_id, q, min(i) AS s, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
    GROUP BY doc_id, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6
), runs AS (
    SELECT * FROM stretches x WHERE NOT EXISTS (SELECT 1 FROM stretches y WHERE y.doc_id = x.doc_id AND y.q < x.q
    AND y.s <= x.s AND y.s + y.length >= x.s + x.length)
), listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', length, ',', q, chr(10)), '' ORDER BY s, q) AS listed,
           first(s ORDER BY length DESC, s, q) AS start, max(length) AS length, first(q ORDER BY length DESC, s, q) AS period
    FROM runs GROUP BY doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs
), kept AS (
    SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
""".replace("CRC", CRC32.format(x="CAST(doc_id AS VARCHAR)")),
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run_digest(periodic_runs(docs.withColumn("text", planted(F.col("doc_id"), F.col("text")))))


@query(
    "op13_prefix_trie",
    r"""
WITH numbered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
           md5(concat(length(coalesce(role, '')), ':', role, text)) AS name
    FROM conversations WHERE conv_id IS NOT NULL
), talks AS (
    SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS head, CRC % 4 AS h FROM numbered
), turns AS (
    SELECT t.conv_id, n.place, n.words, n.name FROM talks t JOIN numbered n ON n.conv_id = t.head AND n.place < t.h
    UNION ALL SELECT t.conv_id, n.place, n.words, n.name FROM talks t JOIN numbered n ON n.conv_id = t.conv_id AND n.place >= t.h
), paths AS (
    SELECT conv_id, row_number() OVER o AS depth, words, md5(string_agg(name, '') OVER o) AS path,
           count(*) OVER (PARTITION BY conv_id) AS size
    FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY place)
), members AS (
    SELECT conv_id, depth, words, path, lag(path, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = size AS ends FROM paths
    UNION ALL SELECT conv_id, 0, 0, 'root', NULL, conv_id NOT IN (SELECT conv_id FROM turns) FROM talks
), nodes AS (
    SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, min(up) AS up, min(words) AS words, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY path
), children AS (
    SELECT up AS path, count(*) AS n FROM nodes GROUP BY up
), below AS (
    SELECT m.path, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved
    FROM nodes b LEFT JOIN children c ON c.path = b.path
    JOIN members x ON x.conv_id = b.conv_id AND x.depth = b.depth
    JOIN members m ON m.conv_id = b.conv_id AND m.depth <= b.depth GROUP BY m.path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN nodes p ON p.path = n.up LEFT JOIN children c ON c.path = n.path
""".replace("CRC", CRC32.format(x="CAST(conv_id AS VARCHAR)")),
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(grafted(turns_of(table(spark, sf_dir, "conversations"))))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
