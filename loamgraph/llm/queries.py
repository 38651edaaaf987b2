"""The operators' queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .decontaminate import contamination, contamination_digests
from .exact_dedup import exact_groups
from .fingerprints import document_fingerprints
from .jaccard import similarity_components
from .language import language_table
from .ngram_resampling import importance_resample
from .packing import pack
from .periods import periodic_runs, run_digests
from .quality import resample
from .repeats import repeat_digests
from .token_counts import token_counts
from .token_files import token_round_trip
from .viterbi import encode_decode

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))


#: Hex digits stand for the bytes, two each; a string starts a new run where it doesn't touch the run before.
OP1_SQL = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), g AS MATERIALIZED (
  SELECT rid, p, md5_number(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS k FROM (SELECT rid, h, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)
), s AS (
  SELECT rid, p FROM g SEMI JOIN (SELECT k FROM g GROUP BY k HAVING count(*) > 1) AS again USING (k)
), r AS (
  SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run FROM (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM s)
), runs AS (
  SELECT rid, min(p) AS a, max(p) + 200 AS b FROM r GROUP BY rid, run
), before AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS done FROM runs
), cut AS (
  SELECT rid, sum(b - a) AS removed, count(*) AS spans, max(b) AS rest, string_agg(substr(h, CAST(2 * done + 1 AS BIGINT), CAST(2 * (a - done) AS BIGINT)), '' ORDER BY a) AS kept FROM before JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE concat(kept, substr(h, CAST(2 * rest + 1 AS BIGINT))) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""


def op2_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_table(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op6_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents(spark, sf_dir), width=3, percent=90)


#: Links between texts with one set of shingles are those of its least row; components spread by their least row.
OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), e AS MATERIALIZED (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])))) END AS own FROM d
), c AS MATERIALIZED (
  SELECT own, len(own) AS n, min(rid) AS cid FROM e GROUP BY own
), x AS MATERIALIZED (
  SELECT cid, n, unnest(own) AS shingle FROM c
), link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.cid AS a, y.cid AS b, x.n + y.n - count(*) AS whole, count(*) AS common FROM x JOIN x y ON x.shingle = y.shingle AND x.cid <> y.cid AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY x.cid, y.cid, x.n, y.n) WHERE 100 * common >= 90 * whole
), reach AS (
  SELECT cid AS a, cid AS b FROM c UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), part AS (
  SELECT a AS cid, min(b) AS part FROM reach GROUP BY a
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY part) END AS component_id
FROM e JOIN c USING (own) JOIN part USING (cid)
"""


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


def op8_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


def op10_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))


def planted_period(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Every tenth document by hash, of n words, repeats from word a on with period p; one without an id doesn't."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(documents(spark, sf_dir), rewrite=planted_period))


#: The CRC-32 of a string, by the table of the 256 bytes' remainders.
CRC32 = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS remainders FROM (SELECT unnest(range(0, 256)) AS b)
)"""


def _crc32_of(text: str) -> str:
    """The CRC-32 of a SQL string expression, where crc_table is joined."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, remainders[xor(c & 255, b) + 1])))"


#: Six words that a text has twice, their distance q, and stretches of such places: each is a run where q is its smallest period.
OP11_SQL = rf"""
WITH {CRC32}, d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents
), e AS (
  SELECT rid, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32_of("CAST(doc_id AS VARCHAR)")} END AS h FROM d, crc_table
), f AS (
  SELECT rid, doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN h // 10 % n ELSE n END AS a, h // 10 AS g FROM e
), t AS MATERIALIZED (
  SELECT rid, doc_id, n, list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) AS w FROM f
), gram AS MATERIALIZED (
  SELECT rid, i, md5_number(array_to_string(w[i + 1 : i + 6], ' ')) AS k FROM (SELECT rid, w, unnest(range(0, n - 5)) AS i FROM t)
), pair AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.rid = y.rid AND x.k = y.k AND y.i > x.i
), stretch AS (
  SELECT rid, q, min(i) AS a, max(i) + 6 + q AS b FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS part FROM pair) GROUP BY rid, q, part
), long AS MATERIALIZED (
  SELECT rid, a, b, q FROM stretch WHERE b - a >= 12 AND b - a >= 2 * q
), run AS MATERIALIZED (
  SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.rid = x.rid AND y.q < x.q AND y.a <= x.a AND y.b >= x.b)
), per AS (
  SELECT rid, count(*) AS n_runs, arg_min([a, b - a, q], [a - b, a, q]) AS best, string_agg(concat(a, ',', b - a, ',', q, chr(10)), '' ORDER BY a, q) AS lines FROM run GROUP BY rid
), gone AS (
  SELECT DISTINCT rid, unnest(range(a + q, b)) AS i FROM run
), rest AS (
  SELECT rid, string_agg(w[i + 1], ' ' ORDER BY i) AS kept FROM (SELECT rid, w, unnest(range(0, n)) AS i FROM t SEMI JOIN run USING (rid)) ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(CASE WHEN n_runs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS collapsed_sha256
FROM t LEFT JOIN per USING (rid) LEFT JOIN rest USING (rid)
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def _words_of(text: str) -> str:
    """The lowered words of letters, digits and characters beyond ASCII of a SQL string expression."""
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP12_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, {_words_of("text")} AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words_of("text")} AS w FROM benchmark
), win AS MATERIALIZED (
  SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS k FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), own AS (
  SELECT rid, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS MATERIALIZED (
  SELECT rid, i, n, k FROM own SEMI JOIN win USING (n, k)
), word AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hit) GROUP BY rid
), item AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit JOIN win USING (n, k)) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN word USING (rid) LEFT JOIN item USING (rid)
"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = f"""
WITH {CRC32}, d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, {_words_of("text")} AS w FROM documents
), own AS MATERIALIZED (
  SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY rid, word
), aim AS (
  SELECT word, count(*) AS n FROM (SELECT unnest({_words_of("text")}) AS word FROM benchmark) GROUP BY word
), word AS MATERIALIZED (
  SELECT word, {_crc32_of("word")} % 10000 AS bucket FROM (SELECT word FROM own UNION SELECT word FROM aim), crc_table
), s AS (
  SELECT bucket, sum(n) AS s FROM own JOIN word USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS t FROM aim JOIN word USING (word) GROUP BY bucket
), gain AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM own) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM aim), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)
), per AS (
  SELECT rid, sum(n) AS n_features, sum(n * gain) AS weight FROM own JOIN word USING (word) JOIN gain USING (bucket) GROUP BY rid
), scored AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN per USING (rid)
), drawn AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS FIRST, n_features, rid) AS rank FROM scored WHERE n >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (rid)
"""


def queries() -> dict[str, Query]:
    own = (
        op1_suffix_array,
        op2_trie_counts,
        op3_language,
        op4_resampling,
        op5_packing,
        op6_signature_tree,
        op7_winnowing,
        op8_bit_planes,
        op9_exact_dedup,
        op10_viterbi,
        op11_periodic_runs,
        op12_decontamination,
        op13_resampling,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array": OP1_SQL, "op6_signature_tree": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_resampling": OP13_SQL}
