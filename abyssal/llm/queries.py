"""Queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontaminate, language, lines, neighbours, packing, quality, ranking, recompression, secrets, sharding, simhash, suffix
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("sig")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"), width=3, seed=42)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=2048)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"), length=100)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("sig")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), query_every=50, k=5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digest(table(spark, sf_dir, "documents"), length=50)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"), held_out_fold=2)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), fit_rows=1000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_simhash, op4_packing, op5_line_dedup, op6_suffix_dedup, op7_quality, op8_neighbours, op9_substring_dedup, op10_language, op11_codes, op12_ranking, op13_secrets)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the other operators are tested against brute force."""
    return {"op5_line_dedup": LINES_SQL, "op6_suffix_dedup": STRINGS_SQL, "op8_neighbours": NEIGHBOURS_SQL, "op9_substring_dedup": WINDOWS_SQL, "op11_codes": CODES_SQL, "op12_ranking": RANKING_SQL}


LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
 m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

WINDOWS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 g AS (SELECT doc_id, s, md5(array_to_string(ws[s : s + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w)),
 f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
 r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM g JOIN f USING (h) WHERE doc_id > first),
 k AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
 m AS (SELECT k.doc_id, k.p, k.ws[k.p] AS word, r.p IS NOT NULL AS gone FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.p = k.p),
 a AS (SELECT doc_id, sum(gone::INT)::BIGINT AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)
"""

STRINGS_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 o AS (SELECT doc_id, base, substr(x, 2 * base + 1, 2 * 599) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2, 500)) AS base FROM b)),
 g AS (SELECT doc_id, base + i AS s, md5(substr(y, 2 * i - 1, 200)) AS h FROM (SELECT doc_id, base, y, unnest(range(1, length(y) // 2 - 98)) AS i FROM o)),
 f AS (SELECT h, min((doc_id, s)) AS first FROM g GROUP BY h HAVING count(*) > 1),
 r AS (SELECT doc_id, s, s + 100 AS e FROM g JOIN f USING (h) WHERE (doc_id, s) > first),
 n AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
 k AS (SELECT *, sum((before IS NULL OR s > before)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM n),
 m AS (SELECT doc_id, span, min(s) AS s, max(e) AS e FROM k GROUP BY 1, 2),
 c AS (SELECT doc_id, s, e, lag(e, 1, 1) OVER (PARTITION BY doc_id ORDER BY s) AS since FROM m),
 a AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(x, 2 * since - 1, 2 * (s - since)), '' ORDER BY s) AS front FROM c JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN last IS NULL THEN x ELSE front || substr(x, 2 * last - 1) END)) AS kept_sha256
FROM b LEFT JOIN a USING (doc_id)
"""

NEIGHBOURS_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
 u AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(q.v, lambda x, i: x * c.v[i]), lambda a, b: a + b) / (q.n * c.n) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 5
"""


def _codes_sql(rounds: int = 4) -> str:
    """Parts as rows (vec_id, part, v, lists of doubles that hold integers); each round assigns all and takes the means."""
    near = "list_dot_product(c, c) - 2 * list_dot_product(v, c)"
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS (SELECT vec_id, p::INT AS part, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM k, range(4) r(p))",
        "b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256)",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT vec_id, p.part, v, arg_min(entry, ({near}, entry)) AS entry FROM p JOIN b{i} USING (part) GROUP BY vec_id, p.part, v)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT part, entry, j, floor(sum(v[j]) / count(*)) AS x FROM a{i}, range(1, 129) r(j) WHERE j <= len(v) GROUP BY ALL)")
            steps.append(f"n{i} AS (SELECT part, entry, list(x ORDER BY j) AS c FROM m{i} GROUP BY ALL)")
            steps.append(f"b{i + 1} AS (SELECT part, entry, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} USING (part, entry))")
    last = f"b{rounds}"
    return f"""WITH {', '.join(x.replace(' AS (', ' AS MATERIALIZED (', 1) for x in steps)},
 e AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(list_dot_product(v, v) + {near})::BIGINT AS error FROM a{rounds} JOIN {last} USING (part, entry) GROUP BY 1),
 y AS (SELECT label, sum(error)::BIGINT AS label_error FROM e JOIN k USING (vec_id) GROUP BY 1),
 h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {last})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM e JOIN k USING (vec_id) JOIN y ON y.label IS NOT DISTINCT FROM k.label, h
"""


CODES_SQL = _codes_sql()


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
RANKING_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS} FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY 1),
 g AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM l), q AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
 w AS (SELECT term, floor(1000 * ln((2 * any_value(g.N) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term),
 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * l.n * g.N) // g.L))))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN l USING (doc_id), g GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
