"""The queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import audio_digests
from .decontamination import find_leaks
from .language_model import interpolated_scores
from .licence_texts import EQUAL_SPELLINGS, NOTICES, TEXTS
from .licences import COPYRIGHT_LINE, LOWER, NO_STATEMENT, OTHER_ASCII, RIGHTS_LINE, UPPER, scan_licences
from .near_duplicates import near_duplicate_classes
from .packing import pack_documents
from .scratch import documents
from .secrets import secret_digests
from .sharding import histogram_shards
from .toxicity import toxicity_scores
from .training_order import write_training_order


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), with_ids=False)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_training_order(documents(spark, sf_dir))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(documents(spark, sf_dir))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digests(documents(spark, sf_dir))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text_digest", "license_id", "notices")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _normalised_sql(text: str) -> str:
    out = f"concat(chr(10), translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), chr(10))"
    out = f"regexp_replace(replace({out}, chr(10), concat(chr(10), chr(10))), {_sql(NO_STATEMENT)}, concat(chr(10), chr(1), '\\1'), 'g')"
    out = f"regexp_replace(regexp_replace({out}, {_sql(COPYRIGHT_LINE)}, chr(10), 'g'), {_sql(RIGHTS_LINE)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {_sql(OTHER_ASCII)}, ' ', 'g')"
    out = f"concat(trim({out}), ' ')"
    for a, b in EQUAL_SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


def _values(rows) -> str:
    return ", ".join(f"({_sql(a)}, {_sql(b)})" for a, b in rows)


OP9_SQL = f"""
WITH known AS (SELECT sha256({_normalised_sql('t')}) AS digest, min(id) AS license_id FROM (VALUES {_values(TEXTS)}) k(id, t) GROUP BY 1),
notice AS (SELECT sha256({_normalised_sql('t')}) AS digest, min(id) AS license_id FROM (VALUES {_values(NOTICES)}) k(id, t) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents),
hit AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
        FROM line JOIN notice ON sha256({_normalised_sql('l')}) = digest WHERE contains(translate(l, '{UPPER}', '{LOWER}'), 'licen') GROUP BY doc_id)
SELECT d.doc_id, sha256({_normalised_sql('d.text')}) AS text_digest, k.license_id, coalesce(h.notices, '') AS notices
FROM documents d LEFT JOIN known k ON k.digest = sha256({_normalised_sql('d.text')}) LEFT JOIN hit h ON h.doc_id = d.doc_id
"""

#: All pairs of sets that share a shingle, links by exact similarity, and the closure of links: for small tables.
OP8_SQL = rf"""
WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
held AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM word),
size AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
link AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id <= coalesce(y, d.doc_id) AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.x = d.doc_id
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_training_order": op5_training_order,
    "op6_language_model": op6_language_model,
    "op7_audio": op7_audio,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_licences": op9_licences,
    "op10_sharding": op10_sharding,
}
ORACLES = {"op8_near_duplicates": OP8_SQL, "op9_licences": OP9_SQL}
