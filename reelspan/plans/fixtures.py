"""Engine tables derived from the star schema, in SQL that Spark and DuckDB both read."""

import os

from pyspark.sql import DataFrame, SparkSession

#: What the two dialects spell differently.
DIALECT = {
    "spark": {"MS": "unix_millis(cast(ts as timestamp))", "K": "cast(get_json_object(props, '$.k') as int)", "UNNEST_WORDS": "lateral view posexplode(split(trim(text), '\\\\s+')) as pos, word", "POS": "pos", "WORD": "word"},
    "duck": {"MS": "(epoch_us(ts) // 1000)", "K": "cast(json_extract_string(props, '$.k') as int)"},
}
GRABS = """
SELECT user_id AS video_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq,
  ({MS} - min({MS}) OVER (PARTITION BY user_id)) / 1000.0D0 AS ts_s, concat('v', CAST(user_id AS STRING), '/', CAST(event_id AS STRING)) AS path,
  value AS focus, {K} / 100.0D0 AS motion, CAST(event_id % 60 AS DOUBLE) AS contrast
FROM events WHERE user_id IS NOT NULL"""
FIXTURES = {
    "grabs": GRABS,
    "candidates": """
SELECT CAST(floor(vec_id / 200) AS BIGINT) AS video_id, CAST(floor(vec_id / 2) AS BIGINT) AS path, vec_id AS face, CAST(label AS INT) AS character_id,
  CASE WHEN vec_id % 37 = 0 THEN NULL ELSE embedding END AS descriptor, ((vec_id * 7919) % 10007) / 10007.0D0 AS score,
  CAST((vec_id * 31) % 100 AS DOUBLE) AS sharpness, vec_id % 7 <> 0 AS valid
FROM embeddings""",
    "faces": """
SELECT l_orderkey % 50 AS video_id, l_orderkey AS seq, l_linenumber AS face_id, CAST(l_partkey % 1000 AS INT) AS x, CAST(l_suppkey % 500 AS INT) AS y,
  CAST(60 + l_quantity * 4 AS INT) AS w, CAST(60 + l_linenumber * 30 AS INT) AS h, 1920 AS frame_w, 1080 AS frame_h,
  CAST((l_partkey * 13) % 400 AS DOUBLE) AS sharpness, CAST(l_suppkey % 256 AS DOUBLE) AS mean_luma, (l_partkey % 30) / 100.0D0 AS edge_density,
  CAST(l_partkey % 17 AS DOUBLE) AS var_x, CAST(l_suppkey % 13 AS DOUBLE) AS var_y, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS face_count
FROM lineitem""",
    "text_boxes": """
SELECT l_suppkey AS video_id, l_orderkey % 24 AS seq, CAST(l_partkey % 720 AS INT) AS y, CAST(20 + l_linenumber * 4 AS INT) AS h, 720 AS frame_h,
  CAST(l_partkey % 1000 AS INT) AS x, CAST(50 + l_quantity AS INT) AS w FROM lineitem""",
    "sentences": """
SELECT conv_id AS video_id, CAST(turn AS INT) AS sent_id, text, turn * 4000 / 1000.0D0 AS start_s,
  (turn * 4000 + 50 * (length(trim(text)) - length(replace(trim(text), ' ', '')) + 1)) / 1000.0D0 AS end_s
FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL""",
    "moments": """
SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS slot, ((event_id * 977) % 60000) / 1000.0D0 AS ts_s
FROM events WHERE user_id IN (SELECT conv_id FROM conversations)""",
    "pixel": """
SELECT CAST(label AS BIGINT) AS video_id, vec_id AS seq, CAST(floor(p / 8) AS INT) AS y, CAST(p % 8 AS INT) AS x, 128 + 127 * CAST(v AS DOUBLE) AS gray FROM {PIXELS}""",
    "color": """
SELECT CAST(label AS BIGINT) AS video_id, vec_id AS seq, CAST(floor(p / 8) AS INT) AS y, CAST(p % 8 AS INT) AS x, {B} AS b, {G} AS g, {R} AS r FROM {PLANES}""",
    "chests": """
SELECT CAST(label AS BIGINT) AS video_id, vec_id AS seq, 1 AS face_id, CAST(vec_id % 8 AS INT) AS x, CAST(vec_id % 9 - 1 AS INT) AS y, CAST(1 + vec_id % 4 AS INT) AS w, CAST(1 + vec_id % 3 AS INT) AS h FROM embeddings""",
    "words": """
SELECT video_id, idx, text, (idx * 350 + 700 * floor(idx / 11) + 1400 * floor(idx / 29)) / 1000.0D0 AS start_s,
  (idx * 350 + 700 * floor(idx / 11) + 1400 * floor(idx / 29) + 250) / 1000.0D0 AS end_s FROM {WORDS}""",
    "lines": "SELECT doc_id AS path, n, line FROM {LINES}",
    "usage": """
SELECT {MS} / 1000 AS ts_ms, event_id, concat('10.0.0.', CAST(user_id % 256 AS STRING)) AS client_ip, concat('channel', CAST(user_id % 7 AS STRING)) AS channel,
  CAST(user_id AS STRING) AS user, event_type AS action, ts FROM events""",
    "videos": "SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 100 END AS duration_s FROM orders",
}
_LEVEL = "CAST(greatest(0, least(255, floor(128 + 127 * CAST({v} AS DOUBLE)))) AS INT)"
DIALECT["spark"] |= {
    "PLANES": "(SELECT label, vec_id, p, v, embedding FROM embeddings LATERAL VIEW posexplode(embedding) AS p, v)",
    **{k: _LEVEL.replace("{v}", f"embedding[(p + {n}) % size(embedding)]") for k, n in (("B", 0), ("G", 1), ("R", 5))},
    "PIXELS": "(SELECT label, vec_id, p, v FROM embeddings LATERAL VIEW posexplode(embedding) AS p, v)",
    "WORDS": "(SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY turn, p) - 1 AS INT) AS idx, w AS text FROM (SELECT conv_id AS video_id, turn, p, w FROM conversations LATERAL VIEW posexplode(split(text, '[ \\n\\t]+')) AS p, w) WHERE w <> '')",
    "LINES": "(SELECT doc_id, CAST(p AS INT) AS n, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) AS p, line)",
}
DIALECT["duck"] |= {
    "PLANES": "(SELECT label, vec_id, embedding, unnest(range(len(embedding))) AS p FROM embeddings)",
    **{k: _LEVEL.replace("{v}", f"embedding[(p + {n}) % len(embedding) + 1]") for k, n in (("B", 0), ("G", 1), ("R", 5))},
    "PIXELS": "(SELECT label, vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM embeddings)",
    "WORDS": "(SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY turn, p) - 1 AS INT) AS idx, w AS text FROM (SELECT conv_id AS video_id, turn, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[ \\n\\t]+') AS ws FROM conversations)) WHERE w <> '')",
    "LINES": "(SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))",
}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _spell(text: str, dialect: str) -> str:
    for k, v in DIALECT[dialect].items():
        text = text.replace("{" + k + "}", v)
    return text.replace("0D0", "0D" if dialect == "spark" else "0").replace("/ 1000 AS ts_ms", "AS ts_ms")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name, or a derived one."""
    if name not in FIXTURES:
        return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    sql = _spell(FIXTURES[name], "spark")
    import re

    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\bFROM {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **used)


def ctes(*names: str) -> str:
    """WITH clause that gives DuckDB the derived tables."""
    return "WITH " + ", ".join(f"{n} AS ({_spell(FIXTURES[n], 'duck').replace('AS STRING', 'AS VARCHAR')})" for n in names)
