"""Queries over packs, releases and lint, with their SQL."""

from pyspark.sql import functions as F

from reelspan.functions import text as tx
from reelspan.operators import matching, packs as pk
from reelspan.plans.fixtures import ctes, table
from reelspan.plans.registry import query

c = F.col


def of(name, columns):
    """Rows that follow from a driver table: the same expressions for Spark and for DuckDB."""
    return (lambda s, d: table(s, d, name).selectExpr(*columns)), f"(SELECT {', '.join(columns)} FROM {name})"


V = "VARCHAR(20)"
parts, PARTS = of("part", ["p_partkey AS k", f"concat('pkg_', CAST(p_partkey % 50 AS {V}))  AS name", f"concat(CAST(p_partkey % 3 AS {V}), '.', CAST(p_partkey % 5 AS {V}), CASE WHEN p_partkey % 4 = 0 THEN '+cu' ELSE '' END) AS version", f"concat('m', CAST(p_partkey % 9 AS {V})) AS machine"])
query("join8_missing_pins", lambda s, d: matching.missing_pins(parts(s, d).select("machine", F.concat(F.upper("name"), F.lit("=="), F.split("version", r"\+")[0]).alias("pin")).distinct(), parts(s, d).where("k % 2 = 0").select("machine", F.replace("name", F.lit("_"), F.lit("-")).alias("name"), "version")),
      f"WITH q AS {PARTS}, r AS (SELECT DISTINCT machine, upper(name) AS n, split_part(version, '+', 1) AS v FROM q), i AS (SELECT machine, lower(replace(name, '_', '-')) AS n, version AS v FROM q WHERE k % 2 = 0) SELECT machine, n || '==' || v AS pin FROM r WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.machine = r.machine AND i.n = lower(replace(r.n, '_', '-')) AND (i.v = r.v OR starts_with(i.v, r.v || '+')))")
query("txt18_normalise_package", lambda s, d: parts(s, d).select("k", tx.normalise_package(F.upper("name")).alias("name")), f"SELECT k, replace(lower(name), '_', '-') AS name FROM {PARTS}")
query("join9_missing_assets", lambda s, d: matching.missing_assets(parts(s, d).select(c("machine").alias("pack"), F.concat("name", F.lit("/"), "version").alias("path")).distinct(), parts(s, d).where("k % 3 > 0").groupBy(F.concat("name", F.lit("/"), "version").alias("path")).agg((F.sum("k") % 4).alias("size"))),
      f"WITH q AS {PARTS}, f AS (SELECT name || '/' || version AS path, CAST(sum(k) % 4 AS BIGINT) AS size FROM q WHERE k % 3 > 0 GROUP BY 1), r AS (SELECT DISTINCT machine AS pack, name || '/' || version AS path FROM q) SELECT pack, r.path, CASE WHEN size IS NULL THEN 'missing' ELSE 'empty' END AS reason FROM r LEFT JOIN f USING (path) WHERE size IS NULL OR size = 0")
packed = lambda s, d: parts(s, d).select(c("k").alias("id"), F.when(c("k") % 7 > 0, F.concat(F.lit("face"), (c("k") % 30).cast("string"))).alias("face"), F.when(c("k") % 11 == 0, "{}").alias("inline"))
known = lambda s, d: parts(s, d).where("k <= 20").select(F.concat(F.lit("face"), c("k").cast("string")).alias("name"), F.concat(F.lit("doc"), c("k").cast("string")).alias("doc"))
query("join10_resolve_faces", lambda s, d: matching.resolve_faces(packed(s, d), known(s, d), "plain")[0],
      f"SELECT k AS id, CASE WHEN k % 7 > 0 THEN 'face' || (k % 30) END AS face, CASE WHEN k % 11 = 0 THEN '{{}}' WHEN k % 7 > 0 AND k % 30 BETWEEN 0 AND 20 THEN 'doc' || (k % 30) ELSE 'plain' END AS doc FROM {PARTS}")
query("join10_unknown_faces", lambda s, d: matching.resolve_faces(packed(s, d), known(s, d), "plain")[1], f"SELECT k AS id, 'unknown face face' || (k % 30) AS problem FROM {PARTS} WHERE k % 11 > 0 AND k % 7 > 0 AND NOT k % 30 BETWEEN 0 AND 20")
query("join13_checksum_mismatches", lambda s, d: matching.checksum_mismatches(parts(s, d).select(F.concat(F.lit("f"), c("k").cast("string")).alias("file"), F.md5("name").alias("sha256")), parts(s, d).select(F.concat(F.lit("f"), c("k").cast("string")).alias("file"), F.when(c("k") % 5 == 0, "").when(c("k") % 6 == 0, "0bad").otherwise(F.upper(F.md5("name"))).alias("sha256"))),
      f"SELECT 'f' || k AS file, md5(name) AS sha256, '0bad' AS want FROM {PARTS} WHERE k % 5 > 0 AND k % 6 = 0")
query("sel13_order_versions", lambda s, d: parts(s, d).select("k", F.array_join(tx.version_key(F.when(c("k") % 10 == 0, "none").otherwise(F.concat("version", F.lit(".7.8.9")))), ".").alias("v")), f"SELECT k, CASE WHEN k % 10 = 0 THEN '0' ELSE array_to_string(regexp_extract_all(version || '.7.8.9', '\\d+')[1:4], '.') END AS v FROM {PARTS}")
#: A patch for each supplier; its minimum is half its number, so that the longest path grows with the logarithm of the patches.
FEED = "SELECT s_suppkey AS i, concat('1.', CAST(s_suppkey AS VARCHAR(20)), '.0') AS version, concat('1.', CAST(CAST(floor(s_suppkey / 2) AS INT) AS VARCHAR(20)), '.0') AS min_version, concat('p', CAST(s_suppkey AS VARCHAR(20))) AS file FROM supplier"
feed = lambda s, d: s.sql(FEED.replace("FROM supplier", "FROM {supplier}"), supplier=table(s, d, "supplier"))
query("src16_build_feed", lambda s, d: pk.build_feed(feed(s, d).select(F.when(c("i") % 9 > 0, c("version")).alias("version"), "file", F.lit("x").alias("sha256"), c("i").alias("size"))).select("skipped", "latest", F.array_join(c("patches.version"), "|").alias("versions")),
      f"WITH q AS ({FEED}) SELECT count(*) FILTER (i % 9 = 0) AS skipped, '1.' || max(i) FILTER (i % 9 > 0) || '.0' AS latest, string_agg(version, '|' ORDER BY i) FILTER (i % 9 > 0) AS versions FROM q")
query("sel14_upgrade_path", lambda s, d: pk.upgrade_path(table(s, d, "customer").select(c("c_custkey").alias("machine"), F.concat(F.lit("1."), (c("c_custkey") % 30).cast("string"), F.lit(".0")).alias("version")), feed(s, d)),
      f"""WITH RECURSIVE q AS ({FEED}), p AS (SELECT version, i AS v, i // 2 AS m FROM q),
      w AS (SELECT c_custkey AS machine, c_custkey % 30 AS at, -1 AS step, '' AS version FROM customer UNION ALL
        SELECT machine, nx.v, step + 1, nx.version FROM w, LATERAL (SELECT max(p.v) AS v, arg_max(p.version, p.v) AS version FROM p WHERE p.v > w.at AND p.m <= w.at) nx WHERE nx.v IS NOT NULL)
      SELECT machine, step, version FROM w WHERE step >= 0""")
DOC = "concat('{\"a\": ', CAST({k} % 5 AS VARCHAR(20)), ', \"_note\": 1, \"b\": {\"x\": ', CAST({k} % 7 AS VARCHAR(20)), ', \"y\": [1, 2], \"use\": \"p\"}, \"schema\": 2}')"
docs = lambda s, d: parts(s, d).select(c("k").alias("id"), F.expr(DOC.replace("{k}", "k")).alias("doc"))
query("jsn1_strip_meta", lambda s, d: pk.strip_meta(pk.flatten(docs(s, d))).select("id", "path", F.regexp_replace("value", r"\s", "").alias("value")),
      f"SELECT k AS id, unnest(['a', 'b/x', 'b/y']) AS path, unnest([CAST(k % 5 AS VARCHAR), CAST(k % 7 AS VARCHAR), '[1,2]']) AS value FROM {PARTS}")
over = lambda s, d: parts(s, d).select(c("k").alias("id"), F.expr("CASE k % 3 WHEN 0 THEN '{\"b\": 9}' WHEN 1 THEN '{\"b\": {\"x\": 8}, \"n\": 1}' ELSE '{\"a\": {\"z\": 3}}' END").alias("doc"))
query("jsn2_deep_merge", lambda s, d: pk.deep_merge(pk.strip_meta(pk.flatten(docs(s, d))), pk.flatten(over(s, d))).select("id", "path", F.regexp_replace("value", r"\s", "").alias("value")),
      f"""WITH q AS {PARTS} SELECT k AS id, unnest(CASE k % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['a', 'b/x', 'b/y', 'n'] ELSE ['a/z', 'b/x', 'b/y'] END) AS path,
      unnest(CASE k % 3 WHEN 0 THEN [CAST(k % 5 AS VARCHAR), '9'] WHEN 1 THEN [CAST(k % 5 AS VARCHAR), '8', '[1,2]', '1'] ELSE ['3', CAST(k % 7 AS VARCHAR), '[1,2]'] END) AS value FROM q""")
users = lambda s, d: parts(s, d).select(c("k").alias("id"), F.when(c("k") % 4 > 0, F.concat(F.lit("p"), (c("k") % 12).cast("string"))).alias("use"))
presets = lambda s, d: parts(s, d).where("k <= 9").select(F.concat(F.lit("p"), c("k").cast("string")).alias("preset"), F.when(c("k") % 3 > 0, F.concat(F.lit("p"), (c("k") % 5 + 2).cast("string"))).alias("use"))
query("jsn3_expand_use", lambda s, d: pk.expand_use(users(s, d), presets(s, d))[0],
      f"""WITH RECURSIVE q AS {PARTS}, p AS (SELECT 'p' || k AS preset, CASE WHEN k % 3 > 0 THEN 'p' || (k % 5 + 2) END AS use FROM q WHERE k <= 9),
      w AS (SELECT k AS id, p.preset, p.use, 0 AS depth, [p.preset] AS seen FROM q JOIN p ON k % 4 > 0 AND p.preset = 'p' || (k % 12) UNION ALL SELECT id, p.preset, p.use, depth + 1, list_append(seen, p.preset) FROM w JOIN p ON p.preset = w.use WHERE NOT list_contains(seen, p.preset))
      SELECT id, preset, depth FROM w""")
query("jsn3_problems", lambda s, d: pk.expand_use(users(s, d), presets(s, d))[1],
      f"""WITH RECURSIVE q AS {PARTS}, p AS (SELECT 'p' || k AS preset, CASE WHEN k % 3 > 0 THEN 'p' || (k % 5 + 2) END AS use FROM q WHERE k <= 9),
      w AS (SELECT k AS id, 'p' || (k % 12) AS preset, CAST([] AS VARCHAR[]) AS seen FROM q WHERE k % 4 > 0 UNION ALL SELECT id, p.use, list_append(seen, w.preset) FROM w JOIN p ON p.preset = w.preset WHERE p.use IS NOT NULL AND NOT list_contains(seen, w.preset))
      SELECT id, preset, CASE WHEN list_contains(seen, preset) THEN 'cycle' ELSE 'unknown' END AS problem FROM w WHERE list_contains(seen, preset) OR preset NOT IN (SELECT preset FROM p)""")
#: Documents that use presets: a chain of up to fifteen inside lists, a cycle, an unknown one, nested uses of one place, one that is a list.
USING = """CASE k % 5 WHEN 0 THEN concat('{"use":"p', CAST(k % 15 + 1 AS VARCHAR(20)), '","same":"own"}') WHEN 1 THEN '{"a":{"use":"c1","x":1}}' WHEN 2 THEN concat('{"m":[1,{"use":"gone', CAST(k AS VARCHAR(20)), '","q":2}]}')
  WHEN 3 THEN '{"o":{"use":"c3"},"use":"c4"}' ELSE '{"use":"c5","_n":{"use":"p1"},"schema":3,"e":{}}' END"""
PRESET = """CASE WHEN k < 15 THEN concat('{"l":[{"use":"p', CAST(k + 1 AS VARCHAR(20)), '","k":', CAST(k AS VARCHAR(20)), '}],"same":', CAST(k AS VARCHAR(20)), '}') WHEN k = 15 THEN '{"end":1,"same":15}'
  WHEN k = 16 THEN '{"b":{"use":"c2"},"x":0,"y":7}' WHEN k = 17 THEN '{"z":[{"use":"c1"}]}' WHEN k = 18 THEN '{"v":{"w":1}}' WHEN k = 19 THEN '{"o":{"v":5,"t":2},"u":[1]}' ELSE '[1]' END"""
expanded = lambda s, d: pk.expand_documents(parts(s, d).select(c("k").alias("id"), F.expr(USING).alias("doc")), parts(s, d).where("k <= 20").select(F.expr("CASE WHEN k <= 15 THEN concat('p', k) ELSE concat('c', k - 15) END").alias("preset"), F.expr(PRESET).alias("doc")))
query("jsn3_expand_documents", lambda s, d: pk.flatten(expanded(s, d)[0]),
      f"""WITH RECURSIVE q AS {PARTS}, t AS (SELECT 15 AS j, '{{"end":1,"k":14,"same":15}}' AS e UNION ALL SELECT j - 1, '{{"k":' || (j - 2) || ',"l":[' || e || '],"same":' || (j - 1) || '}}' FROM t WHERE j > 2),
      w AS (SELECT k AS id, CASE k % 5 WHEN 0 THEN CASE WHEN k % 15 = 14 THEN [['end', '1'], ['same', 'own']] ELSE [['l', '[' || e || ']'], ['same', 'own']] END WHEN 1 THEN [['a/b/z', '[{{}}]'], ['a/x', '1'], ['a/y', '7']] WHEN 2 THEN [['m', '[1,{{"q":2}}]']]
        WHEN 3 THEN [['o/t', '2'], ['o/v/w', '1'], ['u', '[1]']] ELSE [['e', '{{}}']] END AS rows FROM q LEFT JOIN t ON k % 5 = 0 AND j = k % 15 + 2)
      SELECT id, r[1] AS path, r[2] AS value FROM (SELECT id, unnest(rows) AS r FROM w)""")
query("jsn3_document_problems", lambda s, d: expanded(s, d)[1],
      f"""SELECT k AS id, CASE k % 5 WHEN 1 THEN 'a/b/z/0' WHEN 2 THEN 'm/1' ELSE '' END AS path, CASE k % 5 WHEN 1 THEN 'c1' WHEN 2 THEN 'gone' || k ELSE 'c5' END AS preset,
      CASE k % 5 WHEN 1 THEN 'cycle' WHEN 2 THEN 'unknown' ELSE 'not an object' END AS problem FROM {PARTS} WHERE k % 5 IN (1, 2, 4)""")
raw = lambda s, d: parts(s, d).select(F.concat(F.lit("f"), c("k").cast("string")).alias("path"), F.expr("CASE k % 4 WHEN 0 THEN '{bad' WHEN 1 THEN '[1]' ELSE '{\"a\": 1}' END").alias("doc"))
query("src11_pack_problems", lambda s, d: pk.sort_packs(raw(s, d))[1], f"SELECT 'f' || k AS path, CASE k % 4 WHEN 0 THEN 'unreadable JSON' ELSE 'not an object' END AS problem FROM {PARTS} WHERE k % 4 < 2")
groups = lambda s, d: parts(s, d).select(F.concat(F.lit("c"), c("k").cast("string")).alias("id"), F.expr("CASE k % 5 WHEN 0 THEN 'News' WHEN 1 THEN 'music' WHEN 2 THEN 'Film' ELSE 'sport' END").alias("grp"))
wanted = lambda s, d: table(s, d, "region").select(F.when(c("r_regionkey") % 2 == 0, "NEWS").when(c("r_regionkey") == 1, "film").otherwise("radio").alias("grp")).distinct()
GROUPS = f"(SELECT 'c' || k AS id, CASE k % 5 WHEN 0 THEN 'News' WHEN 1 THEN 'music' WHEN 2 THEN 'Film' ELSE 'sport' END AS grp FROM {PARTS})"
query("agg16_packs_by_group", lambda s, d: pk.packs_by_group(groups(s, d)).select("grp", F.array_join("ids", "|").alias("ids")), f"SELECT grp, string_agg(id, '|' ORDER BY id) AS ids FROM {GROUPS} GROUP BY grp")
query("exp25_keep_groups", lambda s, d: pk.keep_groups(groups(s, d), wanted(s, d))[0], f"SELECT id, grp FROM {GROUPS} WHERE lower(grp) IN ('news', 'film')")
query("set2_unknown_groups", lambda s, d: pk.unknown_groups(groups(s, d), wanted(s, d)), "SELECT DISTINCT 'radio' AS grp FROM region")
lines = lambda s, d: table(s, d, "lines")
exempt = lambda s, d: table(s, d, "documents").where("doc_id % 10 = 0").select(c("doc_id").alias("path"))
CLASS = pk.ALLOWED.replace("'", "''")
FOUND = f"""ch AS (SELECT path, n, unnest(regexp_extract_all(line, '[^\\x00-\\x7F{CLASS}]')) AS what FROM lines), wd AS (SELECT DISTINCT path, n, 'word' AS kind, unnest(list_intersect(list_distinct(regexp_extract_all(lower(line), '[a-z]+')), [{', '.join(f"'{w}'" for w in pk.FOREIGN)}])) AS what FROM lines),
fd AS (SELECT path, n, CASE WHEN length(strip_accents(what)) > 0 AND strip_accents(what) <> what AND regexp_matches(what, '\\p{{L}}') THEN 'accented letter' WHEN regexp_matches(what, '\\p{{L}}') THEN 'non-Latin letter' ELSE 'unexpected symbol' END AS kind, what FROM ch UNION ALL SELECT * FROM wd)"""
query("txt12_lint_documents", lambda s, d: pk.lint_documents(lines(s, d), exempt(s, d))[0].groupBy("path", "kind", "what").agg(F.count("*").alias("n")), ctes("lines") + f", {FOUND} SELECT path, kind, what, count(*) AS n FROM fd WHERE path % 10 <> 0 GROUP BY ALL")
query("set4_stale_exemptions", lambda s, d: pk.lint_documents(lines(s, d), exempt(s, d))[1], ctes("lines") + f", {FOUND} SELECT doc_id AS path FROM documents WHERE doc_id % 10 = 0 AND doc_id NOT IN (SELECT path FROM fd)")
query("txt17_asset_path", lambda s, d: table(s, d, "pages").select("page_id", tx.asset_path(F.expr("CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN './a.png' WHEN 2 THEN 'fonts/x.ttf' WHEN 3 THEN 'data:abc' ELSE ' ' END"), F.lit("packs/p")).alias("path")), "SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'packs/p/a.png' WHEN 2 THEN 'frontend/fonts/x.ttf' END AS path FROM pages")
