"""Queries over words, sentences and captions, with their SQL."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.functions import text as tx
from reelspan.operators import captions as cp
from reelspan.plans.fixtures import ctes, table
from reelspan.plans.registry import query

c = F.col
words = lambda s, d: table(s, d, "words")
sentences = lambda s, d: table(s, d, "sentences")
T = "'[.!?…][\"''”’)\\]]*$'"
SID = ["video_id", "sent_id"]
RUNS = f"""o AS (SELECT *, regexp_matches(text, {T}) AS stop FROM words),
r AS (SELECT video_id, idx, text, start_s, end_s, stop, 0 AS run, 1 AS n FROM o WHERE idx = 0 UNION ALL
  SELECT o.video_id, o.idx, o.text, o.start_s, o.end_s, o.stop, CASE WHEN r.stop OR (o.start_s - r.end_s >= 0.65 AND r.n >= 4) THEN r.run + 1 ELSE r.run END,
    CASE WHEN r.stop OR (o.start_s - r.end_s >= 0.65 AND r.n >= 4) THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.video_id = r.video_id AND o.idx = r.idx + 1)"""
recursive = lambda *n: ctes(*n).replace("WITH ", "WITH RECURSIVE ", 1)
query("win2_cut_runs", lambda s, d: cp.cut_runs(words(s, d)).select("video_id", "idx", "run"), recursive("words") + f", {RUNS} SELECT video_id, idx, run FROM r")
query("txt1_clean_sentence", lambda s, d: cp.sentence_texts(cp.cut_runs(words(s, d))).select("video_id", "run", "text"),
      recursive("words") + f", {RUNS} SELECT video_id, run, regexp_replace(trim(regexp_replace(string_agg(text, ' ' ORDER BY idx), '\\s+', ' ', 'g')), '[,;:—–]+$', '') AS text FROM r GROUP BY video_id, run")
query("win3_to_6_assemble_sentences", lambda s, d: cp.assemble_sentences(words(s, d)))
query("win7_group_thoughts", lambda s, d: cp.group_thoughts(cp.assemble_sentences(words(s, d))))
query("win8_9_groups_to_target", lambda s, d: cp.group_thoughts(cp.assemble_sentences(words(s, d)), 6))
query("win10_chunk_with_context", lambda s, d: cp.chunk_with_context(sentences(s, d), 4, 2).select("video_id", "chunk", "first", "last", F.array_join("context", "|").alias("context"), F.array_join("lines", "|").alias("lines")),
      ctes("sentences") + """, q AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sent_id) - 1 AS i FROM sentences)
      , k AS (SELECT video_id, i // 4 AS ch, min(i) AS first, max(i) + 1 AS last, string_agg(text, '|' ORDER BY i) AS lines FROM q GROUP BY 1, 2)
      SELECT k.video_id, CAST(ch AS INT) AS chunk, first, last, coalesce(string_agg(p.text, '|' ORDER BY p.i), '') AS context, lines FROM k LEFT JOIN q p ON p.video_id = k.video_id AND p.i BETWEEN ch * 4 - 2 AND ch * 4 - 1 GROUP BY ALL""")
query("txt2_marks", lambda s, d: words(s, d).select("video_id", "idx", tx.ends_terminal(c("text")).alias("terminal"), tx.has_internal_mark(c("text")).alias("internal")),
      ctes("words") + f" SELECT video_id, idx, regexp_matches(text, {T}) AS terminal, regexp_matches(text, '[,;:—–][\"''”’)\\]]*$') AS internal FROM words")
CUTS = """q AS (SELECT video_id, sent_id, text, i FROM sentences, unnest(range(1, length(text))) AS r(i)
    WHERE length(text) > 80 AND regexp_matches(substr(text, i + 1, 1), '\\s') AND regexp_matches(substr(text, 1, i), '[.!?…,;:—–][\"''”’)\\]]*$')),
h AS (SELECT video_id, sent_id, trim(substr(text, 1, i)) AS head, trim(substr(text, i + 1)) AS tail FROM q),
k AS (SELECT * FROM h WHERE length(head) <= 80 AND length(tail) <= 80 AND len(regexp_split_to_array(head, '\\s+')) >= 4 AND len(regexp_split_to_array(tail, '\\s+')) >= 4 AND NOT regexp_matches(tail, '^\\p{Ll}')),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, sent_id ORDER BY abs(length(head) - length(tail)), length(head)) AS r FROM k)"""
query("txt3_split_caption", lambda s, d: sentences(s, d).select(*SID, tx.split_caption(c("text")).alias("p")).select(*SID, F.size("p").alias("n"), c("p")[0].alias("first")),
      ctes("sentences") + f", {CUTS} SELECT s.video_id, s.sent_id, CASE WHEN b.head IS NULL THEN 1 ELSE 2 END AS n, coalesce(regexp_replace(b.head, '[,;:—–]+$', ''), s.text) AS first FROM sentences s LEFT JOIN b ON b.video_id = s.video_id AND b.sent_id = s.sent_id AND b.r = 1")
query("txt4_fit_caption", lambda s, d: sentences(s, d).select(*SID, tx.fit_caption(c("text")).alias("fitted")),
      ctes("sentences") + """, q AS (SELECT *, coalesce((SELECT max(i) FROM unnest(range(1, 161)) AS r(i) WHERE regexp_matches(substr(text, i, 1), '[,;:.!?—–]') AND regexp_matches(substr(text, i + 1, 1), '\\s')), 0) - 1 AS cut FROM sentences)
      SELECT video_id, sent_id, CASE WHEN length(text) <= 160 THEN text WHEN cut < 80 THEN '' ELSE trim(regexp_replace(substr(text, 1, cut + 1), '[,;:—–]+$', '')) END AS fitted FROM q""")
query("txt5_needs_condensing", lambda s, d: sentences(s, d).select(*SID, tx.needs_condensing(c("text")).alias("needs")),
      ctes("sentences") + f", {CUTS} SELECT s.video_id, s.sent_id, length(s.text) > 80 AND b.head IS NULL AS needs FROM sentences s LEFT JOIN b ON b.video_id = s.video_id AND b.sent_id = s.sent_id AND b.r = 1")
TOKENS = "regexp_extract_all(lower(text), '\\p{L}+(?:[''’]\\p{L}+)*')"
query("txt6_word_tokens", lambda s, d: sentences(s, d).select(*SID, F.array_join(tx.word_tokens(c("text")), " ").alias("tokens")), ctes("sentences") + f" SELECT video_id, sent_id, array_to_string({TOKENS}, ' ') AS tokens FROM sentences")
query("txt7_drifted_to_english", lambda s, d: table(s, d, "documents").select("doc_id", tx.drifted_to_english(F.coalesce("text", F.lit(""))).alias("english")),
      "SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+(?:[''’]\\p{L}+)*')), [" + ", ".join(f"'{w}'" for w in tx.ENGLISH) + "])) >= 2 AS english FROM documents")
ANSWER = "concat('- ', CAST({a} AS VARCHAR(9)), '> first of ', CAST(conv_id AS VARCHAR(9)), chr(10), CAST({b} AS VARCHAR(9)), '-', CAST({b} + 1 AS VARCHAR(9)), '> second', chr(10), 'noise', chr(10), CAST({a} AS VARCHAR(9)), '> again', chr(10), '99> far')".format(a="(conv_id % 3)", b="(conv_id % 4)")
query("txt8_parse_answer_lines", lambda s, d: cp.parse_answers(table(s, d, "conversations").select("conv_id").distinct().select(c("conv_id").alias("video_id"), F.lit(0).alias("chunk"), F.lit(0).alias("first"), F.lit(8).alias("last"), F.expr(ANSWER).alias("answer"))),
      """WITH q AS (SELECT DISTINCT conv_id, conv_id % 3 AS a, conv_id % 4 AS b FROM conversations)
      SELECT conv_id AS video_id, 0 AS chunk, a AS start, a AS "end", concat('first of ', conv_id) AS text FROM q UNION ALL SELECT conv_id, 0, b, b + 1, 'second' FROM q WHERE a <> b AND a <> b + 1""")
NAMED = "concat('Anna ', CASE WHEN sent_id % 2 = 0 THEN 'Maria ' ELSE '' END, 'Vogel, the quiet singer, met ', CASE WHEN video_id % 2 = 0 THEN 'her' ELSE 'him' END, ' in Berlin. ', text)"
named = lambda s, d: sentences(s, d).withColumn("text", F.expr(NAMED))
NAMES = f"""n AS (SELECT video_id, sent_id, start_s, end_s, {NAMED} AS text FROM sentences),
t AS (SELECT video_id, sent_id, unnest(range(len(w))) AS i, unnest(w) AS w FROM (SELECT *, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM n)),
u AS (SELECT *, regexp_replace(regexp_replace(w, '^[,.;:!?"''()\\[\\]]+|[,.;:!?"''()\\[\\]]+$', '', 'g'), '(''s|’s)$', '') AS bare FROM t),
v AS (SELECT *, regexp_matches(bare, '^[A-ZÀ-Ü]\\p{{L}}*$') AS cap FROM u),
x AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, sent_id, cap ORDER BY i) AS island FROM v),
names AS (SELECT video_id, sent_id, min(i) AS p0, string_agg(bare, ' ' ORDER BY i) AS name, count(*) AS size FROM x WHERE cap GROUP BY video_id, sent_id, island HAVING count(*) > 1),
pe AS (SELECT video_id, lower(split_part(name, ' ', -1)) AS key, list(name ORDER BY size DESC, sent_id, p0)[1] AS full, list_sort(list(DISTINCT name)) AS spellings FROM names GROUP BY 1, 2)"""
query("txt9_names_in", lambda s, d: named(s, d).select(*SID, F.array_join(tx.names_in(c("text")), "|").alias("names")),
      ctes("sentences") + f", {NAMES} SELECT n.video_id, n.sent_id, coalesce(string_agg(name, '|' ORDER BY p0), '') AS names FROM n LEFT JOIN names m ON n.video_id = m.video_id AND n.sent_id = m.sent_id GROUP BY 1, 2")
query("agg13_people", lambda s, d: cp.people(named(s, d)).select("video_id", "key", "full", F.array_join("spellings", "|").alias("spellings")), ctes("sentences") + f", {NAMES} SELECT video_id, key, pe.full, array_to_string(spellings, '|') AS spellings FROM pe")
query("agg14_gender_evidence", lambda s, d: cp.gender_evidence(cp.people(named(s, d)), named(s, d)).select("video_id", "key", "gender"),
      ctes("sentences") + f""", {NAMES}, l AS (SELECT video_id, lower(text) AS low, list_distinct(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda y: regexp_replace(y, '^[,.;:!?"''()]+|[,.;:!?"''()]+$', '', 'g'))) AS ws FROM n),
      g AS (SELECT pe.video_id, pe.key, sum(len(list_intersect(ws, ['she', 'her', 'hers']))) AS f, sum(len(list_intersect(ws, ['he', 'him', 'his']))) AS m FROM pe JOIN l ON pe.video_id = l.video_id AND (contains(low, lower(pe.full)) OR contains(low, pe.key)) GROUP BY 1, 2)
      SELECT pe.video_id, pe.key, CASE WHEN f > m THEN 'f' WHEN m > f THEN 'm' END AS gender FROM pe LEFT JOIN g USING (video_id, key)""")
query("txt10_find_role", lambda s, d: named(s, d).select(*SID, cp.find_role(F.lit("Vogel"), c("text")).alias("role")), ctes("sentences") + " SELECT video_id, sent_id, 'the quiet singer' AS role FROM sentences")
OPENED = f"""{NAMES}, sp AS (SELECT video_id, key, unnest(spellings) AS spelling FROM pe),
op AS (SELECT n.video_id, n.sent_id, key, spelling, length(spelling) AS size, row_number() OVER (PARTITION BY n.video_id, n.sent_id ORDER BY length(spelling) DESC, key DESC) AS r FROM n JOIN sp ON n.video_id = sp.video_id
  AND starts_with(lower(ltrim(text)), lower(spelling)) AND NOT regexp_matches(substr(ltrim(text), length(spelling) + 1), '^[\\p{{L}}\\p{{N}}-]'))"""
query("txt11_opening_person", lambda s, d: cp.opening_person(named(s, d), cp.people(named(s, d))).select(*SID, "key", "spelling"), ctes("sentences") + f", {OPENED} SELECT n.video_id, n.sent_id, op.key, op.spelling FROM n LEFT JOIN op ON n.video_id = op.video_id AND n.sent_id = op.sent_id AND r = 1")
query("win14_vary_openings", lambda s, d: cp.vary_openings(named(s, d), cp.people(named(s, d))),
      ctes("sentences") + f""", {OPENED}, z AS (SELECT n.video_id, n.sent_id, text, key, spelling, row_number() OVER (PARTITION BY n.video_id ORDER BY n.sent_id) - row_number() OVER (PARTITION BY n.video_id, key ORDER BY n.sent_id) AS island FROM n LEFT JOIN op ON n.video_id = op.video_id AND n.sent_id = op.sent_id AND r = 1),
      y AS (SELECT *, row_number() OVER (PARTITION BY video_id, key, island ORDER BY sent_id) - 2 AS k FROM z),
      l AS (SELECT video_id, lower(text) AS low, list_distinct(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda y: regexp_replace(y, '^[,.;:!?"''()]+|[,.;:!?"''()]+$', '', 'g'))) AS ws FROM n),
      g AS (SELECT pe.video_id, pe.key, sum(len(list_intersect(ws, ['she', 'her', 'hers']))) AS f, sum(len(list_intersect(ws, ['he', 'him', 'his']))) AS m FROM pe JOIN l ON pe.video_id = l.video_id AND (contains(low, lower(pe.full)) OR contains(low, pe.key)) GROUP BY 1, 2),
      ap AS (SELECT video_id, key, sent_id, regexp_extract(text, pat, 1) AS art, regexp_extract(text, pat, 2) AS words FROM (SELECT pe.video_id, pe.key, n.sent_id, n.text, '(?i)' || pe.full || '\\s*,\\s*(the|a|an)\\s+(\\p{{L}}+(?:\\s+\\p{{L}}+)?)' AS pat FROM pe JOIN n ON pe.video_id = n.video_id)),
      rl AS (SELECT video_id, key, arg_min(lower(art) || ' ' || regexp_replace(words, '\\s+', ' ', 'g'), sent_id) AS role FROM ap WHERE words <> '' AND NOT regexp_matches(words, '(^|\\s)[A-ZÀ-Ü]') GROUP BY 1, 2),
      fm AS (SELECT pe.video_id, pe.key, list_filter([split_part(pe.full, ' ', -1), split_part(pe.full, ' ', 1), CASE WHEN f > m THEN 'she' WHEN m > f THEN 'he' END, role], lambda x: x IS NOT NULL) AS forms FROM pe LEFT JOIN g ON pe.video_id = g.video_id AND pe.key = g.key LEFT JOIN rl ON pe.video_id = rl.video_id AND pe.key = rl.key)
      SELECT y.video_id, sent_id, CASE WHEN y.key IS NOT NULL AND k >= 0 THEN upper(forms[1 + k % len(forms)][1]) || forms[1 + k % len(forms)][2:] || substr(ltrim(text), length(spelling) + 1) ELSE text END AS text FROM y LEFT JOIN fm ON y.video_id = fm.video_id AND y.key = fm.key""")
PIECES = f"""{CUTS}, pc AS (SELECT s.video_id, s.sent_id, CASE WHEN b.head IS NULL THEN [s.text] ELSE [regexp_replace(b.head, '[,;:—–]+$', ''), b.tail] END AS p FROM sentences s LEFT JOIN b ON b.video_id = s.video_id AND b.sent_id = s.sent_id AND b.r = 1)"""
#: Every third video has as many frames as sentences, the others twice as many.
frame_ids = lambda s, d: sentences(s, d).select("video_id", F.explode(F.expr("if(video_id % 3 = 0, array(sent_id), array(sent_id * 2, sent_id * 2 + 1))")).alias("frame_id"))
query("win11_deal_captions", lambda s, d: cp.deal_captions(sentences(s, d), frame_ids(s, d)),
      ctes("sentences") + f""", {PIECES}, fr AS (SELECT video_id, unnest(CASE WHEN video_id % 3 = 0 THEN [sent_id] ELSE [sent_id * 2, sent_id * 2 + 1] END) AS frame_id FROM sentences), fc AS (SELECT video_id, count(*) AS frames FROM fr GROUP BY 1),
      ax AS (SELECT pc.video_id, pc.sent_id, s.text, p, frames, coalesce(sum(len(p)) OVER (PARTITION BY pc.video_id ORDER BY pc.sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pc JOIN fc USING (video_id) JOIN sentences s USING (video_id, sent_id)),
      dl AS (SELECT video_id, before + unnest(range(len(q))) AS frame_id, unnest(q) AS piece FROM (SELECT video_id, before, CASE WHEN frames - before >= 2 THEN p ELSE [text] END AS q FROM ax WHERE before < frames))
      SELECT fr.video_id, fr.frame_id, coalesce(piece, '') AS caption FROM fr LEFT JOIN dl USING (video_id, frame_id)""")
query("win12_claim_captions", lambda s, d: cp.claim_captions(sentences(s, d), table(s, d, "moments")),
      ctes("sentences", "moments") + f""", {PIECES}, mt AS (SELECT m.video_id, m.slot, arg_min(s.sent_id, round(greatest(start_s - ts_s, ts_s - end_s, 0), 6) * 1000000 + s.sent_id / 1000.0) AS sent_id FROM moments m JOIN sentences s ON m.video_id = s.video_id AND ts_s BETWEEN start_s - 2.5 AND end_s + 2.5 GROUP BY 1, 2),
      ky AS (SELECT m.video_id, m.slot, mt.sent_id, row_number() OVER (PARTITION BY m.video_id, mt.sent_id ORDER BY ts_s, m.slot) AS k, count(*) OVER (PARTITION BY m.video_id, mt.sent_id) AS claims FROM moments m JOIN mt USING (video_id, slot))
      SELECT m.video_id, m.slot, coalesce(CASE WHEN claims = 1 THEN st.text WHEN k <= len(p) THEN p[k] END, '') AS caption FROM moments m LEFT JOIN ky USING (video_id, slot) LEFT JOIN pc ON pc.video_id = ky.video_id AND pc.sent_id = ky.sent_id
      LEFT JOIN sentences st ON st.video_id = ky.video_id AND st.sent_id = ky.sent_id""")
query("win13_drop_repeats", lambda s, d: cp.repeats_previous(sentences(s, d)).select(*SID, F.round("overlap", 6).alias("overlap"), F.coalesce("repeats", F.lit(False)).alias("repeats")),
      ctes("sentences") + f""", q AS (SELECT video_id, sent_id, list_distinct({TOKENS}) AS t FROM sentences), p AS (SELECT *, lag(t) OVER (PARTITION BY video_id ORDER BY sent_id) AS b FROM q),
      o AS (SELECT video_id, sent_id, CASE WHEN b IS NOT NULL AND least(len(t), len(b)) >= 5 THEN len(list_intersect(t, b)) / least(len(t), len(b)) ELSE 0.0 END AS overlap FROM p) SELECT video_id, sent_id, round(overlap, 6) AS overlap, overlap >= 0.75 AS repeats FROM o""")
#: Blocks of two sentences; of six blocks the first two are rewritten alike, the third as the block before was spoken, the fifth and sixth together.
spoken = lambda s, d: sentences(s, d).withColumn("block", F.floor(c("sent_id") / 2).cast("int"))
PHRASE = "concat('Meanwhile the story of number ', CAST(video_id AS VARCHAR(9)), ' goes on in town')"


def rewritten(s, d):
    blocks = spoken(s, d).groupBy("video_id", "block").agg(F.max_by("text", "sent_id").alias("back"))
    text = F.expr(f"CASE block % 6 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 2 THEN before ELSE {PHRASE} END")
    runs = blocks.withColumn("before", F.lag("back").over(W.partitionBy("video_id").orderBy("block")))
    return runs.select("video_id", c("block").alias("start"), (c("block") + (c("block") % 6 == 4).cast("int")).alias("end"), text.alias("text")).where("text is not null")


AGAIN = "(len(list_intersect({a}, {b})) >= 0.75 * least(len({a}), len({b})) AND least(len({a}), len({b})) >= 5)"
WORDS_OF = "list_distinct(regexp_extract_all(lower({x}), '\\p{{L}}+(?:[''’]\\p{{L}}+)*'))"
query("win13_emit_lines", lambda s, d: cp.emit_lines(spoken(s, d), rewritten(s, d)).select(*SID, "text", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "rewritten"),
      recursive("sentences") + f""", bl AS (SELECT video_id, sent_id // 2 AS b, arg_max(text, sent_id) AS back, min(sent_id) AS first, min(start_s) AS a, max(end_s) AS z FROM sentences GROUP BY 1, 2),
      nx AS (SELECT *, lag(back) OVER (PARTITION BY video_id ORDER BY b) AS before, b % 6 = 5 AND lag(b) OVER (PARTITION BY video_id ORDER BY b) = b - 1 AS joined FROM bl),
      un AS (SELECT video_id, CASE WHEN joined THEN b - 1 ELSE b END AS u, max(b) AS e, arg_max(back, b) AS back, min(first) AS first, min(a) AS a, max(z) AS z, arg_min(before, b) AS before FROM nx GROUP BY 1, 2),
      rw AS (SELECT *, CASE u % 6 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 2 THEN before ELSE {PHRASE} END AS new, row_number() OVER (PARTITION BY video_id ORDER BY u) AS i FROM un),
      ch AS (SELECT video_id, u, i, new IS NOT NULL AS taken, coalesce(new, back) AS last FROM rw WHERE i = 1 UNION ALL
        SELECT rw.video_id, rw.u, rw.i, rw.new IS NOT NULL AND NOT {AGAIN.format(a=WORDS_OF.format(x='rw.new'), b=WORDS_OF.format(x='ch.last'))}, CASE WHEN rw.new IS NOT NULL AND NOT {AGAIN.format(a=WORDS_OF.format(x='rw.new'), b=WORDS_OF.format(x='ch.last'))} THEN rw.new ELSE rw.back END FROM ch JOIN rw ON rw.video_id = ch.video_id AND rw.i = ch.i + 1)
      SELECT rw.video_id, first AS sent_id, new AS text, round(a, 3) AS start_s, round(z, 3) AS end_s, true AS rewritten FROM rw JOIN ch USING (video_id, u) WHERE taken UNION ALL
      SELECT s.video_id, s.sent_id, s.text, round(start_s, 3), round(end_s, 3), false FROM sentences s JOIN nx ON nx.video_id = s.video_id AND nx.b = s.sent_id // 2 JOIN ch ON ch.video_id = s.video_id AND ch.u = CASE WHEN joined THEN nx.b - 1 ELSE nx.b END WHERE NOT taken""")
#: Answers for every line: one too long, the words that the line begins with, and, for some, the same phrase.
SHORTER = f"CASE k WHEN 0 THEN concat(text, ' and more') WHEN 1 THEN substr(text, 1, 40) WHEN 2 THEN CASE WHEN sent_id % 3 > 0 THEN {PHRASE} END ELSE NULL END"
answers = lambda s, d: sentences(s, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(*SID, c("k").alias("at"), F.expr(SHORTER).alias("text")).where("text is not null")
query("txt5_accept_shortened", lambda s, d: cp.accept_shortened(sentences(s, d), answers(s, d), "de").select(*SID, "text", "shortened"),
      recursive("sentences") + f""", {CUTS}, nd AS (SELECT s.*, length(s.text) > 80 AND b.head IS NULL AS needs FROM sentences s LEFT JOIN b ON b.video_id = s.video_id AND b.sent_id = s.sent_id AND b.r = 1),
      an AS (SELECT video_id, sent_id, k, trim({SHORTER}) AS short, length(text) AS size FROM nd, range(3) AS r(k) WHERE needs),
      tr AS (SELECT video_id, sent_id, arg_max(short, k) AS new FROM an WHERE short <> '' AND length(short) < size AND length(short) <= 80 AND len(list_intersect({WORDS_OF.format(x='short')}, [{', '.join(f"'{w}'" for w in tx.ENGLISH)}])) < 2 GROUP BY 1, 2),
      ln AS (SELECT nd.video_id, nd.sent_id, nd.text, new, row_number() OVER (PARTITION BY nd.video_id ORDER BY nd.sent_id) AS i FROM nd LEFT JOIN tr USING (video_id, sent_id)),
      ch AS (SELECT video_id, sent_id, i, new IS NOT NULL AS taken, coalesce(new, text) AS shown FROM ln WHERE i = 1 UNION ALL
        SELECT ln.video_id, ln.sent_id, ln.i, ln.new IS NOT NULL AND NOT {AGAIN.format(a=WORDS_OF.format(x='ln.new'), b=WORDS_OF.format(x='ch.shown'))}, CASE WHEN ln.new IS NOT NULL AND NOT {AGAIN.format(a=WORDS_OF.format(x='ln.new'), b=WORDS_OF.format(x='ch.shown'))} THEN ln.new ELSE ln.text END FROM ch JOIN ln ON ln.video_id = ch.video_id AND ln.i = ch.i + 1)
      SELECT video_id, sent_id, shown AS text, taken AS shortened FROM ch""")
query("set3_word_overlap", lambda s, d: sentences(s, d).select(*SID, F.round(tx.word_overlap(F.array_distinct(tx.word_tokens(c("text"))), F.split(F.lit("the that and of in to is"), " ")), 6).alias("overlap")),
      ctes("sentences") + f" SELECT video_id, sent_id, CASE WHEN len({TOKENS}) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct({TOKENS}), ['the', 'that', 'and', 'of', 'in', 'to', 'is'])) / least(7, len(list_distinct({TOKENS}))), 6) END AS overlap FROM sentences")
SLOTS = "SELECT video_id, seq AS slot, CASE WHEN event_id % 4 = 0 THEN path END AS content, path AS draft, event_id % 5 = 0 AS edited, concat('c', CAST(event_id % 3 AS VARCHAR(9))) AS channel FROM grabs"
query("win15_carry_over_content", lambda s, d: cp.carry_over(s.sql(SLOTS.replace("FROM grabs", "FROM {grabs}"), grabs=table(s, d, "grabs"))).select("video_id", "slot", "carried", "channel"),
      ctes("grabs") + f""", q AS ({SLOTS}), w AS (SELECT *, last_value(content IGNORE NULLS) OVER b AS p1, first_value(content IGNORE NULLS) OVER a AS p2, last_value(CASE WHEN edited THEN draft END IGNORE NULLS) OVER b AS p3, first_value(CASE WHEN edited THEN draft END IGNORE NULLS) OVER a AS p4,
      coalesce(lag(channel) OVER (PARTITION BY video_id ORDER BY slot), channel) AS ch FROM q WINDOW b AS (PARTITION BY video_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY video_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
      SELECT video_id, slot, coalesce(content, p1, p2, p3, p4) AS carried, ch AS channel FROM w""")
QUOTED = "SELECT path, n, CASE WHEN (path + n) % 5 = 0 THEN chr(34) WHEN (path + n) % 7 = 0 THEN '“' WHEN (path + n) % 11 = 0 THEN '”' ELSE line END AS line FROM lines"
query("win16_quote_roles", lambda s, d: cp.quote_roles(s.sql(QUOTED.replace("FROM lines", "FROM {lines}"), lines=table(s, d, "lines"))).where("role is not null").select("path", "n", "role"),
      ctes("lines") + f""", q AS ({QUOTED}), w AS (SELECT *, max(CASE WHEN NOT regexp_matches(trim(line), '^["“”]$') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM q)
      SELECT path, n, CASE trim(line) WHEN '“' THEN 'open' WHEN '”' THEN 'close' ELSE CASE WHEN coalesce(f, 0) = 1 THEN 'open' ELSE 'close' END END AS role FROM w WHERE trim(line) IN ('“', '”', '"')""")
query("win17_adjacent_runs", lambda s, d: cp.adjacent_runs(words(s, d).withColumn("picked", c("idx") % 7 < 3)),
      ctes("words") + ", q AS (SELECT *, idx % 7 < 3 AS picked FROM words), w AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) - row_number() OVER (PARTITION BY video_id, picked ORDER BY idx) AS i FROM q) SELECT video_id, picked, min(idx) AS first, max(idx) AS last, string_agg(text, ' ' ORDER BY idx) AS piece FROM w GROUP BY video_id, picked, i")
query("txt13_balanced_lines", lambda s, d: cp.balanced_lines(sentences(s, d).select(*SID, "text"), 30).select(*SID, F.array_join("lines", "|").alias("lines")))
query("txt14_frame_name", lambda s, d: table(s, d, "grabs").select("event_id", tx.frame_name(c("seq") + 1, F.lit(120)).alias("name")), ctes("grabs") + " SELECT event_id, 'frame-' || CASE WHEN length(CAST(seq + 1 AS VARCHAR)) >= 3 THEN CAST(seq + 1 AS VARCHAR) ELSE lpad(CAST(seq + 1 AS VARCHAR), 3, '0') END AS name FROM grabs")
query("txt14_thumbnail_name", lambda s, d: table(s, d, "grabs").select("event_id", tx.thumbnail_name(c("seq")).alias("name")), ctes("grabs") + " SELECT event_id, 'thumbnail_frame' || (seq + 1) AS name FROM grabs")
query("txt15_timecode", lambda s, d: table(s, d, "moments").select("video_id", "slot", tx.timecode(c("ts_s")).alias("timecode")), ctes("moments") + " SELECT video_id, slot, printf('%02dm%02ds%02d', CAST(floor(floor(ts_s) / 60) AS INT), CAST(floor(ts_s) AS INT) % 60, CAST(round_even((ts_s - floor(ts_s)) * 100, 0) AS INT) % 100) AS timecode FROM moments")
query("txt16_parse_duration", lambda s, d: table(s, d, "moments").select("video_id", "slot", F.round(tx.parse_duration(F.expr("concat(slot % 3, ':', slot % 60, ':', ts_s)")), 4).alias("seconds")), ctes("moments") + " SELECT video_id, slot, round((slot % 3) * 3600 + (slot % 60) * 60 + ts_s, 4) AS seconds FROM moments")
