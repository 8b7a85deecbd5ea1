"""Secret scans: fixed patterns plus sliding-window Shannon entropy per character class, in SQL functions only."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns: kind, regular expression, group that is measured, least length of that group.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: A cheap test for each kind that every text with a kept match passes.
HINT = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
#: Candidate strings of the entropy scan; the first group is an allow-list prefix that suppresses the candidate.
CANDIDATE = r"((?:sha(?:1|256|384|512)|md5|commit|rev)[:= -]|)([A-Za-z0-9+/_-]{24,})"
#: Candidates of these shapes are suppressed: UUIDs, digits only, no digit, no letter, documented example keys.
ALLOWED = r"^([0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[^A-Za-z]*|[^0-9]*|.*EXAMPLE.*|.*(0123456789|abcdefghijkl).*)$"
#: Words of the allow-list, which suppress a candidate that holds them.
WORDS = ("EXAMPLE", "0123456789", "abcdefghijkl")
WINDOW = 24
#: Character classes: kind, regular expression of the whole candidate, alphabet, bits a symbol from which a window counts.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", "0123456789abcdefABCDEF", 3.05),
    ("entropy_base64", r"^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.95),
)
KINDS = [k for k, *_ in BASE] + [k for k, *_ in CLASSES]


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _placed(text: str, regex: str, group: int) -> str:
    """SQL: array of (start, end, what the group holds) of the leftmost matches that don't overlap, in code points."""
    return f"""aggregate(
        arrays_zip(zip_with(regexp_extract_all({text}, {_sql(regex)}, 0), regexp_extract_all({text}, {_sql(regex)}, {group}), (x, y) -> struct(x as hit, y as part)),
                   slice(split({text}, {_sql(regex)}, -1), 1, size(regexp_extract_all({text}, {_sql(regex)}, 0)))),
        struct(0 as pos, cast(array() as array<struct<s: int, e: int, part: string>>) as got),
        (a, m) -> struct(a.pos + length(m.`1`) + length(m.`0`.hit) as pos,
                         array_append(a.got, struct(a.pos + length(m.`1`) as s, a.pos + length(m.`1`) + length(m.`0`.hit) as e, m.`0`.part as part)) as got),
        a -> a.got)"""


def _most_entropy(value: str, alphabet: str) -> str:
    """SQL: the largest Shannon entropy of WINDOW symbols in a row, from counts that are changed by one symbol in and one out."""
    gain = "array(" + ", ".join(repr(c * math.log2(c) if c else 0.0) + "D" for c in range(WINDOW + 1)) + ")"
    n = len(alphabet)
    put = f"""transform(a.n, (v, j) -> v + if(j + 1 = instr('{alphabet}', substr({value}, i, 1)), 1, 0)
                                          - if(i > {WINDOW} and j + 1 = instr('{alphabet}', substr({value}, greatest(i - {WINDOW}, 1), 1)), 1, 0))"""
    came = f"a.n[instr('{alphabet}', substr({value}, i, 1)) - 1]"
    went = f"a.n[instr('{alphabet}', substr({value}, i - {WINDOW}, 1)) - 1]"
    same = f"substr({value}, i, 1) = substr({value}, i - {WINDOW}, 1)"
    step = f"""a.g + case when i <= {WINDOW} then {gain}[{came} + 1] - {gain}[{came}]
                          when {same} then 0D
                          else {gain}[{came} + 1] - {gain}[{came}] + {gain}[{went} - 1] - {gain}[{went}] end"""
    return f"""aggregate(sequence(1, length({value})),
        struct(array_repeat(0, {n}) as n, 0D as g, -1D as best),
        (a, i) -> struct({put} as n, {step} as g, if(i >= {WINDOW}, greatest(a.best, {math.log2(WINDOW)!r}D - ({step}) / {WINDOW}), a.best) as best),
        a -> a.best)"""


def _pieces(value: str, start: str, v: str) -> str:
    """SQL: array of (s, e, part) of the runs without a space in value that fill a window; value begins at start, v names variables."""
    return f"""filter(aggregate(split({value}, ' ', -1), struct({start} as pos, cast(array() as array<struct<s: int, e: int, part: string>>) as got),
        ({v}, {v}w) -> struct({v}.pos + length({v}w) + 1 as pos, array_append({v}.got, struct({v}.pos as s, {v}.pos + length({v}w) as e, {v}w as part)) as got),
        {v} -> {v}.got), {v}p -> length({v}p.part) >= {WINDOW})"""


def _rest() -> str:
    """SQL: the parts of candidates that a base span or the allow-list drops whole: base spans are cut out, and from runs that are
    longer than one key, allow-list words."""
    bare = f"""aggregate(filter(_base, b -> b.s < m.e and m.s < b.e), m.part, (p, b) -> concat(substr(p, 1, greatest(b.s - m.s, 0)),
        repeat(' ', least(b.e, m.e) - greatest(b.s, m.s)), substr(p, least(b.e, m.e) - m.s + 1)))"""
    worded = "x.part"
    for word in WORDS:
        worded = f"replace({worded}, '{word}', '{' ' * len(word)}')"
    worded = f"if(length(x.part) >= {2 * WINDOW}, {worded}, x.part)"
    parts = f"flatten(transform({_pieces(bare, 'm.s', 'k')}, x -> {_pieces(worded, 'x.s', 'l')}))"
    dropped = f"""filter({_placed("coalesce(_text, '')", CANDIDATE, 2)}, m -> length(m.part) = m.e - m.s
                and (m.part rlike {_sql(ALLOWED)} or exists(_base, b -> b.s < m.e and m.s < b.e)))"""
    return f"filter(flatten(transform({dropped}, m -> {parts})), y -> not y.part rlike {_sql(ALLOWED)})"


def scan(docs: DataFrame, text: str = "text", rest: bool = False) -> DataFrame:
    """docs plus _base and _spans: arrays of (kind, rank, s, e), by start, then kind as listed in KINDS.

    Base spans are the leftmost matches of each kind whose measured group is long enough. The entropy scan adds candidate
    strings in which some window of 24 symbols reaches the bits of their character class, unless the allow-list suppresses
    them or a base span overlaps them. With rest, the parts of such candidates are judged by themselves: what base spans leave of
    them and, in runs of two windows or more, what stands beside allow-list words. Positions count code points, ends are exclusive. Null and empty texts have no span;
    repeated rows, null ids and extra columns stay; very long texts are scanned whole.
    """
    t = "coalesce(_text, '')"
    out = docs.withColumn("_text", F.col(text))
    for rank, (kind, regex, group, least) in enumerate(BASE):
        # matches that are too short still consume text, so they are dropped after matching
        got = f"filter({_placed(t, regex, group)}, m -> length(m.part) >= {least})"
        spans = f"transform({got}, m -> struct('{kind}' as kind, {rank} as rank, m.s as s, m.e as e))"
        out = out.withColumn(f"_{kind}", F.expr(f"case when {t} rlike {_sql(HINT[kind])} then {spans} else array() end"))
    out = out.withColumn("_base", F.expr("array_sort(concat(_assign, _access, _hex), (x, y) -> case when x.s <> y.s then x.s - y.s else x.rank - y.rank end)"))
    found = f"""filter({_placed(t, CANDIDATE, 2)}, m -> not m.part rlike {_sql(ALLOWED)} and length(m.part) = m.e - m.s
                and not exists(_base, b -> b.s < m.e and m.s < b.e))"""
    found = f"concat({found}, {_rest()})" if rest else found
    out = out.withColumn("_found", F.expr(f"case when {t} rlike '[A-Za-z0-9+/_-]{{24}}' then {found} else array() end"))
    rated = "case " + " ".join(
        f"when m.part rlike {_sql(regex)} then if({_most_entropy('m.part', alphabet)} >= {bits}D, {len(BASE) + i}, -1)" for i, (_, regex, alphabet, bits) in enumerate(CLASSES)
    ) + " else -1 end"
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    out = out.withColumn("_more", F.expr(f"filter(transform(_found, m -> struct({rated} as rank, m.s as s, m.e as e)), m -> m.rank >= 0)"))
    more = f"transform(_more, m -> struct({names}[m.rank] as kind, m.rank as rank, m.s as s, m.e as e))"
    out = out.withColumn("_spans", F.expr(f"array_sort(concat(_base, {more}), (x, y) -> case when x.s <> y.s then x.s - y.s else x.rank - y.rank end)"))
    return out.drop("_text", "_assign", "_access", "_hex", "_found", "_more")


def spans_text(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, m -> concat(m.kind, ':', m.s, ':', m.e)), ',')")


def digests(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: counts of base spans, digest of their list, and the list of all spans."""
    count = lambda kind: F.expr(f"cast(size(filter(_base, m -> m.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return scan(docs).select(doc_id, count("assign"), count("access"), count("hex"), F.sha2(spans_text("_base").cast("binary"), 256).alias("base_sha256"), spans_text("_spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text, those in the rest of a candidate too, replaced by mark (overlapping spans by one); n_chars follows. No row is dropped; null texts stay null."""
    cut = f"""aggregate(_spans, struct(0 as pos, '' as out),
        (a, m) -> struct(greatest(a.pos, m.e) as pos, if(m.s >= a.pos, concat(a.out, substr(coalesce(own, ''), a.pos + 1, m.s - a.pos), '{mark}'), a.out) as out),
        a -> concat(a.out, substr(coalesce(own, ''), a.pos + 1)))"""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("own"))  # names of helpers meet none of theirs
    out = scan(rows, "own", rest=True).withColumn("_done", F.expr(f"case when size(_spans) = 0 then own else {cut} end"))
    given = {c: F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in given:
        given["n_chars"] = F.when(F.expr("size(_spans) = 0"), given["n_chars"]).otherwise(F.length("_done").cast("long"))
    return out.select(*[(F.col("_done") if c == text else v).alias(c) for c, v in given.items()])


def _placed_sql(regex: str, group: int, kind: str, rank: int, least: int) -> str:
    quoted = "'" + regex.replace("'", "''") + "'"
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s, length(hits[i]) AS n, parts[i] AS part
    FROM (SELECT doc_id, regexp_split_to_array(t, {quoted}) AS gaps, regexp_extract_all(t, {quoted}, 0) AS hits, regexp_extract_all(t, {quoted}, {group}) AS parts FROM d),
      unnest(range(1, len(hits) + 1)) AS r(i) WHERE length(parts[i]) >= {least}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join(_placed_sql(regex, group, kind, rank, least) for rank, (kind, regex, group, least) in enumerate(BASE))}),
cand AS (SELECT doc_id, s, n, part FROM ({_placed_sql(CANDIDATE, 2, 'c', 9, 24)}) c
  WHERE length(part) = n AND NOT regexp_matches(part, '{ALLOWED}')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.s + c.n AND c.s < b.s + b.n)),
win AS (SELECT doc_id, s, n, part, i, unnest(string_split(substr(part, i, {WINDOW}), '')) AS ch
  FROM cand, unnest(range(1, n - {WINDOW} + 2)) AS r(i)),
cnt AS (SELECT doc_id, s, n, part, i, ch, count(*) AS c FROM win GROUP BY ALL),
ent AS (SELECT doc_id, s, n, part, i, log2({WINDOW}) - sum(c * log2(c)) / {WINDOW} AS bits FROM cnt GROUP BY ALL),
top AS (SELECT doc_id, s, n, part, max(bits) AS bits FROM (SELECT doc_id, s, n, part, i, bits FROM ent) GROUP BY ALL),
more AS (SELECT doc_id, CASE WHEN regexp_matches(part, '{CLASSES[0][1]}') THEN 'entropy_hex' ELSE 'entropy_base64' END AS kind,
    CASE WHEN regexp_matches(part, '{CLASSES[0][1]}') THEN 3 ELSE 4 END AS rank, s, n FROM top
  WHERE bits >= CASE WHEN regexp_matches(part, '{CLASSES[0][1]}') THEN {CLASSES[0][3]} ELSE {CLASSES[1][3]} END),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans
  FROM (SELECT doc_id, kind, rank, s, n FROM base UNION ALL SELECT doc_id, kind, rank, s, n FROM more) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
