"""Text functions over captions and words, in built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a sentence, that stand inside one, and that dangle at its end.
TERMINAL = "[.!?…][\"'”’)\\]]*$"
INTERNAL = "[,;:—–][\"'”’)\\]]*$"
DANGLING = "[,;:—–]+$"
#: Places where a caption may be cut, ends of clauses, characters of a screen and of two, words of a piece.
CAPTION_BREAK = "[.!?…,;:—–][\"'”’)\\]]*(?=\\s)"
CLAUSE_END = "[,;:.!?—–](?=\\s|$)"
CAPTION, CAPTION_MOST, LEAST_WORDS = 80, 160, 4
#: Words that mark a line as English.
ENGLISH = (
    "the and of was were with from that this these those been being are is "
    "his her their they them there which while after before through into"
).split()


def clean_sentence(text: Column) -> Column:
    """White space collapsed, dangling marks cut."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), DANGLING, "")


def ends_terminal(text: Column) -> Column:
    return text.rlike(TERMINAL)


def has_internal_mark(text: Column) -> Column:
    return text.rlike(INTERNAL)


def split_caption(text: Column, limit: int = CAPTION) -> Column:
    """One piece, or two cut after a mark where both fit, have four words, and the tail doesn't start in lower case; the most even
    cut wins, then the first. Cuts are the ends of the marks, found from the pieces between them."""
    marks = F.regexp_extract_all(text, F.lit(CAPTION_BREAK), F.lit(0))
    gaps = F.split(text, CAPTION_BREAK, -1)
    cuts = F.transform(F.sequence(F.lit(1), F.size(marks)), lambda i: F.aggregate(F.slice(gaps, 1, i), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(marks, 1, i), F.lit(0), lambda a, m: a + F.length(m)))
    halves = F.transform(cuts, lambda c: F.struct(F.trim(F.substring(text, F.lit(1), c)).alias("head"), F.trim(F.substring(text, c + 1, F.length(text))).alias("tail")))
    words = lambda x: F.size(F.split(x, r"\s+"))
    fit = F.filter(halves, lambda h: (F.length(h["head"]) <= limit) & (F.length(h["tail"]) <= limit) & (words(h["head"]) >= LEAST_WORDS) & (words(h["tail"]) >= LEAST_WORDS) & ~h["tail"].rlike(r"^\p{Ll}"))
    best = F.array_min(F.transform(fit, lambda h: F.struct(F.abs(F.length(h["head"]) - F.length(h["tail"])).alias("spread"), F.length(h["head"]).alias("at"), h["head"].alias("head"), h["tail"].alias("tail"))))
    return F.when((F.length(text) > limit) & (F.size(marks) > 0) & best.isNotNull(), F.array(F.regexp_replace(best["head"], DANGLING, ""), best["tail"])).otherwise(F.array(text))


def needs_condensing(text: Column) -> Column:
    """Longer than a screen and not to be cut in two."""
    return (F.length(text) > CAPTION) & (F.size(split_caption(text)) == 1)


def fit_caption(text: Column) -> Column:
    """Kept up to 160 characters; cut at the last clause end from the 80th to before the 160th; else empty."""
    gaps = F.split(F.substring(text, 1, CAPTION_MOST + 1), "[,;:.!?—–](?=\\s)", -1)
    kept = F.length(F.substring(text, 1, CAPTION_MOST + 1)) - F.length(F.element_at(gaps, -1))  # length up to and with the last clause end
    cut = F.when(F.size(gaps) > 1, kept - 1).otherwise(-1)
    return F.when(F.length(text) <= CAPTION_MOST, text).when(cut < CAPTION, "").otherwise(F.trim(F.regexp_replace(F.substring(text, F.lit(1), cut + 1), DANGLING, "")))


def word_tokens(text: Column) -> Column:
    """Lower-cased words; apostrophes inside are kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:['’]\p{L}+)*"), F.lit(0))


def drifted_to_english(text: Column) -> Column:
    """Two or more distinct English marker words."""
    return F.size(F.array_intersect(F.array_distinct(word_tokens(text)), F.array(*map(F.lit, ENGLISH)))) >= 2


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words by the smaller set; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def names_in(text: Column) -> Column:
    """Runs of two or more capitalised words; possessives are stripped; other words and single capitals end a run."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    bare = F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, r"""^[,.;:!?"'()\[\]]+|[,.;:!?"'()\[\]]+$""", ""), "('s|’s)$", ""))
    marked = F.transform(bare, lambda b: F.when(b.rlike(r"^[A-ZÀ-Ü]\p{L}*$"), b).otherwise("|"))
    runs = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r))
    return F.filter(runs, lambda r: F.contains(r, F.lit(" ")))


def frame_name(i: Column, total: Column) -> Column:
    """frame-<i>, zero-padded to the width of the total; a number that is wider than the total keeps all its digits."""
    number = i.cast("string")
    return F.concat(F.lit("frame-"), F.lpad(number, F.greatest(F.length(total.cast("string")), F.length(number)), F.lit("0")))


def thumbnail_name(i: Column) -> Column:
    """Name of the i-th thumbnail from 0."""
    return F.concat(F.lit("thumbnail_frame"), (i + 1).cast("string"))


def timecode(seconds: Column) -> Column:
    """MMmSSsHH; hundredths are rounded half to even and wrap without a carry."""
    whole = F.floor(seconds)
    part = F.bround((seconds - whole) * 100, 0).cast("int") % 100
    return F.format_string("%02dm%02ds%02d", (whole / 60).cast("int"), (whole % 60).cast("int"), part)


def parse_duration(text: Column) -> Column:
    """HH:MM:SS.xx in seconds; null where it isn't one."""
    p = F.split(text, ":")
    return F.when(text.rlike(r"^\d+:\d+:\d+(\.\d+)?$"), p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + p[2].try_cast("double"))


def asset_path(ref: Column, pack: Column) -> Column:
    """Null for absolute URLs and data; ./ is relative to the pack, all else to the root."""
    return F.when(ref.isNull() | (F.trim(ref) == "") | ref.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//") | F.startswith(ref, F.lit("data:")), None).when(F.startswith(ref, F.lit("./")), F.concat(pack, F.lit("/"), F.substring(ref, F.lit(3), F.length(ref)))).otherwise(F.concat(F.lit("frontend/"), ref))


def normalise_package(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def version_key(text: Column) -> Column:
    """First four runs of digits as numbers; [0] where there is none."""
    runs = F.transform(F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+"), F.lit(0)), 1, 4), lambda x: x.cast("int"))
    return F.when(F.size(runs) > 0, runs).otherwise(F.array(F.lit(0)))
