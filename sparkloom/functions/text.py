"""Text functions as Column expressions: tokens, overlap, terms, labels, cleaning, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.arrays import numbered

# Fixed values.
SEASONS = ("fall", "spring", "summer", "winter")
TERM = r"(?i)(fall|spring|summer|winter)\s+(20\d{2})"
TERM_WORD = r"(?i)\b(fall|spring|summer|winter)\s+(20\d{2})\b"
TERM_MARK = r"(?m)^\*\*TERM:\*\*\s*(.+)$"
DEADLINE_WORDS = r"(?i)(withdraw|final day|last day|drop|deadline|add/?drop|adjustment)"
DATE = r"\d{1,2}/\d{1,2}(?:/\d{2,4})?"
#: Months of each season, in the order that wins ties.
SEASON_MONTHS = {"Fall": (9, 10, 11), "Spring": (2, 3, 4, 5), "Summer": (6, 7, 8), "Winter": (12, 1)}
ANCHORS = (
    "requirementstext", "programrequirementstext", "planofstudytext", "fouryearplantext", "roadmaptext", "programadmissiontext",
    "admissionrequirementstext", "programlearningoutcomestext", "learningoutcomestext", "policiestext", "coursestext", "advisingnotestext",
    "recommendationsstext", "degreerequirementstext", "courseinformationtext", "curriculumrequirements", "sampleplan", "degree-requirements-overview",
)
OVERLAP_CHARS = 2000


def tokenize(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; other letters separate tokens. Null: no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_text(c: Column) -> Column:
    """Any white space to one blank, lower case, stripped."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def _count(xs: Column, w: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x == w))


def shared_tokens(a: Column, b: Column) -> Column:
    """How many tokens two token arrays share as multisets."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def overlap_score(query: Column, doc: Column, chars: int | None = OVERLAP_CHARS) -> Column:
    """Shared tokens over sqrt(|q| |d|), the document cut to its first ``chars`` characters (None: whole); 0 if either has none."""
    q, d = tokenize(query), tokenize(doc if chars is None else F.substring(doc, 1, chars))
    return overlap_of_tokens(q, d)


def overlap_of_tokens(q: Column, d: Column) -> Column:
    n = F.size(q).cast("long") * F.size(d)
    return F.when(n == 0, 0.0).otherwise(shared_tokens(q, d) / F.sqrt(n.cast("double")))


def overlap_of_numbered(q: Column, d: Column) -> Column:
    """The same of token arrays that were numbered once, for many pairs. The set is made from the second array, the query's, which is the shorter one."""
    n = F.size(q).cast("long") * F.size(d)
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(d, q)) / F.sqrt(n.cast("double")))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the normalized texts' words as multisets; 0 if nothing is shared."""
    p, g = (F.filter(F.split(normalize_text(c), " "), lambda x: x != "") for c in (pred, gold))
    same = shared_tokens(p, g)
    return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def all_terms(c: Column, whole_words: bool = False) -> Column:
    """Distinct "Season YYYY" terms in the order they are first seen."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TERM_WORD if whole_words else TERM), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.initcap(F.regexp_replace(t, r"\s+", " "))))


def first_term(c: Column) -> Column:
    """The first whole-word term, in title case, or ""."""
    return F.initcap(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), TERM_WORD, 0), r"\s+", " "))


def term_season(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), TERM, 1)), F.lit(""))


def term_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), TERM, 2), F.lit(""))


def infer_term(text: Column, headings: Column) -> Column:
    """A term marker's value, else the first term of the headings, else of the text, else ""."""
    mark = F.trim(F.regexp_extract(text, TERM_MARK, 1))
    return F.coalesce(F.nullif(mark, F.lit("")), F.nullif(first_term(F.array_join(headings, " — ")), F.lit("")), first_term(text))


def is_table_block(c: Column) -> Column:
    return c.rlike(r"(?i)\|.+\|.+\||<table\b")


def section_label(headings: Column) -> Column:
    """"calendar" if the last heading holds it, else what follows its first ": ", lower case; "" without headings."""
    last = F.lower(F.try_element_at(headings, F.lit(-1)))
    return F.when(last.isNull(), "").when(last.contains("calendar"), "calendar").otherwise(F.trim(F.regexp_replace(last, r"^.*?: ", "")))


def slugify(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-"), "[^a-z0-9-]", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", "section").otherwise(slug)


def canonical_anchor(c: Column, known: tuple[str, ...] = ANCHORS) -> Column:
    """The known anchor an element id stands for (a container suffix is dropped), or null."""
    base = F.regexp_replace(F.lower(F.trim(c)), "(textcontainer|container|texttab|tab)$", "")
    names = F.array(*[F.lit(k) for k in known])
    tries = F.array(base, F.concat(base, F.lit("text")), F.regexp_replace(base, "-", ""), F.regexp_replace(base, "_", ""))
    return F.get(F.filter(tries, lambda x: F.array_contains(names, x)), F.lit(0))


def clean_pdf_text(c: Column) -> Column:
    """Carriage returns dropped, words rejoined over line ends, at most one blank line, lines stripped."""
    t = F.regexp_replace(c, "\r", "")
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(F.array_join(F.transform(F.split(t, "\n"), strip), "\n"), r"(?U)^\s+|\s+$", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def html_cell(c: Column) -> Column:
    """Line breaks to " / ", non-breaking blanks and runs of blanks to one blank."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " / "), r"(?i)&nbsp;|\u00a0", " ")
    return F.regexp_replace(t, "[ \t]{2,}", " ")


def heading_line(c: Column) -> Column:
    """Bold marks off, non-breaking blanks to blanks, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(c, "\u00a0", " "), r"^\s*\*\*(.*?)\*\*\s*$", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def collapse_course_header(c: Column) -> Column:
    """Runs of the course table's header become one, on lines of its own."""
    return F.regexp_replace(c, r"(?i)(Course List\s+Code\s+Title\s+Credits\s+)+", "Course List\nCode\nTitle\nCredits\n")


def trim_answer(c: Column, limit: int, between: str = "\n\n") -> Column:
    """Stripped if short enough; else leading whole paragraphs (parted by ``between``) that fit; else the first characters."""
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("over"))

    def add(acc: Column, p: Column) -> Column:
        fits = ~acc["over"] & (F.length(acc["s"]) + F.when(acc["s"] == "", 0).otherwise(len(between)) + F.length(p) <= limit)
        joined = F.when(acc["s"] == "", p).otherwise(F.concat(acc["s"], F.lit(between), p))
        return F.struct(F.when(fits, joined).otherwise(acc["s"]).alias("s"), (~fits).alias("over"))

    kept = F.aggregate(F.split(c, between), start, add, lambda a: a["s"])
    return F.when(F.length(c) <= limit, strip(c)).when(kept != "", strip(kept)).otherwise(F.substring(c, 1, limit))


def snippet(c: Column, size: int = 1000) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def heading_text(c: Column) -> Column:
    """A heading without its level mark ("H2: ")."""
    return F.regexp_replace(c, r"^H\d:\s*", "")


def row_to_text(headers: Column, values: Column) -> Column:
    """"**header:** value" lines of the cells that hold something."""
    pairs = F.zip_with(headers, values, lambda h, v: F.struct(F.regexp_replace(F.trim(h), ":$", "").alias("h"), F.trim(v).alias("v")))
    full = F.filter(pairs, lambda p: (F.coalesce(p["h"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != ""))
    return F.array_join(F.transform(full, lambda p: F.concat(F.lit("**"), p["h"], F.lit(":** "), p["v"])), "\n")


def most_common(xs: Column) -> Column:
    """The most frequent entry (first letter raised), the first seen of equals; null of nothing."""
    ys = F.transform(F.filter(xs, lambda x: F.trim(x) != ""), lambda x: F.concat(F.upper(F.substring(F.trim(x), 1, 1)), F.lower(F.substring(F.trim(x), 2, 1 << 30))))
    return F.aggregate(ys, F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("n")), lambda a, y: F.when(_count(ys, y) > a["n"], F.struct(y.alias("v"), _count(ys, y).alias("n"))).otherwise(a), lambda a: a["v"])


def find_column(headers: Column, names: list[str]) -> Column:
    """The place (from 0) of the first header that holds any of the names, or null."""
    hit = F.transform(headers, lambda h, i: F.when(F.lower(h).rlike("|".join(names)), i))
    return F.get(F.filter(hit, lambda i: i.isNotNull()), F.lit(0))


def months_of(cells: Column) -> Column:
    """Distinct months (1 to 12) of each cell's first d/d date."""
    m = F.transform(cells, lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"\b(\d{1,2})\s*/\s*\d{1,2}\b", 1).try_cast("int"))
    return F.array_distinct(F.filter(m, lambda x: x.between(1, 12)))


def season_of(months: Column) -> Column:
    """The season that shares most months; equals go to the one listed first; "" without any."""
    n = {s: F.size(F.array_intersect(months, F.array(*[F.lit(m) for m in ms]))) for s, ms in SEASON_MONTHS.items()}
    best = F.greatest(*n.values())
    out = F.when(best <= 0, "")
    for s, k in n.items():
        out = out.when(k == best, s)
    return out


def chunk_id(url: Column, headings: Column, i: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.concat(F.coalesce(url, F.lit("")), F.lit("::"), F.array_join(headings, ";"), F.lit("::"), i.cast("string"))))


def row_chunk_id(url: Column, text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.concat(F.coalesce(url, F.lit("")), F.lit("::row::"), text)))


def table_chunk_id(url: Column, headings: Column, i: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.concat(F.coalesce(url, F.lit("")), F.lit("::"), F.array_join(headings, ";"), F.lit("::table::"), i.cast("string"))))


def answer_id(question: Column) -> Column:
    return F.concat(F.lit("kb:"), F.substring(F.sha1(question), 1, 12))


def as_text(c: Column) -> Column:
    """Null to "", anything else to text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def list_as_text(c: Column) -> Column:
    return F.coalesce(F.array_join(c, ", "), F.lit(""))


def as_list(c: Column) -> Column:
    """A text list ("a, b") as an array; null and "" are empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
