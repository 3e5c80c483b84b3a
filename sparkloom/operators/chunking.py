"""Documents to overlapping chunks: cleaning, heading sections, windows, ids. All inside the document's own row until chunks are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.arrays import let
from sparkloom.operators.selection import keep_first

TARGET, CATALOG_TARGET, OVERLAP, PAD = 1200, 2200, 200, 40
# Characters at which a window may be cut; lines of page chrome; headings kept once a document; the mark of an
# extracted table; the bucket of program pages; course codes.
BOUNDARY = r"[ \t\n\r\f\x0B.,;:!?)\]]"
NOT_BOUNDARY = r"[^ \t\n\r\f\x0B.,;:!?)\]]"
CHROME = (
    "university catalog", "search catalog", "catalog a-z index", "courses a-z", "programs a-z", "archives", "faculty and administration",
    "general information", "undergraduate and graduate degree requirements", "print/download options", "print this page",
    "download page (pdf)", "what can we help you find?", "view all results", "university twitter", "university facebook", "university youtube",
)
ONCE = ("program requirements", "required courses", "required core courses", "elective courses", "electives", "culminating experience", "total credits", "course list")
TABLE_MARK = "### Table "
PROGRAMS = "catalog-programs"
COURSE_CODES = ("CSIT", "MATH", "AMAT", "STAT", "PHYS")


def clean_catalog_text(c: Column, chrome: tuple[str, ...] = CHROME) -> Column:
    """Non-blank lines without page chrome; the course table's header as "Course List"; listed headings once; no line twice in a row."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"))

    def add(acc: Column, raw: Column) -> Column:
        line = X.strip(raw)
        low = F.lower(line)
        noise = low.contains("course list") & low.contains("code") & low.contains("title") & low.contains("credits")
        line = F.when(noise, "Course List").otherwise(line)
        low2 = F.lower(line)
        dirty = F.lit(False)
        for p in chrome:
            dirty = dirty | low.contains(p)
        once = low2.isin(*ONCE)
        drop = (X.strip(raw) == "") | dirty
        again = once & F.array_contains(acc["seen"], low2)
        # a heading counts as seen even where the line before it is the same
        seen = F.when(~drop & once & ~again, F.array_append(acc["seen"], low2)).otherwise(acc["seen"])
        same = F.coalesce(F.try_element_at(acc["kept"], F.lit(-1)) == line, F.lit(False))
        kept = F.when(drop | again | same, acc["kept"]).otherwise(F.array_append(acc["kept"], line))
        return F.struct(kept.alias("kept"), seen.alias("seen"))

    return F.array_join(F.aggregate(F.split(c, r"\r\n|\n|\r"), start, add, lambda a: a["kept"]), "\n")


def normalize_courses(c: Column, codes: tuple[str, ...] = COURSE_CODES) -> Column:
    """A line that begins with a course code, the next non-blank line (its title, unless that is a code) and a line of one or two digits behind the title (credits) become one line.

    What stands behind the code on its own line stays. Blank lines behind a code or its title go, whether or not credits follow; all
    other lines stay as they are. Every line's part follows from the two non-blank lines before it, so no state is folded.
    """
    code = rf"(?i)^(?:{'|'.join(codes)})[\s\u00a0]*\d{{3}}\b"

    def of(t: Column) -> Column:
        line = lambda k: F.get(t["lines"], F.get(t["at"], k))
        text = lambda k: X.strip(F.coalesce(line(k), F.lit("")))
        is_code = lambda k: (k >= 0) & F.coalesce(X.strip(line(k)).rlike(code), F.lit(False))
        is_title = lambda k: is_code(k - 1) & ~is_code(k) & line(k).isNotNull()
        is_credits = lambda k: is_title(k - 1) & ~is_code(k) & F.coalesce(X.strip(line(k)).rlike(r"^\d{1,2}$"), F.lit(False))
        entry = lambda k: F.concat(text(k), F.when(is_title(k + 1), F.concat(F.lit(" "), text(k + 1), F.when(is_credits(k + 2), F.concat(F.lit(" ("), text(k + 2), F.lit(" credits)"))).otherwise(""))).otherwise(""))

        def part(i: Column, k: Column) -> Column:
            nxt = F.coalesce(F.get(t["at"], k + 1), F.size(t["lines"]))
            blanks = F.slice(t["lines"], i + 2, nxt - i - 1)
            none = F.array().cast("array<string>")
            own = F.when(is_code(k), F.array(entry(k))).when(is_title(k) | is_credits(k), none).otherwise(F.array(line(k)))
            return F.concat(own, F.when(is_code(k) | is_title(k), none).otherwise(blanks))

        first = F.slice(t["lines"], F.lit(1), F.coalesce(F.get(t["at"], F.lit(0)), F.size(t["lines"])))
        return F.array_join(F.concat(first, F.flatten(F.transform(t["at"], part))), "\n")

    lines = F.split(c, r"\r\n|\n|\r")
    numbered = let(lines, lambda x: F.struct(x.alias("lines"), F.filter(F.transform(x, lambda y, i: F.when(X.strip(y) != "", i)), lambda i: i.isNotNull()).alias("at")))
    return let(numbered, of)


def heading_sections(md: Column) -> Column:
    """array<struct<headings: array, text: string>> of a markdown text, in order, sections without text left out.

    A heading of level n replaces the path from place n on (a place in the path, so skipped levels don't leave gaps). A mark without a
    title is text. Sections are ranges of lines; only the headings' paths are folded, so the time is linear in the lines.
    """
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s+\S", 1))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.array(F.array().cast("array<string>")).alias("paths"))

    def add(acc: Column, line: Column) -> Column:
        title = F.concat(F.lit("H"), level(line).cast("string"), F.lit(": "), F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.*)$", 1)))
        path = F.array_append(F.slice(acc["path"], F.lit(1), F.greatest(level(line) - 1, F.lit(0))), title)
        return let(path, lambda p: F.struct(p.alias("path"), F.array_append(acc["paths"], p).alias("paths")))

    def of(t: Column) -> Column:
        paths = F.aggregate(F.transform(t["at"], lambda i: F.get(t["lines"], i)), start, add, lambda a: a["paths"])
        bounds = F.concat(F.array(F.lit(-1)), t["at"], F.array(F.size(t["lines"])))
        part = lambda y: F.zip_with(
            y["paths"], F.sequence(F.lit(0), F.size(y["paths"]) - 1),
            lambda p, i: F.struct(p.alias("headings"), X.strip(F.array_join(F.slice(t["lines"], F.get(y["bounds"], i) + 2, F.get(y["bounds"], i + 1) - F.get(y["bounds"], i) - 1), "\n")).alias("text")),
        )
        return let(F.struct(paths.alias("paths"), bounds.alias("bounds")), part)

    lines = F.split(md, r"\r\n|\n|\r")
    marked = let(lines, lambda x: F.struct(x.alias("lines"), F.filter(F.transform(x, lambda y, i: F.when(level(y) > 0, i)), lambda i: i.isNotNull()).alias("at")))
    return F.filter(let(marked, of), lambda s: s["text"] != "")


def window_starts(text: Column, target: int | Column = TARGET, overlap: int = OVERLAP) -> Column:
    """Start places (from 0): one if the text fits, else every target - overlap until a window reaches the end."""
    target = F.lit(target) if isinstance(target, int) else target
    step = target - overlap
    last = F.ceil((F.length(text) - target) / step).cast("int")
    return F.when(F.length(text) <= target, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: i * step))


def _snapped(wide: Column, lo: Column, hi: Column, is_first: Column, is_last: Column, pad: int, snap_ends: bool) -> Column:
    """wide[lo:hi] with both ends moved to word boundaries within ``pad``; ``wide`` is the piece with what stands ``pad`` round it."""

    def cut(w: Column) -> Column:
        head, lo, hi = w["head"], w["lo"], w["hi"]
        lead, trail = (F.length(F.regexp_extract(c, f"^{NOT_BOUNDARY}*", 0)) for c in (head, F.reverse(w["tail"])))
        new_lo = F.when(lead < F.length(head), lo + lead + 1).otherwise(lo)
        new_hi = F.when(trail < F.length(w["tail"]), hi - trail).otherwise(hi)
        if not snap_ends:
            new_lo, new_hi = F.when(is_first, lo).otherwise(new_lo), F.when(is_last, hi).otherwise(new_hi)
        return let(F.struct(new_lo.alias("lo"), new_hi.alias("hi")), lambda e: F.when(e["lo"] < e["hi"], F.substring(w["wide"], e["lo"] + 1, e["hi"] - e["lo"])).otherwise(w["wide"]))

    back = F.greatest(hi - pad, F.lit(0))
    parts = F.struct(wide.alias("wide"), lo.alias("lo"), hi.alias("hi"), F.substring(wide, lo + 1, F.lit(pad)).alias("head"), F.substring(wide, back + 1, hi - back).alias("tail"))
    return let(parts, cut)


def safe_slice(text: Column, start: Column, end: Column, pad: int = PAD, snap_ends: bool = False) -> Column:
    """text[start:end] with both ends moved to word boundaries within ``pad``.

    ``snap_ends`` also moves the first start and the last end, which loses the first and perhaps the last word;
    without it a window that begins or ends with the text keeps it all. If the ends cross, the padded piece is returned.
    """

    def of(t: Column) -> Column:
        n, start, end, before = t["n"], t["s"], F.least(t["e"], t["n"]), F.least(t["s"], F.lit(pad))
        wide = F.substring(text, start - before + 1, F.least(end + pad, n) - start + before)
        return let(wide, lambda w: _snapped(w, before, before + end - start, start == 0, end == n, pad, snap_ends))

    return let(F.struct(F.length(text).alias("n"), start.alias("s"), end.alias("e")), of)


def squeeze(c: Column) -> Column:
    return X.strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def windows(text: Column, target: int | Column = TARGET, overlap: int = OVERLAP, snap_ends: bool = False) -> Column:
    """array<string> of a text's windows; a text of at most two targets is one piece."""
    target = F.lit(target) if isinstance(target, int) else target
    return F.when(F.length(text) <= 2 * target, F.array(text)).otherwise(slid(text, target, overlap, snap_ends))


def slid(text: Column, target: Column, overlap: int = OVERLAP, snap_ends: bool = False, pad: int = PAD) -> Column:
    """array<string> of a text's windows, however short it is.

    The text is cut into steps once and a window is put together from the steps it covers, so the time is linear in
    the text's length: a substring of the whole text would be looked for from its beginning, at every window.
    """
    step = target - overlap
    steps = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}")), F.lit(0))
    covered = F.ceil((target + pad) / step).cast("int")

    def window(t: Column, s: Column, i: Column) -> Column:
        before, end = F.when(i == 0, F.lit(0)).otherwise(F.lit(pad)), F.least(s + target, t["n"])
        near = F.concat(F.coalesce(F.right(F.get(t["p"], i - 1), F.lit(pad)), F.lit("")), F.array_join(F.slice(t["p"], i + 1, covered), ""))
        wide = F.substring(near, F.lit(1), before + F.least(end + pad, t["n"]) - s)
        return let(wide, lambda w: X.strip(_snapped(w, before, before + end - s, i == 0, end == t["n"], pad, snap_ends)))

    parts = F.struct(F.length(text).alias("n"), steps.alias("p"), window_starts(text, target, overlap).alias("s"))
    return let(parts, lambda t: F.transform(t["s"], lambda s, i: window(t, s, i)))


def table_blocks(text: Column) -> Column:
    """array<string> of the pieces that begin with the mark of an extracted table; what stands before the first mark is a piece too."""
    blocks = F.filter(F.transform(F.split(text, TABLE_MARK), X.strip), lambda b: b != "")
    return F.transform(blocks, lambda b: F.concat(F.lit(TABLE_MARK), b))


def chunk_documents(docs: DataFrame, snap_ends: bool = False, id_by_section: bool = True, chrome: tuple[str, ...] = CHROME, codes: tuple[str, ...] = COURSE_CODES) -> DataFrame:
    """Chunks of (source_url, source_title, bucket, tags, md): one row a chunk, ids kept first.

    ``id_by_section`` adds the section's number to what an id is made from, so that sections of equal headings don't collide;
    without it the later of two equal ids is dropped. A document without a section is one section; a section with marks of extracted
    tables is cut at them; program pages of the catalog are cleaned of ``chrome``, then the courses of ``codes`` put on one line, and have longer windows.
    """
    catalog = F.coalesce(F.col("bucket") == PROGRAMS, F.lit(False))
    md = F.coalesce(F.col("md"), F.lit(""))
    cleaned = F.when(catalog, normalize_courses(clean_catalog_text(md, chrome), codes)).otherwise(md)
    # materialised step by step, so that each text is worked out once
    d = docs.withColumn("_md", cleaned).withColumn("_target", F.when(catalog, CATALOG_TARGET).otherwise(TARGET))
    d = d.withColumn("_secs", heading_sections(F.col("_md")))
    whole = F.array(F.struct(F.array().cast("array<string>").alias("headings"), F.col("_md").alias("text")))
    d = d.withColumn("_secs", F.when(F.size("_secs") == 0, whole).otherwise(F.col("_secs")))
    d = d.select("*", F.posexplode("_secs").alias("_s", "_sec")).drop("_secs").withColumn("_text", F.col("_sec.text"))
    d = d.withColumns({"_tables": F.col("_text").contains(TABLE_MARK), "_long": squeeze(F.col("_text"))})
    pieces = F.when(F.col("_tables"), table_blocks(F.col("_text"))).when(F.length("_text") <= 2 * F.col("_target"), F.array("_text"))
    d = d.select("*", F.posexplode(pieces.otherwise(slid(F.col("_long"), F.col("_target"), snap_ends=snap_ends))).alias("_i", "text"))
    heads = F.col("_sec.headings")
    i = F.concat(F.col("_s"), F.lit("."), F.col("_i") + 1) if id_by_section else (F.col("_i") + 1)
    out = d.select(
        F.when(F.col("_tables"), X.table_chunk_id(F.col("source_url"), heads, i)).otherwise(X.chunk_id(F.col("source_url"), heads, i)).alias("id"),
        "source_url",
        F.col("source_title").alias("title"),
        "bucket",
        "tags",
        heads.alias("headings"),
        F.coalesce(F.try_element_at(heads, F.lit(-1)), F.lit("")).alias("section_heading"),
        "text",
        (F.col("_tables") | X.is_table_block(F.col("text"))).alias("is_table"),
        X.section_label(heads).alias("section"),
        X.infer_term(F.col("text"), heads).alias("term"),
        F.col("_s").alias("section_no"),
        (F.col("_i") + 1).alias("piece_no"),
    )
    return keep_first(out, ["id"], ["source_url", "section_no", "piece_no"])


#: Buckets whose table rows become chunks where the configuration names none.
ALLOWED = ("registrar",)


def allowed_buckets(config: dict | None) -> list[str]:
    """The configuration's ``allowed_buckets``; ``["*"]`` if they hold it; ALLOWED if the key is missing, empty or no list."""
    found = (config or {}).get("allowed_buckets")
    named = [x for x in (str(b).strip() for b in found) if x] if isinstance(found, list) else []
    return ["*"] if "*" in named else list(dict.fromkeys(named)) if named or (isinstance(found, list) and found) else list(ALLOWED)


def united_chunks(chunks: DataFrame, rows: DataFrame, config: dict | None = None) -> DataFrame:
    """Documents' chunks and the row chunks of the allowed buckets as one table; documents' chunks have no has_deadline_words. Ids stay as they are, the first of equal ones kept."""
    both = chunks.withColumn("has_deadline_words", F.lit(None).cast("boolean")).withColumn("_from", F.lit(0)).unionByName(row_chunks(rows, allowed_buckets(config)).withColumn("_from", F.lit(1)))
    return keep_first(both, ["id"], ["_from", "source_url", "section_no", "piece_no"]).drop("_from")


def row_chunks(rows: DataFrame, allowed: list[str] | tuple[str, ...] = ALLOWED) -> DataFrame:
    """Table rows (url, section_heading, text, bucket, term, has_deadline_words) of the allowed buckets (``*``: all) as chunks."""
    kept = rows if "*" in allowed else rows.filter(F.col("bucket").isin(list(allowed)))
    return kept.select(
        X.row_chunk_id(F.col("url"), F.col("text")).alias("id"), F.col("url").alias("source_url"), F.lit("Calendar Row").alias("title"), "bucket", F.array().cast("array<string>").alias("tags"),
        F.array("section_heading").alias("headings"), "section_heading", "text", F.lit(True).alias("is_table"), F.lit("calendar").alias("section"), "term", F.lit(0).alias("section_no"), F.lit(1).alias("piece_no"), "has_deadline_words",
    )


def split_courses(docs: DataFrame, code: str = "CSIT") -> DataFrame:
    """Course rows (url, number, title, credits, body, ordinal) of markdown whose bold lines "CODE nnn Title (n credits)" start a course."""
    pattern = rf"^{code}\s+(\d{{3}})\s+(.*?)\s*\((\d+)\s+credits?\)\s*$"
    start = F.array().cast("array<struct<h:string,lines:array<string>>>")

    def add(acc: Column, line: Column) -> Column:
        head = X.heading_line(line)
        last = F.try_element_at(acc, F.lit(-1))
        more = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["h"].alias("h"), F.array_append(last["lines"], line).alias("lines"))))
        return F.when(head.rlike(pattern), F.array_append(acc, F.struct(head.alias("h"), F.array().cast("array<string>").alias("lines")))).when(F.size(acc) == 0, acc).otherwise(more)

    groups = docs.select("url", F.posexplode(F.aggregate(F.split("md", "\n"), start, add)).alias("ordinal", "g"))
    h = F.col("g.h")
    return groups.select("url", F.regexp_extract(h, pattern, 1).alias("number"), F.regexp_extract(h, pattern, 2).alias("title"), F.regexp_extract(h, pattern, 3).cast("int").alias("credits"), X.strip(F.array_join("g.lines", "\n")).alias("body"), "ordinal")
