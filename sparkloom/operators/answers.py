"""From ranked chunks to answers: deadline look-up, context, prompt, primary source, knowledge items, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.arrays import let
from sparkloom.operators.chunking import COURSE_CODES
from sparkloom.operators.ranking import is_requirements_question
from sparkloom.operators.retrieval import pair_up
from sparkloom.operators.selection import keep_first

SNIPPETS, SNIPPET_CHARS = 6, 1000
# Fixed values.
ADVISOR_WORDS = ("advisor", "advisors", "advising", "gpc", "graduate program coordinator", "graduate program chair")


def table_deadline(text: Column) -> Column:
    """The date in the "final day to withdraw" column of a pipe table's full-term row, or null."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    is_head = lambda x: F.lower(x).contains("final day to wd") | F.lower(x).contains("final day to withdraw")

    def cells(x: Column) -> Column:
        return F.transform(F.split(x, r"\|"), lambda c: F.trim(c))

    head_at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(is_head(x), i)), lambda i: i.isNotNull()), F.lit(0))
    head = F.get(lines, head_at)
    col = F.get(F.filter(F.transform(cells(head), lambda c, i: F.when(is_head(c), i)), lambda i: i.isNotNull()), F.lit(0))
    below = F.filter(F.transform(lines, lambda x, i: F.when(i > head_at, x)), lambda x: x.isNotNull())
    full = F.filter(below, lambda x: F.lower(x).contains("full term") | F.lower(x).rlike(r"^\| full[ \t]") | F.lower(x).contains("| full |"))
    loose = F.filter(below, lambda x: ~x.startswith("| ---") & F.lower(x).contains("| full"))
    row = F.coalesce(F.get(full, F.lit(0)), F.get(loose, F.lit(0)))
    return F.nullif(F.regexp_extract(F.get(cells(row), col), X.DATE, 0), F.lit(""))


def deadline_answers(ranked: DataFrame) -> DataFrame:
    """Deadline questions (ranked rows with terms) that a registrar table answers: qid, answer, url, bucket, title.

    For each term (or none) the first registrar table of that term is looked up; the answer names the table's term, else its
    heading, else the question's term.
    """
    rows = ranked.filter((F.col("intent") == "deadline") & (F.col("bucket") == "registrar") & F.col("is_table"))
    rows = rows.withColumn("term", F.explode(F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.array(F.lit(None).cast("string")))))
    where = F.lower(F.coalesce(F.nullif(F.col("chunk_term"), F.lit("")), F.col("section_heading"), F.lit("")))
    rows = rows.filter(F.col("term").isNull() | where.contains(F.lower("term")) | F.lower(F.coalesce("section_heading", F.lit(""))).contains(F.lower("term")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "term").orderBy("rank"))).filter("_n = 1")
    found = first.withColumn("date", table_deadline(F.col("text"))).filter("date is not null")
    named = F.coalesce(F.nullif(F.col("chunk_term"), F.lit("")), F.nullif(F.col("section_heading"), F.lit("")), F.col("term"), F.lit("this term"))
    found = found.withColumn("_t", named).withColumn("_at", F.coalesce(F.array_position("terms", F.col("term")), F.lit(0)))
    per = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_at", "_t", "date", "url", "bucket", "section_heading"))).alias("x"))
    lead = "According to the Registrar's Add/Drop & Withdrawal calendar, "
    one = F.concat(F.lit(lead + "the Final Day to Withdraw for "), F.col("x")[0]["_t"], F.lit(" is **"), F.col("x")[0]["date"], F.lit("**."))
    many = F.concat(F.lit(lead), F.array_join(F.transform("x", lambda y: F.concat(F.lit("for "), y["_t"], F.lit(" it is **"), y["date"], F.lit("**"))), "; "), F.lit("."))
    return per.select("qid", F.when(F.size("x") == 1, one).otherwise(many).alias("answer"), F.col("x")[0]["url"].alias("url"), F.col("x")[0]["bucket"].alias("bucket"), F.col("x")[0]["section_heading"].alias("title"))


def requirement_sections(ranked: DataFrame) -> DataFrame:
    """Drops elective catalog sections for questions about required courses; a question that would lose all keeps all."""
    q, sec = F.lower("query"), F.lower(F.coalesce("section_heading", F.lit("")))
    wants_electives = q.contains("elective")
    names = ("required courses", "required core", "program requirements", "degree requirements")
    wants = F.lit(False)
    named = F.lit(False)
    for n in names:
        wants, named = wants | q.contains(n), named | sec.contains(n)
    asked = wants | wants_electives | is_requirements_question(F.col("query"))
    drop = asked & wants & ~wants_electives & (F.col("bucket") == "catalog-programs") & ~named & sec.contains("elective")
    left = F.sum((~drop).cast("int")).over(Window.partitionBy("qid"))
    return ranked.withColumn("_drop", drop).withColumn("_left", left).filter((F.col("_left") == 0) | ~F.col("_drop")).drop("_drop", "_left")


def contexts(ranked: DataFrame, size: int = SNIPPET_CHARS, most: int = SNIPPETS) -> DataFrame:
    """Per question the numbered snippets of its first chunks: qid, query, context, n_snippets."""
    rows = requirement_sections(ranked).withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("_n") <= most)
    head = X.heading_text(F.coalesce("section_heading", F.lit("")))
    block = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), head, F.lit("\n"), F.col("url"), F.lit("\n"), X.snippet(F.col("text"), size))
    per = rows.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("_n", block.alias("b")))).alias("x"))
    return per.select("qid", "query", F.array_join(F.transform("x", lambda y: y["b"]), "\n\n").alias("context"), F.size("x").alias("n_snippets"))


SYSTEM_PROMPT = "Answer from the numbered sources alone. Say so if they don't hold the answer. Don't count credits for a person."


def prompts(ranked: DataFrame, system: str = SYSTEM_PROMPT) -> DataFrame:
    return contexts(ranked).select("qid", F.lit(system).alias("system"), F.concat(F.lit("Question: "), "query", F.lit("\n\nSources:\n"), "context").alias("user"), "n_snippets")


def primary_sources(ranked: DataFrame) -> DataFrame:
    """Per question its main source: qid, url, bucket, title (its heading, else its ``title`` where the rows have one). Advisor questions prefer a school page that names advisors."""
    q, url, text = F.lower("query"), F.lower("url"), F.lower("text")
    asks = F.lit(False)
    for w in ADVISOR_WORDS:
        asks = asks | q.contains(w)
    fits = asks & url.contains("school-of-computing") & (text.contains("advisor") | text.contains("graduate program coordinator") | text.contains("gpc"))
    best = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.coalesce(fits, F.lit(False))), "rank"))).filter("_n = 1")
    return best.select("qid", "url", "bucket", F.coalesce(F.nullif("section_heading", F.lit("")), F.col("title") if "title" in ranked.columns else F.lit(None).cast("string"), F.lit("")).alias("title"))


def generate(prompts_: DataFrame, generator: Callable[[str, str], str]) -> DataFrame:
    """Answers of a pluggable generator, (system, user) -> answer; it is made once for a batch of rows, by Arrow."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"qid": b["qid"], "answer": [generator(s, u) for s, u in zip(b["system"], b["user"], strict=True)]})

    return prompts_.select("qid", "system", "user").mapInPandas(run, f"qid {prompts_.schema['qid'].dataType.simpleString()}, answer string")


def answer_questions(ranked: DataFrame, generator: Callable[[str, str], str]) -> DataFrame:
    """qid, answer, source struct<idx, url, bucket, title>, intent: from a table where one answers, else by the generator."""
    fast = deadline_answers(ranked)
    rest = ranked.join(fast.select("qid"), "qid", "left_anti")
    slow = generate(prompts(rest), generator).join(primary_sources(rest), "qid", "left")
    intents = ranked.groupBy("qid").agg(F.first("intent").alias("intent"))
    cols = ["qid", "answer", "url", "bucket", "title"]
    both = fast.select(*cols).unionByName(slow.select(*cols)).join(intents, "qid")
    return both.select("qid", "answer", F.struct(F.lit(1).alias("idx"), "url", "bucket", "title").alias("source"), "intent")


def seed_score(text: Column, must_any: Column, prefer_any: Column) -> Column:
    """-1 unless the text holds a must word; else 2 a preferred word, plus up to 3 for being short."""
    low = F.lower(text)
    ok = F.exists(must_any, lambda w: low.contains(F.lower(w)))
    hits = F.size(F.filter(prefer_any, lambda w: low.contains(F.lower(w))))
    return F.when(ok, 2 * hits + F.greatest(F.lit(0), 3 - F.floor(F.length(text) / 800).cast("int"))).otherwise(-1)


def best_chunks(seeds: DataFrame, chunks: DataFrame, order: str = "ordinal") -> DataFrame:
    """Per seed (seed_no, question, must_any, prefer_any) the best chunk; of equals the first. One map-side combined aggregate."""
    both = pair_up(seeds, chunks).withColumn("score", seed_score(F.col("text"), F.col("must_any"), F.col("prefer_any"))).filter("score >= 0")
    keep = [c for c in both.columns if c not in seeds.columns]
    best = both.groupBy("seed_no").agg(F.min_by(F.struct(*keep), F.struct((-F.col("score")).alias("s"), F.col(order).alias("o"))).alias("_b"))
    return seeds.join(best, "seed_no").select(*seeds.columns, "_b.*")


def knowledge_items(seeds: DataFrame, chunks: DataFrame, limit: int = 900) -> DataFrame:
    """id, topic, question, answer, source_url, bucket, headings, chunk_id of the seeds that find a chunk."""
    best = best_chunks(seeds, chunks)
    return best.select(X.answer_id(F.col("question")).alias("id"), "topic", "question", X.trim_answer(F.col("text"), limit).alias("answer"), "source_url", "bucket", "headings", F.col("id").alias("chunk_id"))


def judge(rows: DataFrame) -> DataFrame:
    """Adds substring_match, em, f1 and source_correct to rows (answer, expected_substring, expected_answer, expected_source_url, primary_url)."""
    a, want = X.normalize_text(F.col("answer")), X.normalize_text(F.col("expected_substring"))
    gold = F.coalesce(F.col("expected_answer"), F.col("expected_substring"), F.lit(""))
    em = F.when(F.col("expected_answer").isNotNull(), (a == X.normalize_text(F.col("expected_answer"))).cast("int")).otherwise(0)
    source = F.when(F.col("expected_source_url").isNotNull(), F.coalesce(F.col("primary_url").contains(F.col("expected_source_url")), F.lit(False)).cast("int"))
    return rows.withColumns({"substring_match": ((want != "") & a.contains(want)).cast("int"), "em": em, "f1": F.round(X.token_f1(F.col("answer"), gold), 6), "source_correct": source})


def overall(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("n"), F.round(F.avg("substring_match"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.avg(F.when(F.col("expected_answer").isNotNull(), F.col("em"))), 6).alias("em"), F.round(F.avg("source_correct"), 6).alias("source_accuracy"))


def by_category(judged: DataFrame) -> DataFrame:
    return judged.groupBy("category").agg(F.count("*").alias("n"), F.sum("substring_match").alias("correct"), F.round(F.avg("substring_match"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("avg_f1"))


def failures(judged: DataFrame, k: int = 5) -> DataFrame:
    """The first failing questions, a report."""
    return judged.filter("substring_match = 0").orderBy("id").limit(k)


def regression(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases (qid, name, expect_intent, expect_url, expect_bucket, top_k; null: not checked) against ranked rows: name, intent_ok, url_ok, bucket_ok, passed."""
    hits = cases.join(ranked.select("qid", "intent", "url", "bucket", "rank"), "qid", "left")
    near = F.coalesce(F.col("rank") <= F.col("top_k"), F.lit(False))
    per = hits.groupBy("qid", "name", "expect_intent", "expect_url", "expect_bucket").agg(
        F.coalesce(F.bool_or(F.col("intent") == F.col("expect_intent")), F.lit(False)).alias("i"), F.coalesce(F.bool_or(near & F.col("url").contains(F.col("expect_url"))), F.lit(False)).alias("u"), F.coalesce(F.bool_or(near & (F.col("bucket") == F.col("expect_bucket"))), F.lit(False)).alias("b")
    )
    ok = {c: F.col(e).isNull() | F.col(s) for c, e, s in (("intent_ok", "expect_intent", "i"), ("url_ok", "expect_url", "u"), ("bucket_ok", "expect_bucket", "b"))}
    return per.select("name", *[c.alias(n) for n, c in ok.items()], (ok["intent_ok"] & ok["url_ok"] & ok["bucket_ok"]).alias("passed"))


#: Lines that begin the list of required courses, and beginnings of lines that end it.
REQUIRED_STARTS = ("required courses", "required core courses")
REQUIRED_STOPS = r"(?i)^(?:electives|elective courses|culminating experience|total credits)\b"


def required_courses(docs: DataFrame, codes: tuple[str, ...] = COURSE_CODES) -> DataFrame:
    """Courses (url, code, title, credits) of the lines between a text's first required-courses line and the next stop heading; each code once, the first.

    A course is one line "CODE nnn Title (n credits)", or three: a code alone, its title, a line of one or two digits. A missing title
    or number of credits is null. Texts without a required-courses line, null and empty texts give no row.
    """
    lines = F.filter(F.transform(F.split("text", r"\r\n|\n|\r"), X.strip), lambda x: x != "")
    starts = lambda x: F.exists(F.array(*[F.lit(n) for n in REQUIRED_STARTS]), lambda n: F.contains(F.lower(x), n))
    lo = F.array_position(F.transform("_l", starts), True).cast("int")
    after = F.when(F.col("_lo") > 0, F.slice("_l", F.col("_lo") + 1, F.size("_l"))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform("_a", lambda x: x.rlike(REQUIRED_STOPS)), True).cast("int")
    d = docs.select("url", lines.alias("_l")).withColumn("_lo", lo).withColumn("_a", after).withColumn("_stop", stop)
    d = d.select("url", F.when(F.col("_stop") > 0, F.slice("_a", F.lit(1), F.col("_stop") - 1)).otherwise(F.col("_a")).alias("_b"))
    d = d.select("url", F.posexplode(let(F.col("_b"), lambda b: F.transform(b, lambda x, i: F.struct(x.alias("line"), F.get(b, i + 1).alias("title"), F.get(b, i + 2).alias("credits"))))).alias("n", "c"))
    code = rf"(?i)^((?:{'|'.join(codes)})[\s\u00a0]*\d{{3}})\b"
    full = code + r"[\s\u00a0]*[-–:]?\s*(.*?)\s*(?:\((\d+)\s+credits?\))?\s*$"
    line = F.col("c.line")
    x = lambda i: F.nullif(F.trim(F.regexp_extract(line, full, i)), F.lit(""))
    alone = x(2).isNull() & x(3).isNull()
    below = F.when(alone & ~F.col("c.title").rlike(code), F.col("c.title"))
    number = F.when(below.isNotNull() & F.col("c.credits").rlike(r"^\d{1,2}$"), F.col("c.credits"))
    rows = d.filter(line.rlike(code)).select("url", F.upper(F.trim(F.replace(F.regexp_extract(line, code, 1), F.lit("\u00a0"), F.lit(" ")))).alias("code"), F.coalesce(x(2), below).alias("title"), F.coalesce(x(3), number).cast("int").alias("credits"), "n")
    return keep_first(rows, ["url", "code"], ["n"]).drop("n")
