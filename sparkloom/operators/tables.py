"""Tables of pages to calendar rows and row chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X

# Headers of deadline tables, and header names of the calendar's three fields.
DEADLINE_HEADERS = ("last day to add", "last day to add/drop", "last day to withdraw", "final day to withdraw", "withdrawal period begins", "waitlist ends")
TERM_NAMES = ("term", "part of term", "part of term & description")
ADD_NAMES = ("last day to add/drop (100% adjustment)", "last day to add/drop", "last day to add or drop 100%")
WITHDRAW_NAMES = ("final day to withdraw", "final day to withdraw classes (50% adjustment)", "final day to withdraw classes  (50% adjustment)", "final day to wd")
DESCRIPTION_NAMES = ("part of term", "term & description", "description", "part of term & description")
FINAL_NAMES = ("final day to withdraw", "final day to withdraw classes", "final day to wd")
NO_HEADING = "Calendar"
SESSION = r"(?i)(session\s+[abc])"


def is_deadline_table(headers: Column) -> Column:
    joined = F.lower(F.array_join(headers, " | ", ""))
    out = (joined.contains("last day") & joined.contains("withdraw")) | joined.contains("add/drop") | joined.contains("add or drop")
    for p in DEADLINE_HEADERS:
        out = out | joined.contains(p)
    return out


def table_term(headers: Column, rows: Column, heading: Column) -> Column:
    """Season of the dates' months with the first year of the cells (else the heading's, else none); without such dates, the heading's term."""
    cells = F.flatten(rows)
    season = X.season_of(X.months_of(cells))
    year = F.coalesce(F.nullif(F.regexp_extract(F.array_join(cells, " "), r"\b(20\d{2})\b", 1), F.lit("")), F.nullif(F.regexp_extract(heading, r"\b(20\d{2})\b", 1), F.lit("")))
    return F.when(season != "", F.concat_ws(" ", season, year)).otherwise(X.first_term(heading))


def _value(headers: Column, row: Column, names: tuple[str, ...]) -> Column:
    low = F.transform(headers, lambda h: F.lower(F.trim(h)))
    found = [F.nullif(F.trim(F.get(row, F.array_position(low, F.lit(n)).cast("int") - 1)), F.lit("")) for n in names]
    return F.coalesce(*[F.when(F.array_contains(low, n), v) for n, v in zip(names, found, strict=True)])


def calendar(tables: DataFrame) -> DataFrame:
    """url, term, last_day_to_add_drop, final_day_to_withdraw of table rows that have a term or a withdrawal day."""
    d = tables.withColumn("_t", table_term(F.col("headers"), F.col("rows"), F.col("heading"))).select("url", "table_no", "headers", "_t", F.posexplode("rows").alias("row_no", "row"))
    h, r = F.col("headers"), F.col("row")
    out = d.select("url", "table_no", "row_no", F.coalesce(F.nullif(F.col("_t"), F.lit("")), _value(h, r, TERM_NAMES)).alias("term"), _value(h, r, ADD_NAMES).alias("last_day_to_add_drop"), _value(h, r, WITHDRAW_NAMES).alias("final_day_to_withdraw"))
    return out.filter("term is not null or final_day_to_withdraw is not null")


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def pipe_head(headers: Column) -> Column:
    """A pipe table's header line and the rule below it."""
    return F.concat(pipe_row(headers), F.lit("\n"), pipe_row(F.transform(headers, lambda h: F.lit("---"))))


def row_records(tables: DataFrame, bucket: str | Column = "") -> DataFrame:
    """One record a body row of each deadline table.

    type, url, section_heading ("Calendar" without a heading), text ("**header:** value" lines), bucket, term (the most frequent term of the row, the
    heading and the table's term; else the table's), session (likewise, or null), desc, final_withdraw, waitlist_ends (the cell of the first
    header that has one of the names, or null), headers, full_md (the row as a table of its own), has_deadline_words (true), table_no, row_no.
    A row without text gives a record with an empty text.
    """
    d = tables.filter(is_deadline_table(F.col("headers"))).withColumn("term", table_term(F.col("headers"), F.col("rows"), F.col("heading")))
    d = d.select("url", "table_no", "heading", "headers", "term", F.posexplode("rows").alias("row_no", "row"))
    low = F.transform("headers", lambda h: F.lower(h))
    column = lambda *names: F.get("row", X.find_column(low, list(names)))
    said = F.concat_ws(" | ", F.array_join("row", " | ", ""), "heading", "term")
    terms = F.regexp_extract_all(said, F.lit(X.TERM), F.lit(0))
    return d.select(
        F.lit("table_row").alias("type"), "url", F.coalesce(F.nullif(F.col("heading"), F.lit("")), F.lit(NO_HEADING)).alias("section_heading"), X.row_to_text(F.col("headers"), F.col("row")).alias("text"),
        (F.lit(bucket) if isinstance(bucket, str) else bucket).alias("bucket"), F.coalesce(X.most_common(terms), F.col("term")).alias("term"), X.most_common(F.regexp_extract_all(said, F.lit(SESSION), F.lit(1))).alias("session"),
        column(*DESCRIPTION_NAMES).alias("desc"), column(*FINAL_NAMES).alias("final_withdraw"), column("waitlist ends").alias("waitlist_ends"), "headers",
        F.concat(pipe_head(F.col("headers")), F.lit("\n"), pipe_row(F.col("row"))).alias("full_md"), F.lit(True).alias("has_deadline_words"), "table_no", "row_no",
    )


def row_objects(records: DataFrame) -> DataFrame:
    """Row records as they are written: type, url, section_heading, text, meta."""
    meta = F.struct(F.lit(True).alias("table"), "bucket", "term", "session", "final_withdraw", "waitlist_ends", "desc", "headers", "full_md", "has_deadline_words")
    return records.select("type", "url", "section_heading", "text", meta.alias("meta"))


def table_markdown(tables: DataFrame) -> DataFrame:
    """Per page (url, md): its tables in order, numbered, each under its SECTION and TERM marks."""
    term = table_term(F.col("headers"), F.col("rows"), F.col("heading"))
    d = tables.withColumn("_t", term).withColumn("_no", F.row_number().over(Window.partitionBy("url").orderBy("table_no")))
    mark = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{name}:** "), c))
    body = F.concat_ws("\n", pipe_head(F.col("headers")), F.array_join(F.transform("rows", pipe_row), "\n"))
    one = F.concat_ws("\n\n", F.concat(F.lit("### Table "), F.col("_no").cast("string")), mark("SECTION", F.col("heading")), mark("TERM", F.col("_t")), body)
    return d.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("_no", one.alias("md")))).alias("l")).select("url", F.array_join(F.transform("l", lambda x: x["md"]), "\n\n").alias("md"))


def table_summary(tables: DataFrame) -> DataFrame:
    """Per page (url, summary): source, tables_found, rows under their own columns' names, normalized_calendar, as a VARIANT.

    Columns are known only when a table is read, so a row is an object with its table's keys; of equal keys the first is kept.
    """
    cells = column_maps(tables).groupBy("url").agg(F.sort_array(F.collect_list(F.struct("table_no", "row_no", F.to_json("cells").alias("j")))).alias("r"))
    days = calendar(tables).groupBy("url").agg(F.sort_array(F.collect_list(F.struct("table_no", "row_no", "term", "last_day_to_add_drop", "final_day_to_withdraw"))).alias("c"))
    found = tables.groupBy("url").agg(F.count("*").alias("n")).join(cells, "url", "left").join(days, "url", "left")
    calendar_json = F.coalesce(F.to_json(F.transform("c", lambda x: F.struct(x["term"].alias("term"), x["last_day_to_add_drop"].alias("last_day_to_add_drop"), x["final_day_to_withdraw"].alias("final_day_to_withdraw"))), {"ignoreNullFields": "false"}), F.lit("[]"))
    rows = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("")), F.lit("]"))
    text = F.concat(F.lit('{"source":"table_extractor","tables_found":'), F.col("n").cast("string"), F.lit(',"rows":'), rows, F.lit(',"normalized_calendar":'), calendar_json, F.lit("}"))
    return found.select("url", F.parse_json(text).alias("summary"))


def write_table_exports(tables: DataFrame, folder: str) -> None:
    """The three exports below a folder: markdown (a row a page, with its url), summaries and row records as JSON lines."""
    table_markdown(tables).write.mode("overwrite").parquet(f"{folder}/markdown")
    table_summary(tables).select(F.to_json(F.struct("url", "summary")).alias("value")).write.mode("overwrite").text(f"{folder}/summary")
    row_objects(row_records(tables)).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/rows")


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Written summaries (url, summary VARIANT), whatever keys their rows have."""
    v = spark.read.text(f"{folder}/summary").select(F.parse_json("value").alias("v"))
    return v.select(F.variant_get("v", "$.url", "string").alias("url"), F.variant_get("v", "$.summary", "variant").alias("summary"))


def pipe_tables(docs: DataFrame) -> DataFrame:
    """Tables of markdown text (url, md): header, rule and rows; url, table_no (line), heading, headers, rows. The rule is no data row."""
    part = "struct<at:int,heading:string,lines:array<string>>"
    start = F.struct(F.lit("").alias("heading"), F.array().cast(f"array<{part}>").alias("done"), F.array().cast("array<string>").alias("run"), F.lit(0).alias("at"))

    def flush(acc: Column) -> Column:
        ok = (F.size(acc["run"]) >= 3) & F.get(acc["run"], F.lit(1)).rlike(r"^\|?\s*:?-{3,}")
        return F.when(ok, F.array_append(acc["done"], F.struct(acc["at"].alias("at"), acc["heading"].alias("heading"), acc["run"].alias("lines")))).otherwise(acc["done"])

    def add(acc: Column, x: Column) -> Column:
        line, i = x["line"], x["i"]
        is_row, is_head = line.startswith("|"), line.rlike(r"^#{1,6}\s+\S")
        return F.struct(
            F.when(is_head, F.trim(F.regexp_replace(line, "^#+", ""))).otherwise(acc["heading"]).alias("heading"),
            F.when(is_row, acc["done"]).otherwise(flush(acc)).alias("done"),
            F.when(is_row, F.array_append(acc["run"], line)).otherwise(F.array().cast("array<string>")).alias("run"),
            F.when(is_row & (F.size(acc["run"]) == 0), i).otherwise(acc["at"]).alias("at"),
        )

    lines = F.transform(F.split("md", "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("i")))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    d = docs.select("url", F.explode(F.aggregate(lines, start, add, flush)).alias("t"))
    body = F.transform(F.slice("t.lines", 3, F.size("t.lines")), cells)
    return d.select("url", F.col("t.at").alias("table_no"), F.col("t.heading").alias("heading"), cells(F.get("t.lines", F.lit(0))).alias("headers"), body.alias("rows"))


def column_maps(tables: DataFrame) -> DataFrame:
    """Table rows with any columns as maps: url, table_no, row_no, cells map<string,string> (of equal headers the first)."""
    d = tables.select("url", "table_no", "headers", F.posexplode("rows").alias("row_no", "row"))
    pairs = F.zip_with("headers", "row", lambda h, v: F.struct(F.coalesce(h, F.lit("")).alias("k"), v.alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return d.select("url", "table_no", "row_no", F.map_from_entries(first).alias("cells"))


def summaries(tables: DataFrame) -> DataFrame:
    """Per page: source, tables_found, n_rows, deadline_tables."""
    return tables.groupBy(F.col("url").alias("source")).agg(F.count("*").alias("tables_found"), F.sum(F.size("rows")).alias("n_rows"), F.sum(is_deadline_table(F.col("headers")).cast("int")).alias("deadline_tables"))
