"""Small inline tables for shapes that the Parquet tables don't hold, as a DataFrame and as DuckDB VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return repr(x)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression "name(columns) AS (VALUES ...)"."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


MD_SCHEMA = "source_url string, source_title string, bucket string, tags array<string>, md string"
MD_DOCS = [
    ("https://uni.example.com/a/", "A", "policies", ["policies"], "intro text\n# One\nbody of one\n### Three deep\nthree\n### Three again\nmore\n## Two\n\n# Empty\n# Last\nend"),
    ("https://uni.example.com/b/", "B", "registrar", ["registrar"], "## Fall 2025 Calendar\n| Term | Final Day to WD |\n| --- | --- |\n| Full Term | 12/2 |\n\n## Notes\n" + "word and more words, " * 140),
    ("https://uni.example.com/c/", "C", "policies", ["policies"], ""),
    ("https://uni.example.com/d/", "D", "registrar", [], "no headings at all"),
]

TABLE_SCHEMA = "url string, table_no int, heading string, headers array<string>, rows array<array<string>>"
TABLES = [
    ("u1", 0, "Fall 2025 dates", ["Part of Term", "Last Day to Add/Drop", "Final Day to Withdraw"], [["Full Term", "9/8", "11/4"], ["Session A", "9/3", "10/1"]]),
    ("u1", 1, "Rooms", ["Room", "Seats"], [["101", "30"]]),
    ("u2", 0, "Dates", ["Term", "Waitlist ends", "Final Day to WD"], [["Full", "1/20/2026", "4/2/2026"], ["", "2/3/2026", ""]]),
    ("u3", 0, "Winter 2026", ["Event", "Last day to withdraw"], [["A", "12/23"], ["B", "1/5"]]),
]

#: Also a year in a header only, another year in a cell, months without a year, no date at all.
TERM_TABLES = [
    *TABLES,
    ("u4", 0, "Dates of 2023", ["Event 2024", "Last day to add"], [["A", "9 / 8"], ["B", "10/1/2025"]]),
    ("u4", 1, "Dates", ["Event 2024", "Waitlist ends"], [["A", "6/30"], ["B", "9/123"]]),
    ("u4", 2, "In SPRING 2027 and later", ["Event", "Add or drop"], [["A", "13/40"]]),
]

SEED_SCHEMA = "seed_no int, topic string, question string, must_any array<string>, prefer_any array<string>, max_answer_chars int"
SEEDS = [
    (0, "one", "What is the first thing?", ["the", "and"], ["tion", "with"], 900),
    (1, "two", "Qué es esto?", ["ción", "mente"], ["que", "las"], 900),
    (2, "none", "Is it here?", ["zzzzz"], ["the"], 900),
    (3, "three", "Und was?", ["chber", "keit"], ["nicht"], 300),
]

GOLD_COLUMNS = "id, question, category, answer, expected_substring, expected_answer, expected_source_url, primary_url"
GOLD_SCHEMA = "id string, question string, category string, answer string, expected_substring string, expected_answer string, expected_source_url string, primary_url string"
GOLD = [
    ("g1", "When?", "deadline", "The last day is 12/2.", "12/2", None, None, "https://uni.example.com/a/"),
    ("g2", "What?", "policy", "Pass  Fail\tgrading applies to all", "pass fail", "pass fail grading applies", "/a/", "https://uni.example.com/a/"),
    ("g3", "Who?", "policy", "", "nobody", None, "/b/", "https://uni.example.com/a/"),
    ("g4", "Where?", "advising", "Ask the office", "office", "Ask the office", None, None),
    ("g5", "Why?", "policy", "no idea", "because", None, None, "x"),
]

INTENT_QUERIES = [
    (1, "What is the course withdrawal deadline?"), (2, "Last Day to Withdraw Classes for Winter 2025"), (3, "What is the semester end date of Winter 2026?"),
    (4, "Required Courses for MS in Computer Science"), (5, "How do I contact advising?"), (6, "How does pass/fail work?"), (7, "Fall 2025 final day and Spring  2026 final day"),
    (8, "hello"), (9, "How many credits to complete my graduate degree?"), (10, "Leave of absence rules"), (11, "who is my advisor"), (12, ""),
]

CANDIDATE_SCHEMA = "qid int, query string, chunk_id int, embed_score double, bm25 double, url string, text string, section_heading string, meta struct<bucket:string,term:string,is_table:boolean,has_deadline_words:boolean>"


def candidates() -> list[tuple]:
    """Candidates of the intent questions: each beside texts, headings, buckets and terms that rules look at."""
    parts = [
        ("https://uni.example.com/registrar/add-drop/", "final day to wd 12/2 withdraw calendar", "Fall 2025 Add / Drop / Withdrawal & Adjustment Calendar", "registrar", "Fall 2025", True, True),
        ("https://uni.example.com/registrar/add-drop/", "final day to withdraw 4/2 | full |", "Winter 2026 table", "registrar", "Winter 2026", True, True),
        ("https://uni.example.com/academics/academic-calendar/", "academic calendar: last day of classes", "Academic Calendar", "academics-programs", "", False, False),
        ("https://uni.example.com/academics/academic-calendar-2025/", "academic calendar 2025 software", "Winter 2025", "academics-programs", "Winter 2025", False, True),
        ("https://uni.example.com/policies/all-policies/pass-fail-grading/", "About this policy pass/fail", "About this policy", "policies", None, False, False),
        ("https://uni.example.com/programs/computer-science-ms/#requirementstext", "Required courses (M.S.) course list program requirements", "Required Courses", "catalog-programs", "", False, False),
        ("https://uni.example.com/programs/computer-science-ms/", "print this page (B.S.) cybersecurity", "Overview", "catalog-programs", "", False, False),
        ("https://uni.example.com/school-of-computing/people/", "your advisor and graduate programs research areas", "Advisors", "soc", "", False, False),
        ("", "waitlist ends soon, withdraw", "Table 3", "registrar", "Spring 2026", True, None),
        ("https://uni.example.com/global/leave-of-absence/", "application deadline for all", "Withdrawal or Leave of Absence from the University", "oge", "", False, False),
        ("https://uni.example.com/a/undergraduate-graduate-degree-requirements/undergraduate-graduate-degree-requirements.pdf", "degree credits", "Degree", "catalog-programs", "", False, False),
        (None, None, None, None, None, None, None),
    ]
    return [(q, text, i, ((i * 7 + q * 3) % 10) / 10, ((i * 5 + q) % 4) / 4, u, t, s, (b, term, tab, words)) for q, text in INTENT_QUERIES for i, (u, t, s, b, term, tab, words) in enumerate(parts)]


URL_ROWS = [
    ("https://Uni.Example.com/Policies/Grading", "2025-01-01", "discovered", 0), ("https://uni.example.com/Policies/Grading/?utm_source=x#top", "", "sitemap", 0), ("http://catalog.example.com/programs/cs.pdf", "", "manual", 0),
    ("https://uni.example.com/policies/draft/grading", "", "sitemap", 1), ("https://other.org/x", "", "sitemap", 2), ("https://uni.example.com/img/a.png", "", "sitemap", 3), ("https://uni.example.com/registrar", "2024", "sitemap", 4),
    ("https://uni.example.com/registrar/", "", "manual", 1), ("https://uni.example.com", "", "manual", 2), ("relative/path", "", "manual", 3), ("https://uni.example.com/registrar/2024/05/news", "", "discovered", 1),
]

SITEMAPS = [
    ("https://uni.example.com/sitemap_index.xml", "<sitemapindex><sitemap><loc>https://uni.example.com/pages.xml</loc></sitemap><sitemap><loc> https://uni.example.com/users.xml </loc></sitemap><sitemap><loc>https://uni.example.com/taxonomies-1.xml</loc></sitemap></sitemapindex>"),
    ("https://uni.example.com/pages.xml", "<urlset><url><loc>https://uni.example.com/a?x=1&amp;y=2</loc><lastmod>2025-01-02</lastmod></url>\n<url><loc><![CDATA[https://uni.example.com/b/]]></loc></url></urlset>"),
    ("https://uni.example.com/broken.xml", "not xml"),
]

DEADLINE_TEXTS = [
    (1, "| Part of Term | Final Day to WD | X |\n| --- | --- | --- |\n| Session A | 10/1 | y |\n| Full Term | 12/2/2025 by noon | z |"),
    (2, "| Term | Final Day to Withdraw |\n| --- | --- |\n| Full | 4/2 |"),
    (3, "| Term | Other |\n| --- | --- |\n| Full | 4/2 |"),
    (4, "| Term | Final Day to Withdraw |\n| --- | --- |\n| Session B | 4/2 |"),
    (5, "| Term | Final Day to Withdraw |\n| --- | --- |\n| Full Term | tba |"),
    (6, ""),
]

COURSE_DOCS = [("u1", "Intro\n**CSIT 104 Computational Concepts (3 credits)**\nLearn things.\n\nMore.\n**CSIT 515   Software  Engineering (4 credits)**\n**CSIT 999 Seminar (1 credit)**\nlast"), ("u2", "nothing here")]

TEXTS = [
    (1, "  Line-\nbreak here\r\n\n\n\nnext   \n  end  "), (2, "Welcome\nUniversity Catalog\nProgram Requirements\nCSIT 515\nSoftware Engineering\n3\nProgram Requirements\nsame\nsame\n\nCourse List Code Title Credits"),
    (3, ""), (4, "café au-\nlait x\n\n\n\ny"), (5, "One. Two! Fall 2025 and spring  2026, FALL 2025; winter 2019 | a | b |"),
]
