"""Résumés: text of documents, and the evidence that rules find in it.

Names and places come from rules on the text; a recogniser of entities can be passed
in as a column function.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contact import PHONES, extract_emails, extract_phones
from ..functions.text import strip
from ..schema import CONFIDENCE, EDUCATION, EXPERIENCE, LINKS, LOCATION, PROFILE_ORDER, item, items, rows_of

#: fixed values: skills that are looked for, in this order
SKILLS = (
    "python", "c++", "c", "java", "react", "javascript", "js", "typescript", "ts", "machine learning", "pytorch", "tensorflow",
    "sql", "aws", "docker", "kubernetes", "html", "css", "git", "api", "rest", "linux", "agile", "fastapi", "flask", "gemini",
    "langchain", "langgraph", "agentic ai", "multi-agent", "deep learning", "nlp",
)
#: fixed values: headers that begin a section
SECTIONS = {
    "skills": ("technical skills", "skills"),
    "experience": ("work experience", "professional experience", "experience"),
    "education": ("academic history", "education"),
    "projects": ("projects",),
    "achievements": ("achievements", "awards"),
    "certifications": ("certifications", "licenses"),
}
#: fixed values: words that mark a place of study, and the form of date ranges
STUDY = ("college", "university", "school", "matric", "hsc")
DATE_RANGE = (
    r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|June|July|August|September|"
    r"October|November|December)\b.*\b(?:Present|20\d{2})\b"
)
#: fixed values: a place before a postal code, what parts a line, and the title of work that names none
PLACE = r"([A-Za-z\s]+),\s*([A-Za-z\s]+)\s*-\s*\d{6}"
DASHES = r"[-–|]"
DEFAULT_TITLE = "Software Engineer"


def docx_text(content: bytes | None) -> str:
    """Text runs of a DOCX file, a line each; empty if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as parts:
            root = ElementTree.fromstring(parts.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "\n".join(e.text for e in root.iter() if e.tag.endswith("}t") and e.text)


def pdf_text(content: bytes | None) -> str:
    """Text of a PDF file, if a PDF reader is installed."""
    for reader in ("pdfplumber", "pypdf"):
        try:
            if reader == "pdfplumber":
                import pdfplumber

                with pdfplumber.open(io.BytesIO(content or b"")) as pdf:
                    pages = [p.extract_text() or "" for p in pdf.pages]
            else:
                from pypdf import PdfReader

                pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content or b"")).pages]
        except Exception:  # an optional reader that is absent or gives up: the next one is tried
            continue
        if text := "".join(f"{p}\n" for p in pages if p):
            return text
    return ""


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """resume_path, resume_ord (place in ``paths``), kind and text of PDF, DOCX and plain-text files."""
    paths = [p.strip() for p in paths.split(",")] if isinstance(paths, str) else list(paths)
    parts = [spark.read.format("binaryFile").load(p).select("path", "content", F.lit(i).alias("resume_ord")) for i, p in enumerate(paths)]
    files = reduce(DataFrame.unionByName, parts)

    @F.pandas_udf("string")
    def text_of(names: pd.Series, contents: pd.Series) -> pd.Series:
        def one(name: str, content: bytes) -> str:
            if name.lower().endswith(".docx"):
                return docx_text(content)
            return pdf_text(content) if name.lower().endswith(".pdf") else content.decode("utf-8", "replace")

        return pd.Series([one(n, c) for n, c in zip(names, contents)])

    kind = F.when(F.lower("path").endswith(".docx"), "Resume_DOCX").otherwise("Resume_PDF")
    return files.select(F.col("path").alias("resume_path"), "resume_ord", kind.alias("kind"), text_of("path", "content").alias("text"))


def respace(text: Column) -> Column:
    """Rejoin letters of a text that was extracted with spaces between them.

    Applies where over 70 % of the words are single characters: runs of two or more
    spaces part words, other spaces go.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    singles = F.filter(words, lambda w: F.length(w) == 1)
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, " {2,}", "\u0001"), " ", ""), "\u0001", " ")
    return F.when(F.size(singles) > 0.7 * F.size(words), strip(F.regexp_replace(marked, r"\s+", " "))).otherwise(text)


_HEADER = re.compile(
    r"(?<!\w)(" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for ws in SECTIONS.values() for w in ws) + r")(?!\w)", re.I
)
_LABEL = {w: label for label, words in SECTIONS.items() for w in words}


def sections_of(text: str) -> dict[str, str]:
    """Text before the first header word, and after each; the last of a label counts.

    A header of two words counts as one; the text of its section follows it.
    """
    found = list(_HEADER.finditer(text))
    parts = {"header": text[: found[0].start()] if found else text}
    for here, after in zip(found, [*found[1:], None]):
        label = _LABEL[" ".join(here[1].lower().split())]
        parts[label] = text[here.end() : after.start() if after else len(text)].strip(" ")
    return parts


def segment(text: Column) -> Column:
    """``map<string, string>`` of a résumé's sections."""

    @F.pandas_udf("map<string, string>")
    def sections(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else sections_of(t) for t in texts])

    return sections(text)


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find_skills(text: Column, skills: tuple[str, ...] = SKILLS) -> Column:
    """Those of ``skills`` that stand in a text as whole words, in their order.

    The text is searched once: at every word the longest skill that begins there is
    taken, and with it the skills that are whole words at its start.
    """
    pattern = rf"\b(?=({'|'.join(_escaped(s) for s in sorted(skills, key=len, reverse=True))})\b)"
    taken = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))
    begins = {s: [t for t in skills if re.match(rf"{re.escape(s)}\b", t)] for s in skills}
    meant = [F.struct(F.lit(s).alias("skill"), F.array(*map(F.lit, sorted({s, *begins[s]}))).alias("shown_by")) for s in skills]

    def hits(words: Column) -> Column:
        return F.transform(F.filter(F.array(*meant), lambda m: F.arrays_overlap(m["shown_by"], words)), lambda m: m["skill"])

    # the text is not searched again for every skill
    return F.when(text.isNotNull(), _bound(taken, hits))


def _escaped(word: str) -> str:
    return re.sub(r"([+.*?()\[\]{}|^$\\])", r"\\\1", word)


def experience_blocks(text: Column) -> Column:
    """Experience items: the first line and each with a date range begin a block, which lasts to the next."""

    def block(lines: Column) -> Column:
        first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
        parts = F.split(first, DASHES)
        dated = F.when(first.rlike(DATE_RANGE), first).when(second.rlike(DATE_RANGE), second)
        dates = F.split(F.regexp_extract(dated, DATE_RANGE, 0), r"[-–]")
        return F.struct(
            strip(parts[0]).alias("company"),
            F.coalesce(strip(F.get(parts, F.lit(1))), F.lit(DEFAULT_TITLE)).alias("title"),
            strip(F.get(dates, F.lit(0))).alias("start"),
            strip(F.get(dates, F.lit(1))).alias("end"),
            F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n").alias("summary"),
        ).cast(EXPERIENCE)

    def blocks(lines: Column) -> Column:
        marked = F.transform(lines, lambda line, i: F.when((i == 0) | line.rlike(DATE_RANGE), i))
        return _bound(
            F.filter(marked, lambda i: i.isNotNull()),
            lambda starts: F.transform(
                starts, lambda a, j: block(F.slice(lines, a + 1, F.coalesce(F.get(starts, j + 1), F.size(lines)) - a))
            ),
        )

    return _bound(lines_of(text), blocks)


def education_lines(text: Column) -> Column:
    named = F.filter(lines_of(text), lambda line: F.lower(line).rlike("|".join(STUDY)))

    def study(line: Column) -> Column:
        parts = F.split(line, DASHES)
        nothing = F.lit(None).cast("string")
        return F.struct(
            strip(parts[0]).alias("institution"), strip(F.get(parts, F.lit(1))).alias("degree"), nothing.alias("field"), nothing.alias("end_year")
        ).cast(EDUCATION)

    return F.transform(named, study)


def find_links(text: Column) -> Column:
    tokens = F.filter(F.split(text, r"[\s|]+"), lambda t: t != "")

    def first(site: str, *before: str) -> Column:
        def of(t: Column) -> Column:
            hit = F.contains(F.lower(t), F.lit(site))
            for b in before:
                hit &= ~F.contains(F.lower(t), F.lit(b))
            return hit

        return F.get(F.filter(tokens, of), F.lit(0))

    links = F.struct(
        first("linkedin.com").alias("linkedin"),
        first("github.com", "linkedin.com").alias("github"),
        first("leetcode.com", "linkedin.com", "github.com").alias("portfolio"),
        F.array().alias("other"),
    ).cast(LINKS)
    return F.when(text.rlike(r"(?i)linkedin\.com|github\.com|leetcode\.com"), links)


def find_place(text: Column) -> Column:
    city, region = strip(F.regexp_extract(text, PLACE, 1)), strip(F.regexp_extract(text, PLACE, 2))
    place = F.struct(city.alias("city"), region.alias("region"), F.lit(None).cast("string").alias("country")).cast(LOCATION)
    # the short pattern is cheap and rules most texts out
    return F.when(text.rlike(r"-\s*\d{6}"), F.when(text.rlike(PLACE), place))


def headline_of(header: Column) -> Column:
    """First header line after the name that is no contact line."""
    lines = lines_of(header)
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    plain = F.filter(rest, lambda x: ~F.contains(x, F.lit("@")) & ~F.contains(x, F.lit("com")) & ~x.rlike(PHONES))
    return F.get(plain, F.lit(0))


Hook = Callable[[Column], Column]


def parse(resumes: DataFrame, name_hook: Hook | None = None, place_hook: Hook | None = None) -> DataFrame:
    """``resumes`` (resume_path, kind, text) with what the rules find, texts without content gone.

    Hooks take the header or the text and give a name or a ``LOCATION``; where they
    give null the rules decide.
    """
    clean = resumes.filter(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("text", respace(F.col("text")))
    cut = clean.withColumn("sections", segment(F.col("text")))
    header = F.coalesce(F.try_element_at("sections", F.lit("header")), F.lit(""))
    name, place = F.get(lines_of(header), F.lit(0)), find_place(F.col("text"))
    if name_hook:
        name = F.coalesce(name_hook(header), name)
    if place_hook:
        place = F.coalesce(place_hook(F.col("text")), place)
    return cut.select(
        *(F.col(c) for c in resumes.columns if c != "text"),
        "text",
        name.alias("name"),
        F.coalesce(extract_emails(F.col("text")), F.array().cast("array<string>")).alias("emails"),
        F.transform(extract_phones(F.col("text")), strip).alias("phones"),
        find_links(F.col("text")).alias("links"),
        headline_of(header).alias("headline"),
        place.alias("location"),
        find_skills(F.col("text")).alias("skills"),
        experience_blocks(F.try_element_at("sections", F.lit("experience"))).alias("experience"),
        education_lines(F.try_element_at("sections", F.lit("education"))).alias("education"),
    )


def evidence(parsed: DataFrame) -> DataFrame:
    """From parsed résumés with a ``candidate_id``."""
    singles = F.array(
        item("full_name", F.col("name")),
        item("links", F.col("links")),
        item("headline", F.col("headline")),
        item("location", F.col("location")),
    )
    found = F.concat(singles, *(items(f, F.col(f)) for f in ("emails", "phones", "skills", "experience", "education")))
    return rows_of(
        parsed,
        found,
        source=F.concat("kind", F.lit(":"), "resume_path"),
        method=F.lit("spaCy_NLP_Extraction"),
        confidence=F.lit(CONFIDENCE["resume"]),
        profile_ord=F.lit(PROFILE_ORDER["resume"]),
    )
