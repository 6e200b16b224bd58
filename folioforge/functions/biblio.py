"""Bibliographic expressions: dates of varying precision, publishers, sources of papers, front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import squeeze, strip

#: How much of a text's head and tail is searched.
HEAD, TAIL = 80_000, 40_000
#: Where dates and publishers stand, in order of trust.
DATE_PATTERNS = (
    r"(?:발행일|출판일|간행일|발행)\s*[:：]?\s*((?:18|19|20)[0-9]{2}[./년 \-]?\s*[0-9]{0,2}[./월 \-]?\s*[0-9]{0,2})",
    r"(?i)(?:Published|Publication date|Date published)\s*[:：]?\s*((?:18|19|20)[0-9]{2}(?:[\-/.][0-9]{1,2})?(?:[\-/.][0-9]{1,2})?)",
    r"(?i)(?:Copyright|©|\(c\))\s*((?:18|19|20)[0-9]{2})",
)
PUBLISHER_PATTERNS = (
    r"(?:출판사|발행처|발행자|펴낸곳|펴낸 곳|출판)\s*[:：]\s*([^\n\r]{2,80})",
    r"(?i)(?:Publisher|Published by)\s*[:：]\s*([^\n\r]{2,100})",
)
PUBLISHER_STOP = r"(?i)(?:ISBN|ISSN|DOI|전화|팩스|주소|등록|인쇄|발행일|출판일|copyright|©|http|www\.)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def clean_date(raw: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` as far as the text goes; empty without a year."""
    t = F.regexp_replace(strip(raw), r"\s+", "")
    pattern = r"^((?:18|19|20)[0-9]{2})(?:[./년\-]?([0-9]{1,2}))?(?:[./월\-]?([0-9]{1,2}))?"
    y, m, d = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    two = lambda c: F.lpad(c, 2, "0")
    return F.when((m != "") & (d != ""), F.concat_ws("-", y, two(m), two(d))).when(m != "", F.concat_ws("-", y, two(m))).otherwise(y)


def published(text: Column) -> Column:
    sample = F.concat(F.substring(text, 1, HEAD), F.lit("\n"), F.right(text, F.lit(TAIL)))
    return F.coalesce(clean_date(F.coalesce(*[_found(sample, p) for p in DATE_PATTERNS])), F.lit(""))


def clean_publisher(raw: Column) -> Column:
    edge = "^[ \t|,.;·ㆍ\\-]+|[ \t|,.;·ㆍ\\-]+$"
    t = F.regexp_replace(F.regexp_replace(raw, edge, ""), r"\s+", " ")
    t = F.regexp_replace(F.split(t, PUBLISHER_STOP, 2)[0], edge, "")
    return F.when((F.length(t) >= 2) & (F.length(t) <= 80) & ~t.rlike("^[0-9]+$"), t).otherwise(F.lit(""))


def publisher(text: Column) -> Column:
    sample = F.concat(F.substring(text, 1, HEAD), F.lit("\n"), F.right(text, F.lit(TAIL)))
    return F.coalesce(*[F.nullif(clean_publisher(_found(sample, p)), F.lit("")) for p in PUBLISHER_PATTERNS], F.lit(""))


def date_from_name(name: Column) -> Column:
    """A date in a file name: of an arXiv number, then a compact year and month, then a leading year."""
    arxiv = _found(name, r"\b([12][0-9](?:0[1-9]|1[0-2]))\.[0-9]{4,5}\b")
    compact = _found(name, r"\b((?:19|20)[0-9]{2}(?:0[1-9]|1[0-2]))\b")
    leading = _found(name, r"^[^0-9]*((?:19|20)[0-9]{2})(?:[^0-9]|$)")
    return F.coalesce(
        F.concat(F.lit("20"), F.substring(arxiv, 1, 2), F.lit("-"), F.substring(arxiv, 3, 2)),
        F.concat(F.substring(compact, 1, 4), F.lit("-"), F.substring(compact, 5, 2)), leading, F.lit(""),
    )


def pdf_date(raw: Column) -> Column:
    """ISO date of a PDF or Poppler date; the year where the day is impossible; empty without one."""
    v = strip(raw)
    y, m, d = (F.regexp_extract(v, r"D:([0-9]{4})([0-9]{2})?([0-9]{2})?", i) for i in (1, 2, 3))
    packed = F.concat_ws("-", y, F.when(m == "", "01").otherwise(m), F.when(d == "", "01").otherwise(d))
    stamp = F.left(v, F.lit(24))
    named = F.regexp_extract(stamp, r"^(?:[A-Za-z]{3} )?([A-Za-z]{3} +[0-9]{1,2}) (?:[0-9:]{8} )?([0-9]{4})$", 1)
    year = F.regexp_extract(stamp, r"([0-9]{4})$", 1)
    iso = _found(stamp, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$")
    return F.coalesce(
        F.when(y != "", F.coalesce(F.date_format(F.try_to_date(packed, "yyyy-MM-dd"), "yyyy-MM-dd"), y)),
        F.when(named != "", F.date_format(F.try_to_date(F.concat_ws(" ", F.regexp_replace(named, " +", " "), year), "MMM d yyyy"), "yyyy-MM-dd")),
        F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"), _found(v, r"\b((?:18|19|20)[0-9]{2})\b"), F.lit(""),
    )


def safe_stem(source: Column) -> Column:
    """A file stem of a source: at most 90 characters, ``paper`` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(strip(source), "(?i)^https?://", ""), r"[^0-9A-Za-z가-힣._\-]+", "_")
    s = F.substring(F.regexp_replace(s, r"^[._\-]+|[._\-]+$", ""), 1, 90)
    return F.when(s == "", F.lit("paper")).otherwise(s)


def arxiv_id(source: Column) -> Column:
    """The arXiv number of a source. A DOI isn't searched: its digits may look like one."""
    plain = ~F.lower(strip(source)).rlike(r"^(?:doi:|10\.|https?://(?:dx\.)?doi\.org/)")
    return F.when(plain, _found(source, r"(?i)(?:arxiv\.org/(?:abs|pdf)/)?([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?"))


def doi(source: Column) -> Column:
    s = strip(source)
    return F.when(F.lower(s).startswith("doi:"), strip(F.substring(s, F.lit(5), F.length(s)))).when(s.rlike(r"^10\..*/"), s).when(F.lower(s).contains("doi.org/"), strip(F.regexp_extract(s, "(?i)doi\\.org/(.*)$", 1)))


def source_candidates(source: Column) -> Column:
    """Addresses to try for a paper, in order and without repeats."""
    s = strip(source)
    arxiv = F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id(source))
    url = F.when(F.lower(s).rlike("^https?://"), s)
    by_doi = F.when(F.lower(s).startswith("doi:") | s.rlike(r"^10\..*/"), F.concat(F.lit("https://doi.org/"), doi(source)))
    return F.array_distinct(F.array_compact(F.array(arxiv, url, by_doi)))


def response_filename(disposition: Column, url: Column, stem: Column, suffix: str) -> Column:
    named = _found(disposition, r"(?i)filename\*?=(?:UTF-8'')?\"?([^\";]+)")
    base = F.nullif(F.element_at(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), -1), F.lit(""))
    name = F.coalesce(strip(F.try_url_decode(named)), base, F.concat(stem, F.lit(suffix)))
    name = F.when(name.rlike(r"[^.]\.[^.\s/]+$"), name).otherwise(F.concat(name, F.lit(suffix)))
    return F.regexp_replace(name, r'[/\\:*?"<>|]', "_")


def pdf_link(html: Column) -> Column:
    """The PDF address a page names in its meta data or links to, as written."""
    patterns = (
        r"""(?i)<meta[^>]+name=["']citation_pdf_url["'][^>]+content=["']([^"']+)["']""",
        r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']citation_pdf_url["']""",
        r"""(?i)href=["']([^"']+\.pdf(?:\?[^"']*)?)["']""",
    )
    return F.replace(F.coalesce(*[_found(html, p) for p in patterns]), F.lit("&amp;"), F.lit("&"))


def upload_token(name: Column, content: Column) -> Column:
    return F.concat_ws(":", name, F.length(content).cast("string"), F.substring(F.sha1(content), 1, 12))


def crossref_metadata(payload: Column) -> Column:
    """(title, author, published_date, publisher) of a CrossRef answer; print, online and issue dates in this order."""
    dates = "struct<`date-parts`: array<array<int>>>"
    m = F.from_json(payload, f"message struct<title: array<string>, author: array<struct<given: string, family: string>>, `published-print`: {dates}, `published-online`: {dates}, issued: {dates}, publisher: string>")["message"]
    parts = F.get(F.coalesce(*[m[k]["date-parts"] for k in ("published-print", "published-online", "issued")]), F.lit(0))
    shown = F.transform(parts, lambda p, i: F.when(i == 0, p.cast("string")).otherwise(F.lpad(p.cast("string"), 2, "0")))
    names = F.filter(F.transform(m["author"], lambda a: F.concat_ws(" ", a["given"], a["family"])), lambda n: n != "")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(blank(squeeze(F.get(m["title"], F.lit(0)))).alias("title"), blank(F.array_join(names, ", ")).alias("author"), blank(F.array_join(shown, "-")).alias("published_date"), blank(strip(m["publisher"])).alias("publisher"))


def arxiv_metadata(payload: Column) -> Column:
    """The same of an arXiv Atom entry."""
    at = lambda p: F.xpath_string(payload, F.lit(p))
    names = F.filter(F.transform(F.xpath(payload, F.lit("//*[local-name()='entry'][1]/*[local-name()='author']/*[local-name()='name']/text()")), strip), lambda n: n != "")
    return F.struct(squeeze(at("//*[local-name()='entry'][1]/*[local-name()='title']")).alias("title"), F.array_join(names, ", ").alias("author"), F.left(at("//*[local-name()='entry'][1]/*[local-name()='published']"), F.lit(10)).alias("published_date"), F.lit("arXiv").alias("publisher"))


def frontmatter(text: Column) -> Column:
    """(fm, body): the lines between the rules at the top, and the rest; null without front matter."""
    end = F.locate("\n---", text, 4)
    has = text.startswith("---") & (end > 0)
    return F.when(has, F.struct(F.regexp_replace(F.substring(text, F.lit(4), end - 4), "^\n+|\n+$", "").alias("fm"), F.regexp_replace(F.substring(text, end + 4, F.length(text)), "^\n+", "").alias("body")))


def frontmatter_value(fm: Column, key: str) -> Column:
    """Value of the first line of a key, without quotes; empty if there is none."""
    return F.regexp_replace(strip(F.regexp_extract(fm, rf"(?md)^{key}:(.*)$", 1)), '^"+|"+$', "")


#: Keys that a backfill writes, and the keys behind which, or else before which, new ones go.
META_KEYS = ("published", "publisher", "source_created", "source_modified")
AFTER, BEFORE = ("source", "book", "summary", "tags"), ("model", "generated", "mode", "author", "refined")


def upsert_frontmatter(fm: Column, rendered: Column) -> Column:
    """Front matter with the lines ``rendered`` (``key: value``) set: in place where a key stands, the others together at one point.

    That point is behind the first key of ``AFTER``, else before the first of ``BEFORE``, else
    the end. Null and empty front matter has no lines.
    """
    key = lambda line: F.when(line.contains(":"), F.trim(F.substring_index(line, ":", 1))).otherwise(F.lit(""))
    lines = F.when(F.coalesce(fm, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(fm, "\n"))
    values = F.filter(F.split(F.coalesce(rendered, F.lit("")), "\n"), lambda v: v != "")
    keys = F.transform(lines, key)
    first = lambda k, i: F.array_position(keys, k) == i + 1
    kept = F.transform(lines, lambda x, i: F.coalesce(F.when(first(key(x), i), F.get(F.filter(values, lambda v: key(v) == key(x)), F.lit(0))), x))
    new = F.filter(values, lambda v: key(v).isin(*META_KEYS) & ~F.array_contains(keys, key(v)))
    behind, before = (F.array_position(F.transform(keys, lambda k: k.isin(*names)), F.lit(True)) for names in (AFTER, BEFORE))  # noqa: B023
    at = F.when(behind > 0, behind).when(before > 0, before - 1).otherwise(F.size(lines)).cast("int")
    return F.array_join(F.concat(F.slice(kept, F.lit(1), at), new, F.slice(kept, at + 1, F.size(lines))), "\n")


def summary_parts(text: Column) -> Column:
    """(summary, body) of a summary file, hand-edited ones included: without the summary's line all is body."""
    t = F.coalesce(frontmatter(text)["body"], text)
    line = r"(?md)^\s*> \*\*요약:\*\*(.*)$"
    has = t.rlike(line)
    after = F.regexp_replace(t, r"(?sd)^.*?(?:^|\n)[ \t]*> \*\*요약:\*\*[^\n]*(?:\n|$)", "")
    return F.struct(F.when(has, strip(F.regexp_extract(t, line, 1))).otherwise(F.lit("")).alias("summary"), strip(F.when(has, after).otherwise(t)).alias("body"))


def paper_metadata(source: Column, arxiv: Column, crossref: Column) -> Column:
    """The answer that counts for a source, of two structs of the same fields: arXiv's where the source has its number and it gave one, then CrossRef's where the source has a DOI; null else."""
    return F.coalesce(F.when(arxiv_id(source).isNotNull(), arxiv), F.when(doi(source).isNotNull(), crossref))


def sidecar_json(meta: Column) -> Column:
    """A paper's metadata as the JSON beside its file; null where there is none."""
    return F.when(meta.isNotNull(), F.to_json(meta))
