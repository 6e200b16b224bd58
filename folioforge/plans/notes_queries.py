"""Queries of notes, model answers and streams over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import biblio as B
from folioforge.functions import python as P
from folioforge.functions import text as T
from folioforge.operators import notes as N
from folioforge.operators.model import lenient_json_column
from folioforge.plans import sqltext as S
from folioforge.plans.text_queries import AUTHOR, _filename
from folioforge.session import shared_folder, table
from folioforge.streaming import stages as R


def _notes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "wiki_notes").select("note_id", "chapter_id", "stem", "chapter", "author", "summary", "body", "model", "generated_on", "category").distinct()
    return n.fillna("", ["stem", "chapter", "author", "summary", "body", "model", "generated_on", "category"])


def chapter_notes(spark: SparkSession, d: str) -> DataFrame:
    """A note a chapter note, with links to its neighbours in the book."""
    n = N.neighbours(_notes(spark, d), "stem", "note_id", "chapter")
    note = N.chapter_note(F.col("stem"), F.col("chapter"), F.col("summary"), F.col("body"), F.col("prev_title"), F.col("next_title"), F.col("model"), F.col("generated_on"))
    return n.select("note_id", F.md5(note).alias("note"))


def _sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _notes(spark, d).filter("stem <> ''")
    s = n.select("stem", F.col("note_id").alias("no"), F.col("chapter").alias("title"), "summary", "body", (F.col("note_id") % 3 == 0).alias("noted"))
    blank = F.lit("")
    o = n.groupBy("stem").agg(F.max("category").alias("category"), F.max("model").alias("model"), F.max("generated_on").alias("day")).select(
        "stem", "category", T.author_from_stem(F.col("stem")).alias("author"), F.concat(F.lit("About "), "stem").alias("intro"), F.lit("In short.").alias("summary"), F.lit("2020-03").alias("published"), blank.alias("publisher"), "model", "day"
    )
    return s, o


def hub_notes(spark: SparkSession, d: str) -> DataFrame:
    s, o = _sections(spark, d)
    return N.hub_notes(s, o, "stem").select("stem", F.md5("note").alias("note"))


def inline_notes(spark: SparkSession, d: str) -> DataFrame:
    """Books in one note, and the same notes with a block of links that is then replaced."""
    s, o = _sections(spark, d)
    target = F.concat_ws("/", "stem", F.concat(N.two_digits(F.col("no")), F.lit("_"), "title"))
    parts = s.groupBy("stem").agg(N.inline_parts(F.col("no"), F.col("title"), F.col("body")).alias("parts"), N.links_block(F.col("no"), F.col("title"), F.col("summary"), target).alias("links"))
    j = parts.join(o.withColumnRenamed("summary", "short"), "stem")
    note = N.inline_note(F.col("stem"), F.col("category"), F.col("short"), F.col("intro"), N.front_lines(published=F.col("published"), publisher=F.col("publisher")), F.col("parts"), F.col("model"), F.col("day"))
    j = j.withColumn("note", note)
    once = N.put_links(F.col("note"), F.col("links"))
    return j.select("stem", F.md5("note").alias("note"), F.md5(once).alias("linked"), F.md5(N.put_links(once, F.concat(F.lit(N.LINKS_HEADER), F.lit("\n\nnone\n")))).alias("replaced"))


def note_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of notes by kind, as documents are made of them."""
    return N.markdown_blocks(_notes(spark, d), "note_id", "body").groupBy("note_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("heading", "table", "quote", "tags", "bullet", "paragraph")], F.max("level").cast("long").alias("deepest"))


def rebuilt_citations(spark: SparkSession, d: str) -> DataFrame:
    """Notes with a table of quotations, one real and one invented, held against the chapter."""
    c = table(spark, d, "chapters").select("chapter_id", "body").distinct().filter("body is not null")
    real = F.regexp_replace(F.substring("body", 30, 50), r"[\n|]", " ")
    md = F.concat(F.lit("## 핵심 요약\n\nx\n\n## 핵심 인용\n\n| 주제 | 인용 |\n|---|---|\n| a | "), real, F.lit(" |\n| b | an invented sentence that is long |\n\n## 관련 개념\n- y"))
    r = N.rebuild_citations(md, F.col("body"), F.lit(4))
    return c.select("chapter_id", r["n_kept"].cast("long").alias("n_kept"), F.md5(F.regexp_replace(r["body"], r"\| a \| [^\n]*\n", "")).alias("body"))


def backfilled(spark: SparkSession, d: str) -> DataFrame:
    """Front matter of notes with dates and publishers set from the sidecar where they are blank, and how many of each outcome."""
    n = _notes(spark, d)
    side = table(spark, d, "papermeta").groupBy("stem").agg(F.min(F.nullif(T.strip(F.col("published_date")), F.lit(""))).alias("day"), F.min(F.nullif(T.strip(F.col("publisher")), F.lit(""))).alias("house"))
    fm = F.concat(F.lit("title: "), "chapter", F.lit("\nsource: "), "stem", F.lit("\nmodel: "), "model")
    j = n.join(side, "stem", "left").withColumn("lines", N.front_lines(published=F.col("day"), publisher=F.col("house")))
    return j.select("note_id", F.when(F.col("lines") == "", "nothing").otherwise("filled").alias("outcome"), F.md5(B.upsert_frontmatter(fm, F.col("lines"))).alias("fm"))


def model_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers that should be JSON and carry prose or fences, read leniently."""
    n = _notes(spark, d).select("note_id", "summary")
    plain = F.to_json(F.struct("summary"))
    raw = F.when(F.col("note_id") % 3 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(F.col("note_id") % 3 == 1, F.concat(F.lit("Here: "), plain, F.lit(" done"))).otherwise(plain)
    return n.select("note_id", F.md5(lenient_json_column(raw, "summary string")["summary"]).alias("summary"))


def nfc_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in composed form, from a decomposed one, and titles in capitals as title case."""
    f = table(spark, d, "txt_files").select("file_id", "stem").distinct()
    title = F.regexp_replace("stem", "_[^_]*$", "")
    return f.select("file_id", F.md5(P.nfc(P.nfd("stem"))).alias("name"), P.english_title(F.upper(title)).alias("title"))


def stem_likeness(spark: SparkSession, d: str) -> DataFrame:
    """How alike each file's stem is to its title."""
    f = table(spark, d, "txt_files").select("file_id", "stem").distinct()
    return f.select("file_id", F.round(P.seq_ratio(F.col("stem"), F.regexp_replace("stem", "_[^_]*$", "")), 6).alias("ratio"))


def backfill_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many notes have each outcome."""
    return backfilled(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


def paper_pages(spark: SparkSession, d: str) -> DataFrame:
    """PDF links in pages of papers, made absolute, and the file each answer would get."""
    p = table(spark, d, "papermeta").select("paper_id").distinct()
    n = F.col("paper_id").cast("string")
    html = F.when(F.col("paper_id") % 3 == 0, F.concat(F.lit('<meta name="citation_pdf_url" content="/pdf/'), n, F.lit('.pdf?a=1&amp;b=2">'))).when(F.col("paper_id") % 3 == 1, F.concat(F.lit('<a href="x/'), n, F.lit('.pdf">'))).otherwise("<p>none</p>")
    link = P.absolute_url(F.lit("https://example.org/p/q.html"), B.pdf_link(html))
    name = B.response_filename(F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit("attachment; filename*=UTF-8''a%20b"), n, F.lit(".pdf"))).otherwise(""), F.concat(F.lit("https://example.org/d/"), n), n, ".pdf")
    return p.select("paper_id", F.coalesce(link, F.lit("")).alias("link"), name.alias("file"))


def paper_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Sidecars written as service answers and read back, in the order of trust."""
    p = table(spark, d, "papermeta").select("paper_id", "title", "published_date", "publisher").distinct().fillna("")
    date = F.transform(F.filter(F.split(T.strip(F.col("published_date")), "-"), lambda x: x != ""), lambda x: x.cast("int"))
    msg = F.to_json(F.struct(F.struct(F.array("title").alias("title"), F.array(F.struct(F.lit("A").alias("given"), F.lit("B").alias("family"))).alias("author"), F.struct(F.array(date).alias("date-parts")).alias("issued"), "publisher").alias("message")))
    m = B.crossref_metadata(msg)
    return p.select("paper_id", m["title"].alias("title"), m["author"].alias("author"), m["published_date"].alias("day"), m["publisher"].alias("publisher"))


def stage_stream(spark: SparkSession, d: str) -> DataFrame:
    """Files as a stream: routed to their stage and counted by day, late ones included; one run over what there is."""
    schema = table(spark, d, "txt_files").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/txt_files.parquet*")
    out = shared_folder(spark, "stage_stream", d)
    counted = R.routed(stream.select("file_id", "stem", "mtime").filter("stem is not null"), "stem")
    q = counted.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("file_id long, stem string, mtime timestamp_ntz, stage string").parquet(f"{out}/rows")
    return rows.distinct().groupBy(F.date_format("mtime", "yyyy-MM-dd").alias("day"), "stage").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (chapter_notes, hub_notes, inline_notes, note_blocks, rebuilt_citations, backfilled, backfill_outcomes, model_json, nfc_names, stem_likeness, paper_pages, paper_metadata, stage_stream)}

_N = "n AS (SELECT DISTINCT note_id, chapter_id, coalesce(stem, '') AS stem, coalesce(chapter, '') AS chapter, coalesce(author, '') AS author, coalesce(summary, '') AS summary, coalesce(body, '') AS body, coalesce(model, '') AS model, coalesce(generated_on, '') AS generated_on, coalesce(category, '') AS category FROM wiki_notes)"
_NL = "chr(10)"


def _link(x: str) -> str:
    f = _filename(x)
    return f"('[[' || substring({f}, 1, length({f}) - 3) || ']]')"


_B = S.strip("l")
_YAML = lambda k, v: f"""(CASE WHEN {v} = '' THEN '' ELSE '{k}: ' || CASE WHEN regexp_matches({v}, {S.q('[:#' + chr(92) + '[' + chr(92) + ']{}&,*!|>' + chr(39) + '"%@`]')}) THEN '"' || replace(replace({v}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' ELSE {v} END || chr(10) END)"""
_SIDE = f"side AS (SELECT stem, min(nullif({S.strip('published_date')}, '')) AS day, min(nullif({S.strip('publisher')}, '')) AS house FROM papermeta WHERE stem IS NOT NULL GROUP BY stem)"
_NO = lambda x: f"(CASE WHEN {x} < 10 THEN '0' ELSE '' END || {x})"
_CAT = "CASE WHEN category = '' THEN '기타' ELSE category END"
_SECTIONS = f"""{_N}, s AS (SELECT stem, note_id AS no, chapter AS title, summary, body, note_id % 3 = 0 AS noted FROM n WHERE stem <> ''), o AS (SELECT stem, max(category) AS category, max(model) AS model, max(generated_on) AS day, {AUTHOR} AS author FROM n WHERE stem <> '' GROUP BY stem)"""
_DEMOTED = f"regexp_replace({S.strip('body')}, '(?m)^(#{{2,5}})(\\s)', '#\\1\\2', 'g')"
_INLINE = f"""{_SECTIONS}, p AS (SELECT stem, string_agg(t, chr(10) ORDER BY no, t) AS parts, string_agg(k, chr(10) ORDER BY no, k) AS links FROM (
        SELECT stem, no, '## ' || {_NO('no')} || '. ' || title || chr(10) || {_DEMOTED} || chr(10) AS t, '### ' || {_NO('no')} || '. ' || title || chr(10) || CASE WHEN summary <> '' THEN summary || chr(10) ELSE '' END || '→ [[' || stem || '/' || {_NO('no')} || '_' || title || '|전문 보기]]' || chr(10) AS k FROM s) GROUP BY stem),
    j AS (SELECT stem, links, '---' || chr(10) || 'title: ' || stem || chr(10) || 'category: ' || category || chr(10) || 'summary: In short.' || chr(10) || 'published: 2020-03' || chr(10) || 'model: ' || model || chr(10) || 'generated: ' || day || chr(10) || 'mode: chapter(A)' || chr(10) || '---' || chr(10) || chr(10)
        || '# ' || stem || chr(10) || chr(10) || '## 책 개요' || chr(10) || {S.strip("'About ' || stem")} || chr(10) || chr(10) || parts AS note FROM p JOIN o USING (stem)),
    u AS (SELECT *, regexp_replace(note, '\\s+$', '') || chr(10) || chr(10) AS head FROM j)"""
SQL = {
    "nfc_names": f"""SELECT file_id, md5(nfc_normalize(stem)) AS name, CASE WHEN regexp_matches(u, '[A-Z]') AND NOT regexp_matches(u, '[가-힣]') THEN array_to_string(list_transform(range(1, length(u) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(u[i - 1], '\\pL') THEN u[i] ELSE lower(u[i]) END), '') ELSE u END AS title
        FROM (SELECT *, upper(replace(regexp_replace(stem, '_[^_]*$', ''), 'ß', 'ss')) AS u FROM (SELECT DISTINCT file_id, stem FROM txt_files))""",
    "backfilled": f"""WITH {_N}, {_SIDE}, j AS (SELECT *, {_YAML('published', "coalesce(day, '')")} || {_YAML('publisher', "coalesce(house, '')")} AS lines FROM n LEFT JOIN side USING (stem))
        SELECT note_id, CASE WHEN lines = '' THEN 'nothing' ELSE 'filled' END AS outcome, md5('title: ' || chapter || chr(10) || 'source: ' || stem || chr(10) || lines || 'model: ' || model) AS fm FROM j""",
    "backfill_outcomes": f"""WITH {_N}, {_SIDE} SELECT CASE WHEN day IS NULL AND house IS NULL THEN 'nothing' ELSE 'filled' END AS outcome, count(*) AS n FROM n LEFT JOIN side USING (stem) GROUP BY 1""",
    "hub_notes": f"""WITH {_SECTIONS}, l AS (SELECT *, {_link("stem || ' — ' || title")} AS link FROM s),
        t AS (SELECT stem, string_agg(toc, chr(10) ORDER BY no, toc) AS toc, string_agg(part, chr(10) ORDER BY no, part) AS parts FROM (SELECT stem, no, '- ' || CASE WHEN noted THEN '✅' ELSE '📄' END || ' ' || link || ' — ' || substring(summary, 1, 60) || CASE WHEN length(summary) > 60 THEN '…' ELSE '' END AS toc,
            '## ' || {_NO('no')} || '. ' || title || chr(10) || CASE WHEN noted THEN '> 📄 ' || link || chr(10) || chr(10) || summary || chr(10) ELSE '> ' || link || chr(10) || chr(10) || summary || chr(10) || chr(10) || body || chr(10) END AS part FROM l) GROUP BY stem)
        SELECT stem, md5('---' || chr(10) || 'title: ' || stem || chr(10) || 'category: ' || {_CAT} || chr(10) || 'tags: ' || CASE WHEN {_CAT} = '기타' THEN '[]' ELSE '["' || category || '"]' END || chr(10) || 'source: ' || stem || '.txt' || chr(10) || CASE WHEN author <> '' THEN 'author: ' || author || chr(10) ELSE '' END || 'published: 2020-03' || chr(10)
            || 'model: ' || model || chr(10) || 'generated: ' || day || chr(10) || '---' || chr(10) || chr(10) || '# ' || stem || chr(10) || chr(10) || 'About ' || stem || chr(10) || chr(10) || '**요약:** In short.' || chr(10) || chr(10) || '{N.TOC_HEADER}' || chr(10) || chr(10) || toc || chr(10) || chr(10) || parts) AS note FROM t JOIN o USING (stem)""",
    "inline_notes": f"""WITH {_INLINE} SELECT stem, md5(note) AS note, md5(head || '{N.LINKS_HEADER}' || chr(10) || chr(10) || regexp_replace(links, '\\s+$', '') || chr(10)) AS linked, md5(head || '{N.LINKS_HEADER}' || chr(10) || chr(10) || 'none') AS replaced FROM u""",
    "chapter_notes": f"""WITH {_N}, w AS (SELECT *, lag(chapter) OVER k AS p, lead(chapter) OVER k AS x FROM n WINDOW k AS (PARTITION BY stem ORDER BY note_id)),
        v AS (SELECT *, concat_ws(' · ', CASE WHEN p IS NOT NULL THEN {_link("stem || ' — ' || p")} END, CASE WHEN x IS NOT NULL THEN {_link("stem || ' — ' || x")} END) AS nav, {_link('stem')} AS home FROM w),
        u AS (SELECT *, CASE WHEN nav <> '' THEN '  |  ' || nav ELSE '' END AS way FROM v)
        SELECT note_id, md5(concat_ws(chr(10), '---', 'title: ' || stem || ' — ' || chapter, 'book: ' || stem, 'chapter: ' || chapter, 'model: ' || model, 'generated: ' || generated_on, '---', '', '# ' || chapter, '> ← ' || home || way, '', '**요약:** ' || summary, '', body, '', '---', '*전체 목차: ' || home || '*' || way)) AS note FROM u""",
    "note_blocks": f"""WITH {_N}, a AS (SELECT note_id, i, {_B} AS s FROM (SELECT note_id, i, l FROM (SELECT note_id, unnest(range(1, len(x) + 1)) AS i, x[i] AS l FROM (SELECT note_id, string_split(body, chr(10)) AS x FROM n)))),
        b AS (SELECT *, CASE WHEN starts_with(s, '|') THEN 'table' WHEN regexp_matches(s, '^#{{1,6}}\\s') THEN 'heading' WHEN starts_with(s, '>') THEN 'quote' WHEN regexp_matches(s, '^#[^\\s#]') THEN 'tags' WHEN regexp_matches(s, '^[-*]\\s+') THEN 'bullet' ELSE 'paragraph' END AS kind FROM a WHERE s <> ''),
        c AS (SELECT *, kind <> 'table' OR coalesce(lag(kind) OVER w <> 'table', true) OR i - lag(i) OVER w > 1 AS fresh FROM b WINDOW w AS (PARTITION BY note_id ORDER BY i))
        SELECT note_id, {', '.join(f"count(*) FILTER (kind = '{k}' AND fresh) AS n_{k}" for k in ('heading', 'table', 'quote', 'tags', 'bullet', 'paragraph'))},
        CAST(coalesce(max(CASE WHEN kind = 'heading' THEN least(4, length(regexp_extract(s, '^#+'))) END), 0) AS BIGINT) AS deepest FROM c GROUP BY note_id""",
    "rebuilt_citations": f"""SELECT chapter_id, CASE WHEN length(qd) >= 10 AND contains({S.sub('body', f'{T.WS}+')}, qd) THEN 1 ELSE 0 END::BIGINT AS n_kept,
        md5('## 핵심 요약' || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || '## 핵심 인용' || chr(10) || chr(10) || '| 주제 | 원문 인용(대조 검증) |' || chr(10) || '|---|---|' || chr(10) || CASE WHEN length(qd) >= 10 AND contains({S.sub('body', f'{T.WS}+')}, qd) THEN '' ELSE '| (원문 확인된 직접 인용 없음) | |' || chr(10) END || '## 관련 개념' || chr(10) || '- y') AS body
        FROM (SELECT chapter_id, body, {S.sub(S.sub(S.sub("regexp_replace(substring(body, 30, 50), '[" + chr(92) + "n|]', ' ', 'g')", r"\([^)]*\)"), f"{T.WS}+"), "^[\"“”‘’ ]+|[\"“”‘’ ]+$")} AS qd FROM (SELECT DISTINCT chapter_id, body FROM chapters WHERE body IS NOT NULL))""",
    "model_json": f"WITH {_N} SELECT note_id, md5(summary) AS summary FROM n",
    "paper_pages": """SELECT paper_id, CASE paper_id % 3 WHEN 0 THEN 'https://example.org/pdf/' || paper_id || '.pdf?a=1&b=2' WHEN 1 THEN 'https://example.org/p/x/' || paper_id || '.pdf' ELSE '' END AS link, CASE WHEN paper_id % 2 = 0 THEN 'a b' || paper_id || '.pdf' ELSE paper_id || '.pdf' END AS file FROM (SELECT DISTINCT paper_id FROM papermeta)""",
    "paper_metadata": f"SELECT paper_id, {S.squeeze('t')} AS title, 'A B' AS author, {S.strip('p')} AS day, {S.strip('h')} AS publisher FROM (SELECT DISTINCT paper_id, coalesce(title, '') AS t, coalesce(published_date, '') AS p, coalesce(publisher, '') AS h FROM papermeta)",
    "stage_stream": f"SELECT strftime(mtime, '%Y-%m-%d') AS day, CASE WHEN NOT regexp_matches(stem, '{T.HANGUL_WIDE}') THEN 'tab3_ready' ELSE 'tab4_ready' END AS stage, count(*) AS n FROM (SELECT DISTINCT file_id, stem, mtime FROM txt_files WHERE stem IS NOT NULL) GROUP BY 1, 2",
}
