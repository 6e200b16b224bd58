"""Queries of the scalar functions and predicates over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import biblio as B
from folioforge.functions import text as T
from folioforge.plans import sqltext as S
from folioforge.plans.sqltext import q
from folioforge.session import table


def token_health(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.round(T.token_health(F.col("text")), 6).alias("health"))


def hangul_routing(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "txt_files").select("file_id", "stem", "txt").distinct()
    t = F.col("txt")
    return f.select("file_id", F.round(T.hangul_ratio(t), 6).alias("ratio"), T.needs_translation(t).alias("needs"), T.already_target(t).alias("already"), T.title_needs_translation(F.col("stem")).alias("title_needs"))


def paragraph_gate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "translate_pairs").select("pair_id", "src", "out").distinct()
    return p.select("pair_id", T.drop_paragraph(F.col("src")).alias("dropped"), T.skip_paragraph(F.col("src")).alias("skipped"), T.asks_for_text(F.col("out")).alias("asks"))


def page_line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages by kind: rotated text, lone numbers, fit to be quoted."""
    p = table(spark, d, "txt_pages").select("page_id", "txt").distinct()
    lines = p.select("page_id", F.posexplode(F.split("txt", "\n")).alias("i", "line"))
    s = F.col("line")
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.count_if(T.vertical_noise(s)).alias("n_vertical"), F.count_if(T.strip(s).rlike("^[0-9]{1,4}$")).alias("n_numbers"), F.count_if(T.clean_sentence(s)).alias("n_quotable"))


def heading_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("chapter_id", "title").distinct()
    t = F.col("title")
    return c.select("chapter_id", T.note_title(t).alias("is_note"), T.ko_major_chapter(t).alias("is_major"), F.coalesce(T.strip_chapter_number(t), F.lit("")).alias("bare"), F.coalesce(T.squeeze(t), F.lit("")).alias("squeezed"))


def names_and_keys(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "txt_files").select("file_id", "stem").distinct()
    s = F.col("stem")
    return f.select("file_id", T.fuzzy_key(s).alias("fuzzy"), T.entity_key(s).alias("entity"), T.note_filename(s).alias("note_file"), T.single_chapter_name(s).alias("single"), T.folder_name(s).alias("folder"), T.author_from_stem(s).alias("author"))


def chapter_filenames(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("chapter_id", "chapter_no", "title").distinct()
    return c.select("chapter_id", T.chapter_filename(F.col("chapter_no"), F.coalesce("title", F.lit(""))).alias("file"))


def length_params(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("chapter_id", F.coalesce(F.length("body"), F.lit(0)).cast("long").alias("n")).distinct()
    pct = T.clean_pct(((F.col("chapter_id") * 7) % 60).cast("string"))
    rows = c.withColumn("pct", pct).withColumn("p", T.length_params(F.col("n") * 10, F.col("pct"))).withColumn("b", T.note_budgets(F.col("n") * 100))
    return rows.select("chapter_id", F.col("pct").cast("long").alias("pct"), "p.target", "p.n_sub", "p.per_sub", "p.n_cite", "p.n_kw", "p.sent_ov", "p.intro_sent", "p.max_out", F.col("b.n_sub").alias("book_sub"), F.col("b.n_cite").alias("book_cite"), "b.cite_keep", F.col("b.max_out").alias("book_out"))


def dates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papermeta").select("paper_id", "stem", "published_date").distinct()
    raw = F.coalesce("published_date", F.lit(""))
    spoken = F.concat(F.regexp_replace(F.regexp_replace(raw, r"^([0-9]{4})-([0-9]{2})", "$1년 $2월"), r"월-([0-9]{2})$", "월 $1일"), F.lit(""))
    named = F.concat(F.lit("report "), F.regexp_replace(raw, "-", ""), F.lit(" x"))
    return p.select("paper_id", B.clean_date(raw).alias("date"), B.clean_date(spoken).alias("spoken"), B.date_from_name(named).alias("named"), B.pdf_date(F.concat(F.lit("D:"), F.regexp_replace(raw, "-", ""))).alias("pdf"))


def biblio_extract(spark: SparkSession, d: str) -> DataFrame:
    """Dates and publishers found in texts that carry an imprint made of the paper's own data."""
    p = table(spark, d, "papermeta").select("paper_id", "published_date", "publisher").distinct()
    text = F.concat(F.lit("A title\n"), F.lit("Published: "), F.coalesce("published_date", F.lit("")), F.lit("\n펴낸곳: "), F.coalesce("publisher", F.lit("")), F.lit(" 주소 Seoul\nText.\n"))
    return p.withColumn("t", text).select("paper_id", B.published(F.col("t")).alias("published"), B.publisher(F.col("t")).alias("publisher"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papermeta").select("paper_id").distinct()
    n = F.lpad(F.col("paper_id").cast("string"), 5, "0")
    src = F.element_at(F.array(F.concat(F.lit("https://arxiv.org/abs/2412."), n), F.concat(F.lit("doi:10.1145/3442188."), n), F.concat(F.lit("10.1000/"), n), F.concat(F.lit("https://example.org/a b/"), n)), (F.col("paper_id") % 4 + 1).cast("int"))
    df = p.withColumn("s", src)
    return df.select("paper_id", B.safe_stem(F.col("s")).alias("stem"), F.coalesce(B.arxiv_id(F.col("s")), F.lit("")).alias("arxiv"), F.coalesce(B.doi(F.col("s")), F.lit("")).alias("doi"), F.array_join(B.source_candidates(F.col("s")), " ").alias("candidates"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papermeta").select("paper_id").distinct()
    v = F.concat(F.lit("v1."), (F.col("paper_id") % 12).cast("string"), F.lit("."), (F.col("paper_id") % 7).cast("string"), F.lit("b"))
    newer = T.version_parts(v) > T.version_parts(F.lit("1.9.3"))
    return p.select("paper_id", newer.alias("newer"), T.roman_value(F.element_at(F.split(F.lit("I IV IX XIV XL XC CD MCMXCIX"), " "), (F.col("paper_id") % 8 + 1).cast("int"))).cast("long").alias("roman"), T.mask_key(F.concat(F.lit("key-"), F.repeat(F.lit("x"), (F.col("paper_id") % 9).cast("int")), F.col("paper_id").cast("string"))).alias("masked"))


def toc_titles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("chapter_id", "chapter_no", "title").distinct()
    led = F.concat(F.coalesce("title", F.lit("")), F.lit(" ....... "), F.col("chapter_no").cast("string"))
    return c.select("chapter_id", T.toc_title(led).alias("clean"))


def markdown_cleanup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "wiki_notes").select("note_id", "body").distinct()
    md = F.concat(F.coalesce("body", F.lit("")), F.lit("\n![a](b.png) <!-- x\ny -->\f### end"))
    return n.select("note_id", F.md5(T.strip_md_noise(md)).alias("clean"), F.md5(T.demote_headings(md)).alias("demoted"), F.md5(T.strip_emoji(F.concat(md, F.lit(" 📚  ok")))).alias("plain"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Front matter rendered from notes and read back, and the parts of summary files."""
    from folioforge.operators.notes import front_lines, summary_md

    n = table(spark, d, "wiki_notes").select("note_id", "stem", "chapter", "author", "summary", "body", "model", "generated_on").distinct()
    text = summary_md(F.coalesce("stem", F.lit("")), F.coalesce("chapter", F.lit("")), F.col("summary"), F.col("body"), T.strip(F.coalesce("author", F.lit(""))), F.col("model"), F.col("generated_on"))
    df = n.withColumn("t", text)
    fm = B.frontmatter(F.col("t"))["fm"]
    part = B.summary_parts(F.col("t"))
    return df.select("note_id", B.frontmatter_value(fm, "book").alias("book"), B.frontmatter_value(fm, "model").alias("model"), B.frontmatter_value(fm, "author").alias("author"), F.md5(part["summary"]).alias("summary"), F.md5(part["body"]).alias("body"), F.md5(front_lines(chapter=F.col("chapter"), author=F.col("author"))).alias("lines"))


def bilingual_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in both forms from pairs, read back."""
    p = table(spark, d, "translate_pairs").select("pair_id", "src", "out").distinct().filter("src is not null and out is not null")
    s, o = F.regexp_replace(T.squeeze(F.col("src")), r"^\[+", ""), F.regexp_replace(T.squeeze(F.col("out")), r"^\[+", "")
    p = p.select("pair_id", s.alias("s"), o.alias("o")).filter("s <> '' and o <> ''")
    block = F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit("[EN]\n"), "s", F.lit("\n\n[KO]\n"), "o")).otherwise(F.concat("s", F.lit("\n\n"), "o"))
    b = T.bilingual(block)
    return p.select("pair_id", F.md5(b["src"]).alias("src"), F.md5(b["tgt"]).alias("tgt"))


_DOCS = "documents"
_c = S.count
_odd = r"[^0-9A-Za-z_가-힣()\.,'\"·\-—%·:!?\s]"

QUERIES = {f.__name__: f for f in (token_health, hangul_routing, paragraph_gate, page_line_kinds, heading_kinds, names_and_keys, chapter_filenames, length_params, dates, biblio_extract, sources, versions, toc_titles, markdown_cleanup, front_matter, bilingual_blocks)}

_p = S.strip("coalesce(src, '')")
_skip = " OR ".join([f"{_p} = ''", *(S.like(_p, x) for x in (T.DAGGER, T.NUMBERED_CITATION, T.BULLET_CITATION)), f"(length({_p}) < {T.SHORT_CITATION} AND ({S.like(_p, T.FOOTNOTE_START)} OR {S.like(_p, T.CITED_URL)}))"])
_asks = " OR ".join([S.like(f"lower({S.strip(chr(111) + chr(117) + chr(116))})", T.ASKS_PATTERN), *(f"contains(out, {q(x)})" for x in T.ASKS_FOR_TEXT)])
_l = S.strip("line")
_tk = S.tokens("line")
_t = S.strip("coalesce(title, '')")
_edge = lambda x, cls: S.sub(x, f"^[{cls}]+|[{cls}]+$")
_safe = S.sub(S.strip(S.sub("stem", r'[/\\:*?"<>|]', " ")), r"$^")


def _key(x: str) -> str:
    out = f"lower({x})"
    for p in (r"\.(txt|pdf|md)$", r"^add_pdf[_\s-]*", r"_?(?:ko|번역|레퍼런스삭제_번역)$", r"_home-miniui-macmini\.local_.*?_conflict$", r"\s+—\s+.*$", r"^[0-9]{1,2}[_\s.-]+", r"[^0-9a-z가-힣]+"):
        out = S.sub(out, p)
    return out


_NAME_PARTS = f"list_filter(list_transform(string_split(coalesce(stem, ''), '_'), lambda x: {S.strip('x')}), lambda x: x <> '')"
#: An author in a stem.
AUTHOR = f"(CASE WHEN len({_NAME_PARTS}) >= 2 AND length(({_NAME_PARTS})[-1]) BETWEEN 2 AND 25 AND NOT regexp_matches(({_NAME_PARTS})[-1], '[0-9]') THEN ({_NAME_PARTS})[-1] ELSE '' END)"


def _filename(x: str) -> str:
    safe = S.sub(S.strip(S.sub(S.sub(x, r"[/\\:]", " - "), r'[*?"<>|]')), r"\s{2,}", " ")
    return f"CASE WHEN {safe} = '' THEN 'untitled' ELSE {safe} END || '.md'"


_clean_date = lambda x: f"""(CASE WHEN m <> '' AND d <> '' THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') WHEN m <> '' THEN y || '-' || lpad(m, 2, '0') ELSE y END)"""
_DP = r"^((?:18|19|20)[0-9]{2})(?:[./년\-]?([0-9]{1,2}))?(?:[./월\-]?([0-9]{1,2}))?"

SQL = {
    "token_health": f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, round(CASE WHEN len(t) = 0 THEN 1.0 ELSE len(list_filter(t, lambda x: length(x) >= {T.LONG_TOKEN}))::DOUBLE / len(t) END, 6) AS health
        FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)""",
    "hangul_routing": f"""SELECT file_id, round({S.hangul("coalesce(txt, '')")}, 6) AS ratio, {S.hangul("substring(coalesce(txt, ''), 1, 3000)")} < {T.TARGET_RATIO} AS needs,
        {S.strip("coalesce(txt, '')")} <> '' AND {S.hangul(S.strip("coalesce(txt, '')"))} >= {T.ALREADY_RATIO} AS already, NOT {S.like("coalesce(stem, '')", T.HANGUL_WIDE)} AS title_needs
        FROM (SELECT DISTINCT file_id, stem, txt FROM txt_files)""",
    "paragraph_gate": f"""SELECT pair_id, {_p} = '' OR (length({_p}) <= {T.DROP_CHARS} AND {S.like(_p, T.NUMBER_ONLY)}) AS dropped, {_skip} AS skipped,
        coalesce({S.strip('out')} <> '' AND ({_asks}), false) AS asks FROM (SELECT DISTINCT pair_id, src, out FROM translate_pairs)""",
    "page_line_kinds": f"""SELECT page_id, count(*) AS n_lines, count(*) FILTER (len({_tk}) >= 6 AND list_sum(list_transform({_tk}, lambda x: length(x)))::DOUBLE / len({_tk}) <= 1.3) AS n_vertical,
        count(*) FILTER ({S.like(_l, '^[0-9]{1,4}$')}) AS n_numbers,
        count(*) FILTER (length({_l}) BETWEEN 25 AND 180 AND {_c(_l, T.HANGUL)} >= length({_l}) * 0.45 AND NOT {S.like(_l, '[ᄀ-ᇿ㄰-㆏]')} AND NOT {S.like(_l, '[一-鿿]{2,}')} AND {_c(_l, _odd)} <= 3) AS n_quotable
        FROM (SELECT page_id, unnest(string_split(txt, chr(10))) AS line FROM (SELECT DISTINCT page_id, txt FROM txt_pages)) GROUP BY page_id""",
    "heading_kinds": f"""SELECT chapter_id, {S.like(_t, '^[0-9]+[.)]' + chr(92) + 's')} OR lower({_t}) IN ({', '.join(map(q, T.NOTE_SECTIONS))}) AS is_note, {S.like(_t, T.KO_MAJOR)} AS is_major,
        coalesce({_edge(S.sub('title', '^' + chr(92) + 's*[0-9]+[.)]' + chr(92) + 's*'), ' :：')}, '') AS bare, coalesce({S.squeeze('title')}, '') AS squeezed FROM (SELECT DISTINCT chapter_id, title FROM chapters)""",
    "names_and_keys": f"""SELECT file_id, lower({S.sub('stem', '[^0-9A-Za-z가-힣ぁ-んァ-ヶ一-龥À-ÖØ-öø-ÿ]+')}) AS fuzzy, {_key('stem')} AS entity, {_filename('stem')} AS note_file,
        '01_' || CASE WHEN s1 = '' THEN '본문' ELSE s1 END || '.txt' AS single, {S.strip(S.sub('stem', '[/' + chr(92) * 2 + ':*?"<>|]', '_'))} AS folder,
        CASE WHEN len(parts) >= 2 AND length(parts[-1]) > 1 AND length(parts[-1]) <= 25 AND NOT {S.like('parts[-1]', '[0-9]')} THEN parts[-1] ELSE '' END AS author
        FROM (SELECT *, {_edge('substring(' + S.strip(S.sub('stem', '[/' + chr(92) * 2 + ':*?"<>|]', ' ')) + ', 1, 50)', ' .,:' + chr(92) + '-')} AS s1,
            list_filter(list_transform(string_split(coalesce(stem, ''), '_'), lambda x: {S.strip('x')}), lambda x: x <> '') AS parts FROM (SELECT DISTINCT file_id, stem FROM txt_files))""",
    "chapter_filenames": f"""SELECT chapter_id, CASE WHEN chapter_no < 10 THEN '0' ELSE '' END || chapter_no || '_' || CASE WHEN s3 = '' THEN '장' ELSE s3 END || '.md' AS file FROM (
        SELECT *, {_edge('s2', ' .,' + chr(92) + '-:')} AS s3 FROM (SELECT *, CASE WHEN length(s1) > 60 THEN regexp_replace(substring(s1, 1, 60), ' [^ ]*$', '') ELSE s1 END AS s2 FROM (
        SELECT *, {S.sub(S.strip(S.sub("coalesce(title, '')", '[/' + chr(92) * 2 + ':*?"<>|]', ' ')), chr(92) + 's{2,}', ' ')} AS s1 FROM (SELECT DISTINCT chapter_id, chapter_no, title FROM chapters))))""",
    "length_params": """WITH a AS (SELECT chapter_id, n * 10 AS c, n * 100 AS c2, greatest(5, least(40, (chapter_id * 7) % 60)) AS pct FROM (SELECT DISTINCT chapter_id, coalesce(length(body), 0) AS n FROM chapters)),
        b AS (SELECT *, greatest(1200 + pct * 90, CAST(floor(c * pct / 100) AS BIGINT)) AS target FROM a), c AS (SELECT *, greatest(3, least(24, CAST(round_even(target / 700, 0) AS BIGINT))) AS n_sub FROM b)
        SELECT chapter_id, CAST(pct AS BIGINT) AS pct, CAST(target AS BIGINT) AS target, CAST(n_sub AS BIGINT) AS n_sub, CAST(greatest(1, target // n_sub) AS BIGINT) AS per_sub, CAST(greatest(3, least(14, round_even(n_sub * 0.7::DOUBLE, 0))) AS BIGINT) AS n_cite,
        greatest(5, 4 + pct // 8) || '~' || (greatest(5, 4 + pct // 8) + 4) AS n_kw, (3 + pct // 10) || '~' || (5 + pct // 10) AS sent_ov, (5 + pct // 8) || '~' || (8 + pct // 8) AS intro_sent,
        CAST(least(64000, greatest(6000, floor(target * 2.6::DOUBLE))) AS BIGINT) AS max_out, CAST(least(24, greatest(7, c2 // 35000)) AS BIGINT) AS book_sub, CAST(least(30, greatest(8, c2 // 28000)) AS BIGINT) AS book_cite,
        CAST(least(15, greatest(4, c2 // 110000)) AS BIGINT) AS cite_keep, CAST(least(60000, greatest(16384, least(24, greatest(7, c2 // 35000)) * 2200)) AS BIGINT) AS book_out FROM c""",
    "dates": """SELECT paper_id, r AS date, r AS spoken, CASE WHEN length(r) IN (4, 7) THEN r ELSE '' END AS named,
        CASE WHEN r = '' THEN '' WHEN length(r) = 4 THEN r || '-01-01' WHEN length(r) = 7 THEN r || '-01' ELSE r END AS pdf FROM (SELECT DISTINCT paper_id, stem, trim(coalesce(published_date, '')) AS r FROM papermeta)""",
    "biblio_extract": """SELECT paper_id, trim(coalesce(published_date, '')) AS published, CASE WHEN length(p) >= 2 THEN p ELSE '' END AS publisher FROM (SELECT DISTINCT paper_id, published_date, trim(coalesce(publisher, '')) AS p FROM papermeta)""",
    "sources": """WITH a AS (SELECT DISTINCT paper_id, lpad(CAST(paper_id AS VARCHAR), 5, '0') AS n, paper_id % 4 AS k FROM papermeta)
        SELECT paper_id, CASE k WHEN 0 THEN 'arxiv.org_abs_2412.' || n WHEN 1 THEN 'doi_10.1145_3442188.' || n WHEN 2 THEN '10.1000_' || n ELSE 'example.org_a_b_' || n END AS stem, CASE k WHEN 0 THEN '2412.' || n ELSE '' END AS arxiv,
        CASE k WHEN 1 THEN '10.1145/3442188.' || n WHEN 2 THEN '10.1000/' || n ELSE '' END AS doi,
        CASE k WHEN 0 THEN 'https://arxiv.org/pdf/2412.' || n || ' https://arxiv.org/abs/2412.' || n WHEN 1 THEN 'https://doi.org/10.1145/3442188.' || n WHEN 2 THEN 'https://doi.org/10.1000/' || n ELSE 'https://example.org/a b/' || n END AS candidates FROM a""",
    "versions": """SELECT paper_id, (paper_id % 12 > 9) OR (paper_id % 12 = 9 AND paper_id % 7 > 3) AS newer, CAST(([1, 4, 9, 14, 40, 90, 400, 1999])[paper_id % 8 + 1] AS BIGINT) AS roman,
        CASE WHEN length(k) > 10 THEN left(k, 4) || '…' || right(k, 4) ELSE repeat('•', length(k)) END AS masked FROM (SELECT DISTINCT paper_id, 'key-' || repeat('x', CAST(paper_id % 9 AS INTEGER)) || paper_id AS k FROM papermeta)""",
    "toc_titles": f"""SELECT chapter_id, {_edge(S.squeeze("coalesce(title, '')"), ' .·ㆍ…')} AS clean FROM (SELECT DISTINCT chapter_id, chapter_no, title FROM chapters)""",
    "markdown_cleanup": r"""SELECT note_id, md5(coalesce(body, '') || chr(10) || chr(10) || '### end') AS clean, md5(regexp_replace(md, '(?m)^(#{2,5})(\s)', '#\1\2', 'g')) AS demoted, md5(regexp_replace(md || '  ok', ' {2,}', ' ', 'g')) AS plain
        FROM (SELECT note_id, body, coalesce(body, '') || chr(10) || '![a](b.png) <!-- x' || chr(10) || 'y -->' || chr(12) || '### end' AS md FROM (SELECT DISTINCT note_id, body FROM wiki_notes))""",
    "front_matter": f"""SELECT note_id, {S.sub(S.strip("coalesce(stem, '')"), '^"+|"+$')} AS book, coalesce(model, '') AS model, {S.strip("coalesce(author, '')")} AS author, md5({S.squeeze("coalesce(summary, '')")}) AS summary, md5({S.strip("coalesce(body, '')")}) AS body,
        md5(CASE WHEN c = '' THEN '' WHEN {S.like('c', chr(91) + ':#' + chr(92) + '[' + chr(92) + ']{}&,*!|>' + chr(39) + '"%@`]')} THEN 'chapter: "' || replace(replace(c, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' || chr(10) ELSE 'chapter: ' || c || chr(10) END
         || CASE WHEN a = '' THEN '' WHEN {S.like('a', chr(91) + ':#' + chr(92) + '[' + chr(92) + ']{}&,*!|>' + chr(39) + '"%@`]')} THEN 'author: "' || replace(replace(a, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' || chr(10) ELSE 'author: ' || a || chr(10) END) AS lines
        FROM (SELECT DISTINCT note_id, stem, chapter, author, summary, body, model, generated_on, {S.strip("coalesce(chapter, '')")} AS c, {S.strip("coalesce(author, '')")} AS a FROM wiki_notes)""",
    "bilingual_blocks": f"""SELECT pair_id, md5(s) AS src, md5(o) AS tgt FROM (SELECT pair_id, {S.strip(S.sub(S.squeeze('src'), '^' + chr(92) + '[+'))} AS s, {S.strip(S.sub(S.squeeze('out'), '^' + chr(92) + '[+'))} AS o
        FROM (SELECT DISTINCT pair_id, src, out FROM translate_pairs)) WHERE s <> '' AND o <> ''""",
}
