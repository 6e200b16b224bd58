"""Queries of look-ups, file rules, states and small sinks, with rows made of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import biblio as B
from folioforge.functions import settings as C
from folioforge.functions import text as T
from folioforge.operators import matching as M
from folioforge.operators import stages as Q
from folioforge.operators.chapters import top_bookmarks
from folioforge.operators.cleanup import clean_form_feeds
from folioforge.operators.layout import glyph_kind
from folioforge.operators.model import heading_like, retry_prompt
from folioforge.plans import sqltext as S
from folioforge.plans.segment_queries import _KEPT, _LINES, _REFLOW, _pages
from folioforge.session import shared_folder, table
from folioforge.sources import files as X


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "txt_files").select("file_id", F.coalesce("stem", F.lit("")).alias("stem"), F.coalesce("ext", F.lit("")).alias("ext"), F.coalesce("txt", F.lit("")).alias("txt"), "mtime").distinct()


def inbox_rows(spark: SparkSession, d: str) -> DataFrame:
    """Delivered files as an inbox sees them: those it takes, with name, kind and token, and what reading each as text gives."""
    f = _files(spark, d).select(F.concat(F.lit("/in/"), F.col("file_id").cast("string"), F.lit("."), F.upper("ext")).alias("path"), F.length("txt").cast("long").alias("length"), F.col("mtime").alias("modificationTime"), F.encode("txt", "UTF-8").alias("content"))
    rows = X.inbox_rows(f.withColumn("length", F.octet_length("content").cast("long")))
    text = X.office_texts(rows).select("path", "error")
    return rows.join(text, "path").select("path", "stem", "ext", "size", "token", F.when(F.col("ext") == "docx", "").otherwise(F.col("error")).alias("error"))


def ole_files(spark: SparkSession, d: str) -> DataFrame:
    """Old office files under a new suffix, told by their first bytes."""
    f = _files(spark, d).select("file_id", F.concat(F.when(F.col("file_id") % 3 == 0, F.unhex(F.lit("D0CF11E0"))).otherwise(F.unhex(F.lit("504B0304"))), F.encode("txt", "UTF-8")).alias("content"))
    return f.select("file_id", X.is_ole2(F.col("content")).alias("old"))


def converted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Converted texts without stand-ins of pictures and rows of empty lines."""
    f = _files(spark, d)
    return f.select("file_id", F.md5(X.clean_converted_column(F.concat(F.lit("![a](b.png)\n\n\n\n"), "txt", F.lit("[image 3]")))).alias("text"))


def sniffed(spark: SparkSession, d: str) -> DataFrame:
    """What an answer to a download is, by its content and type."""
    f = _files(spark, d)
    k = F.col("file_id") % 5
    kind = F.when(k == 0, "application/pdf; x").when(k == 1, "Text/Plain").when(k == 2, "text/html").otherwise("application/octet-stream")
    head = F.when(k == 3, F.lit("%PDF-1.7 ")).when(k == 2, F.lit("  <!DOCTYPE html><html>")).otherwise(F.lit(""))
    return f.select("file_id", X.sniff(F.concat(head, "txt"), kind, F.length("txt").cast("long") * 1000).alias("kind"))


def paper_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Which service's answer counts for a source: arXiv, then CrossRef for a DOI or its address, else none."""
    p = table(spark, d, "papermeta").select("paper_id").distinct()
    n = F.lpad(F.col("paper_id").cast("string"), 5, "0")
    k = F.col("paper_id") % 5
    source = F.when(k == 0, F.concat(F.lit("https://arxiv.org/abs/2412."), n)).when(k == 1, F.concat(F.lit("doi:10.1145/"), n)).when(k == 2, F.concat(F.lit("10.1000/"), n)).when(k == 3, F.concat(F.lit("https://doi.org/10.1/"), n)).otherwise(F.concat(F.lit("https://example.org/"), n))
    m = B.paper_metadata(source, F.when(F.col("paper_id") % 2 == 0, F.struct(F.lit("arxiv").alias("title"))), F.struct(F.lit("crossref").alias("title")))
    return p.select("paper_id", F.coalesce(m["title"], F.lit("")).alias("title"))


def arxiv_entries(spark: SparkSession, d: str) -> DataFrame:
    """Metadata read back from Atom entries with several authors."""
    p = table(spark, d, "papermeta").select("paper_id", "title", "published_date").distinct().fillna("")
    esc = F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), esc, F.lit("</title><published>"), "published_date", F.lit("T00:00:00Z</published><author><name>A. B</name></author><author><name> C D </name></author></entry></feed>"))
    m = B.arxiv_metadata(xml)
    return p.select("paper_id", m["title"].alias("title"), m["author"].alias("author"), m["publisher"].alias("publisher"))


def crossref_dates(spark: SparkSession, d: str) -> DataFrame:
    """Which of a CrossRef answer's dates counts: print, online, issued; and the names of several authors."""
    p = table(spark, d, "papermeta").select("paper_id").distinct()
    k = F.col("paper_id") % 4
    day = lambda year: F.struct(F.array(F.array(F.lit(year), (F.col("paper_id") % 12 + 1).cast("int"))).alias("date-parts"))
    names = F.array(F.struct(F.lit("A").alias("given"), F.col("paper_id").cast("string").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("B").alias("family")))
    msg = F.to_json(F.struct(F.struct(names.alias("author"), F.when(k == 0, day(2001)).alias("published-print"), F.when(k <= 1, day(2002)).alias("published-online"), F.when(k <= 2, day(2003)).alias("issued")).alias("message")))
    m = B.crossref_metadata(msg)
    return p.select("paper_id", m["published_date"].alias("day"), m["author"].alias("author"))


def sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar JSON of papers, read back."""
    p = table(spark, d, "papermeta").select("paper_id", "title", "author", "published_date", "publisher").distinct().fillna("")
    raw = B.sidecar_json(F.struct("title", "author", "published_date", "publisher"))
    m = F.from_json(raw, "title string, author string, published_date string, publisher string")
    return p.select("paper_id", *[m[c].alias(c) for c in ("title", "author", "published_date", "publisher")])


def pdf_info(spark: SparkSession, d: str) -> DataFrame:
    """Dates from lines about PDFs."""
    f = _files(spark, d)
    day = F.date_format("mtime", "yyyyMMdd")
    lines = f.select("file_id", F.explode(F.array(F.concat(F.lit("CreationDate:   D:"), day, F.lit("120000Z")), F.concat(F.lit("ModDate: "), F.date_format("mtime", "yyyy")), F.lit("Pages: 3"))).alias("line"))
    return C.pdf_info_dates(lines, "file_id", "line")


def book_roots(spark: SparkSession, d: str) -> DataFrame:
    """Books over two roots, the newer one first."""
    f = _files(spark, d).filter("stem <> ''")
    new = f.filter("file_id % 3 = 0").select("stem", F.concat(F.lit("new/"), F.col("file_id").cast("string")).alias("path"))
    old = f.select("stem", F.concat(F.lit("old/"), F.col("file_id").cast("string")).alias("path"))
    return C.books_listing([new, old], "stem", "path")


def split_parts(spark: SparkSession, d: str) -> DataFrame:
    """Files that are numbered parts of their stem, and the first PDF of each stem."""
    c = table(spark, d, "chapters").select("chapter_id", "stem", "chapter_no").distinct().filter("stem is not null")
    name = F.when(F.col("chapter_id") % 4 == 0, F.concat("stem", F.lit(".md"))).otherwise(F.concat("stem", F.lit("_"), F.lpad(F.col("chapter_no").cast("string"), 2, "0"), F.lit("_x.md")))
    parts = C.split_files(c.withColumn("name", name), "name", "stem")
    pdfs = _files(spark, d).filter("ext = 'pdf'").select("stem", F.concat(F.lit("pdf/"), F.col("file_id").cast("string")).alias("pdf"))
    return C.source_pdf(parts.select("chapter_id", "stem"), pdfs, "stem", "pdf").select("chapter_id", F.coalesce("pdf", F.lit("")).alias("pdf"))


def block_counts(spark: SparkSession, d: str) -> DataFrame:
    """Translated blocks of bilingual files in both forms, and files that a save would shrink."""
    p = table(spark, d, "translate_pairs").select("chapter_id", "pair_id").distinct().groupBy("chapter_id").agg(F.count("*").cast("int").alias("n"))
    new, old = F.repeat(F.lit("a\n\nb\n\n---\n\n"), F.col("n")), F.repeat(F.lit("[EN]\na\n\n[KO]\nb\n\n---\n\n"), F.col("n"))
    return p.select("chapter_id", C.translated_blocks(F.when(F.col("chapter_id") % 2 == 0, new).otherwise(old)).cast("long").alias("n_blocks"))


def shrinking(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that would lose blocks if only their translated paragraphs were saved."""
    p = table(spark, d, "translate_pairs").select("chapter_id", "pair_id", "status").distinct()
    old = p.groupBy("chapter_id").agg(F.count("*").alias("n"))
    return Q.shrinks(old, p.groupBy("chapter_id").agg(F.count_if(F.col("status") == "translated").alias("n")), "chapter_id", "n")


def language_files(spark: SparkSession, d: str) -> DataFrame:
    """Each chapter's source and translated text as files of their own; kept originals have no translation."""
    p = table(spark, d, "translate_pairs").select("chapter_id", "idx", "pair_id", "src", "out").distinct()
    out = F.when(F.col("pair_id") % 10 == 0, F.concat(F.lit("(원문 보존: 서지)"), F.coalesce("out", F.lit("")))).otherwise(F.col("out"))
    got = Q.language_files(p.withColumn("out", out), "chapter_id", ["idx", "pair_id"], "src", "out")
    return got.select("chapter_id", F.md5("en").alias("en"), F.md5("ko").alias("ko"))


def autostart(spark: SparkSession, d: str) -> DataFrame:
    """Of the books that wait for the next stage those that were just processed."""
    c = table(spark, d, "chapters").select("stem", "chapter_id", "mode").distinct().filter("stem is not null")
    waiting = c.select(Q.route(F.col("stem")).alias("stage"), F.col("stem").alias("item"), F.col("chapter_id").alias("seq"))
    return Q.autostart(Q.queue_add(waiting, waiting), c.filter("mode <> 'single' and chapter_id % 2 = 0").select(F.col("stem").alias("item")), "tab3_ready")


def failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed paragraphs as a side output, and those put back."""
    from folioforge.streaming.stages import put_back, split_errors

    p = table(spark, d, "translate_pairs").select("pair_id", "status").distinct().withColumn("ok", F.col("status") != "failed")
    good, bad = split_errors(p, "ok")
    again = put_back(bad, "tab3_ready").filter("pair_id % 2 = 0")
    return good.select("pair_id", F.lit("done").alias("stage")).unionByName(bad.select("pair_id", "stage")).unionByName(again.select("pair_id", "stage"))


def processed_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems that were processed: files under four roots and the done file."""
    f = _files(spark, d)
    name = F.concat("stem", F.lit("."), "ext")
    roots = [f.filter(F.col("file_id") % 4 == k).select(name.alias("name")) for k in range(4)]
    done = table(spark, d, "wiki_notes").select(F.concat(F.lit("  x/"), "stem", F.lit(".txt ")).alias("name"))
    return M.processed_stems(roots, done, "name")


def file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files by kind, translations and summaries not among them."""
    f = _files(spark, d).select(F.concat("stem", F.when(F.col("file_id") % 5 == 0, "_ko").otherwise(""), F.lit("."), "ext").alias("name"))
    return M.file_counts(f, "name", ["pdf", "txt"], ("_ko", "_wiki"))


def interface_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles as an interface shows them: a dictionary's entry, else the title itself."""
    c = table(spark, d, "chapters").select("chapter_id", F.col("title").alias("text")).distinct().filter("text is not null")
    words = c.filter("chapter_id % 2 = 0").groupBy("text").agg(F.min(F.concat(F.lit("t"), F.col("chapter_id").cast("string"))).alias("shown"))
    return C.translate_ui(c, words, "text").select("chapter_id", "shown")


def engines(spark: SparkSession, d: str) -> DataFrame:
    """Engines that the models of notes and pairs make up, and the one provider that is taken."""
    n = table(spark, d, "wiki_notes").select("model").distinct().filter("model is not null")
    providers = n.agg(F.array_sort(F.collect_set("model")).alias("models")).select(F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(p == "openai" or p == "claude_cli").alias("usable")) for p in C.PROVIDER_ORDER])).alias("p"), "models")
    providers = providers.select("p.provider", F.upper("p.provider").alias("label"), "models", "p.usable")
    picked = C.pick_provider(providers, "gemini").select(F.concat_ws(":", "provider", "model").alias("engine"), F.lit(True).alias("picked"))
    return C.engine_options(providers).join(picked, "engine", "left").select("engine", "label", "available", F.coalesce("picked", F.lit(False)).alias("picked"))


def capped_inputs(spark: SparkSession, d: str) -> DataFrame:
    """How much of a long input each provider is given."""
    f = _files(spark, d)
    who = F.element_at(F.array(*map(F.lit, (*C.PROVIDER_ORDER, "other"))), (F.col("file_id") % 6 + 1).cast("int"))
    return f.select("file_id", F.length(T.cap_input(who, F.rpad(F.left("txt", F.lit(1)), 500_000, "x"))).cast("long").alias("n"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Second prompts of paragraphs, and which look like headings."""
    p = table(spark, d, "translate_pairs").select("pair_id", "src").distinct().filter("src is not null")
    return p.select("pair_id", F.md5(retry_prompt(F.col("src"))).alias("prompt"), heading_like(F.col("src")).alias("heading"))


def note_paths(spark: SparkSession, d: str) -> DataFrame:
    """Notes that a scan finds: not in hidden folders, not in nested vaults."""
    n = table(spark, d, "wiki_notes").select("note_id").distinct()
    k = F.col("note_id") % 5
    folder = F.when(k == 0, ".trash/").when(k == 1, "_old/").when(k == 2, "sub/vault/").otherwise("sub/")
    paths = n.select(F.concat(F.lit("file:/wiki/"), folder, F.col("note_id").cast("string"), F.lit(".md")).alias("path"))
    return X.note_candidates(paths, "/wiki", spark.createDataFrame([("file:/wiki/sub/vault",)], "root string"))


def vault_registry(spark: SparkSession, d: str) -> DataFrame:
    """Vaults of registries, one a stem."""
    n = table(spark, d, "wiki_notes").select("stem", "note_id").distinct().filter("stem is not null")
    rows = n.groupBy("stem").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("note_id").cast("string"), F.struct(F.concat(F.lit("/v/"), F.col("note_id").cast("string")).alias("path"), F.col("note_id").alias("ts")))))).alias("vaults"))
    return X.vault_rows(rows.select(F.to_json(F.struct("vaults")).alias("value")), "value")


def last_log_lines(spark: SparkSession, d: str) -> DataFrame:
    """The twenty last lines of a log: a top-k report."""
    f = _files(spark, d)
    line = F.when(F.col("file_id") % 9 == 0, F.lit("no stamp")).otherwise(F.concat(F.lit("["), F.date_format("mtime", "yyyy-MM-dd HH:mm:ss"), F.lit("] file "), F.col("file_id").cast("string")))
    return X.log_lines(f.select(line.alias("value")), "value").select("line")


def bookmark_levels(spark: SparkSession, d: str) -> DataFrame:
    """Top-level bookmarks of documents with three or more."""
    c = table(spark, d, "chapters").select("file_id", "chapter_id", F.coalesce("title", F.lit(" ")).alias("title"), (F.col("chapter_no") % 2).alias("level")).distinct().filter("file_id is not null")
    return top_bookmarks(c, "file_id").select("file_id", "chapter_id")


def raw_texts(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts with form feeds between pages, cleaned: the same as cleaned pages."""
    rows = _pages(spark, d).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "txt"))), lambda x: x["txt"]), "\f").alias("raw"))
    books = clean_form_feeds(rows, "file_id", "raw")
    return books.select(F.col("book").alias("file_id"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text"))


def glyph_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every character of the pages by the kind of glyph it is."""
    odd = F.concat("txt", F.lit("".join(map(chr, (65534, 65535, 9, 13, 7, 160, 8195, 8203)))))
    chars = _pages(spark, d).select(F.explode(F.split(odd, "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.groupBy(F.coalesce(F.nullif(glyph_kind(F.col("ch")), F.lit("")), F.lit("real")).alias("kind")).agg(F.count("*").alias("n_chars"))


def written_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters written by book, some of them again, and read back; done marks appended twice."""
    c = table(spark, d, "chapters").select("stem", "chapter_no", "chapter_id", F.coalesce("body", F.lit("")).alias("body")).distinct().filter("stem is not null")
    out = shared_folder(spark, "written_chapters", d)
    X.write_chapters(c, f"{out}/books")
    X.write_chapters(c.filter(F.pmod(F.length("stem"), F.lit(2)) == 0).withColumn("body", F.concat("body", F.lit("!"))), f"{out}/books")
    done = c.select(F.col("stem").alias("name")).distinct()
    X.replace_table(done.limit(0), f"{out}/done")
    X.append_done(done, f"{out}/done")
    X.append_done(done.filter("name like 'a%'"), f"{out}/done")
    marks = spark.read.parquet(f"{out}/done").groupBy("name").agg(F.count("*").alias("n_marks"))
    back = spark.read.parquet(f"{out}/books").select("stem", "chapter_id", "body")
    return back.join(marks, back["stem"] == marks["name"]).select("chapter_id", F.md5("body").alias("body"), "n_marks")


def noted_categories(spark: SparkSession, d: str) -> DataFrame:
    """Notes written into folders by category, counted there."""
    n = table(spark, d, "wiki_notes").select("note_id", F.coalesce(F.nullif(T.strip(F.col("category")), F.lit("")), F.lit("기타")).alias("category"), F.coalesce("body", F.lit("")).alias("note")).distinct()
    out = shared_folder(spark, "noted_categories", d)
    X.write_notes(n, out, "category")
    return spark.read.option("inferSchema", "false").parquet(out).groupBy(F.col("category").cast("string").alias("category")).agg(F.count("*").alias("n"), F.sum(F.length("note")).alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        inbox_rows, ole_files, converted_texts, sniffed, paper_precedence, arxiv_entries, crossref_dates, sidecars, pdf_info, book_roots, split_parts, block_counts, shrinking, language_files, autostart, failures, processed_stems, file_counts, interface_texts,
        engines, capped_inputs, prompts, note_paths, vault_registry, last_log_lines, bookmark_levels, raw_texts, glyph_kinds, written_chapters, noted_categories,
    )
}

_F = "(SELECT DISTINCT file_id, coalesce(stem, '') AS stem, coalesce(ext, '') AS ext, coalesce(txt, '') AS txt, mtime FROM txt_files)"
_FF = "chr(10) || chr(10)"
SQL = {
    "inbox_rows": f"""SELECT '/in/' || file_id || '.' || upper(ext) AS path, file_id::VARCHAR AS stem, ext, octet_length(encode(txt)) AS size, file_id || '.' || upper(ext) || ':' || octet_length(encode(txt)) || ':' || substring(sha1(txt), 1, 12) AS token,
        CASE WHEN ext = 'docx' THEN '' WHEN ext IN ('txt', 'md') THEN CASE WHEN {S.strip('txt')} = '' THEN 'empty' ELSE '' END ELSE 'unsupported' END AS error FROM {_F} WHERE ext IN ('pdf', 'docx', 'hwp', 'hwpx', 'txt', 'md')""",
    "ole_files": f"SELECT file_id, file_id % 3 = 0 AS old FROM {_F}",
    "converted_texts": f"SELECT file_id, md5({S.strip(f'regexp_replace(txt, {S.q(chr(10))} || {S.q("{3,}")}, {_FF}, {S.q("g")})')}) AS text FROM {_F}",
    "sniffed": f"SELECT file_id, CASE WHEN length(txt) * 1000 > 26214400 THEN 'too_large' WHEN file_id % 5 IN (0, 3) THEN 'pdf' WHEN file_id % 5 = 1 THEN 'text' WHEN file_id % 5 = 2 THEN 'html' ELSE 'unsupported' END AS kind FROM {_F}",
    "paper_precedence": "SELECT paper_id, CASE WHEN paper_id % 5 = 0 THEN CASE WHEN paper_id % 2 = 0 THEN 'arxiv' ELSE '' END WHEN paper_id % 5 IN (1, 2, 3) THEN 'crossref' ELSE '' END AS title FROM (SELECT DISTINCT paper_id FROM papermeta)",
    "arxiv_entries": f"SELECT paper_id, {S.squeeze('t')} AS title, 'A. B, C D' AS author, 'arXiv' AS publisher FROM (SELECT DISTINCT paper_id, coalesce(title, '') AS t, published_date FROM papermeta)",
    "crossref_dates": "SELECT paper_id, CASE paper_id % 4 WHEN 0 THEN '2001-' WHEN 1 THEN '2002-' WHEN 2 THEN '2003-' ELSE '' END || CASE WHEN paper_id % 4 < 3 THEN lpad((paper_id % 12 + 1)::VARCHAR, 2, '0') ELSE '' END AS day, 'A ' || paper_id || ', B' AS author FROM (SELECT DISTINCT paper_id FROM papermeta)",
    "sidecars": "SELECT DISTINCT paper_id, coalesce(title, '') AS title, coalesce(author, '') AS author, coalesce(published_date, '') AS published_date, coalesce(publisher, '') AS publisher FROM papermeta",
    "pdf_info": f"SELECT file_id, strftime(max(mtime), '%Y-%m-%d') AS source_created, strftime(max(mtime), '%Y') AS source_modified FROM {_F} GROUP BY file_id",
    "book_roots": f"SELECT stem, coalesce(min('new/' || file_id) FILTER (file_id % 3 = 0), min('old/' || file_id)) AS path FROM {_F} WHERE stem <> '' GROUP BY stem",
    "split_parts": f"SELECT chapter_id, coalesce(pdf, '') AS pdf FROM (SELECT DISTINCT chapter_id, stem, chapter_no FROM chapters WHERE stem IS NOT NULL) LEFT JOIN (SELECT stem, min('pdf/' || file_id) AS pdf FROM {_F} WHERE ext = 'pdf' GROUP BY stem) USING (stem) WHERE chapter_id % 4 <> 0",
    "block_counts": "SELECT chapter_id, count(DISTINCT pair_id) AS n_blocks FROM translate_pairs GROUP BY chapter_id",
    "shrinking": "SELECT chapter_id, count(*) AS n_old, count(*) FILTER (status = 'translated') AS n_new FROM (SELECT DISTINCT chapter_id, pair_id, status FROM translate_pairs) WHERE chapter_id IS NOT NULL GROUP BY chapter_id HAVING count(*) FILTER (status = 'translated') < count(*)",
    "language_files": f"""WITH p AS (SELECT DISTINCT chapter_id, idx, pair_id, {S.strip("coalesce(src, '')")} AS s, CASE WHEN pair_id % 10 = 0 THEN '' ELSE {S.strip("coalesce(out, '')")} END AS o FROM translate_pairs WHERE NOT starts_with(coalesce(out, ''), '(원문 보존') OR true)
        SELECT chapter_id, md5(coalesce(string_agg(s, {_FF} ORDER BY idx, pair_id) FILTER (s <> ''), '')) AS en, md5(coalesce(string_agg(o, {_FF} ORDER BY idx, pair_id) FILTER (o <> '' AND NOT starts_with(o, '(원문 보존')), '')) AS ko FROM p GROUP BY chapter_id""",
    "autostart": f"""SELECT stem AS item, min(chapter_id) AS seq FROM chapters WHERE stem IS NOT NULL AND NOT regexp_matches(stem, '{T.HANGUL_WIDE}') AND stem IN (SELECT stem FROM chapters WHERE mode <> 'single' AND chapter_id % 2 = 0) GROUP BY stem""",
    "failures": """WITH p AS (SELECT DISTINCT pair_id, status FROM translate_pairs), b AS (SELECT * FROM p WHERE coalesce(status, 'failed') = 'failed') SELECT pair_id, 'done' AS stage FROM p WHERE status <> 'failed'
        UNION ALL SELECT pair_id, 'tab4_failed' FROM b UNION ALL SELECT pair_id, 'tab3_ready' FROM b WHERE pair_id % 2 = 0""",
    "processed_stems": f"SELECT nfc_normalize(stem) AS stem FROM (SELECT stem FROM {_F} WHERE ext IN ('pdf', 'txt', 'md', 'docx', 'doc') UNION SELECT stem FROM wiki_notes WHERE stem IS NOT NULL) WHERE stem <> '' GROUP BY 1",
    "file_counts": f"SELECT ext, count(*) AS n FROM {_F} WHERE ext IN ('pdf', 'txt') AND file_id % 5 <> 0 AND NOT suffix(stem, '_ko') AND NOT suffix(stem, '_wiki') GROUP BY ext",
    "interface_texts": "WITH c AS (SELECT DISTINCT chapter_id, title AS t FROM chapters WHERE title IS NOT NULL), w AS (SELECT t, min('t' || chapter_id) AS s FROM c WHERE chapter_id % 2 = 0 GROUP BY t) SELECT chapter_id, coalesce(s, t) AS shown FROM c LEFT JOIN w USING (t)",
    "engines": f"""WITH m AS (SELECT DISTINCT model FROM wiki_notes WHERE model IS NOT NULL), p AS (SELECT unnest([{', '.join(S.q(x) for x in C.PROVIDER_ORDER)}]) AS provider)
        SELECT provider || ':' || model AS engine, upper(provider) || ' · ' || model AS label, provider IN ('openai', 'claude_cli') AS available, provider = 'openai' AND model = (SELECT min(model) FROM m) AS picked FROM p, m""",
    "capped_inputs": f"SELECT file_id, least(500000, ([1900000, 400000, 140000, 140000, 400000, 400000])[file_id % 6 + 1]) AS n FROM {_F}",
    "prompts": f"""SELECT pair_id, md5('Translate the following academic paragraph into Korean. Preserve numbering. Output ONLY the Korean text.' || {_FF} || src) AS prompt, regexp_matches(src, '(?i)^\\s*(\\d+(\\.\\d+)*|[IVXLC]+)\\s+[^\\n]+') AS heading FROM (SELECT DISTINCT pair_id, src FROM translate_pairs WHERE src IS NOT NULL)""",
    "note_paths": "SELECT DISTINCT 'file:/wiki/sub/' || note_id || '.md' AS path FROM wiki_notes WHERE note_id % 5 IN (3, 4)",
    "vault_registry": "SELECT DISTINCT '/v/' || note_id AS path, note_id AS ts FROM wiki_notes WHERE stem IS NOT NULL",
    "last_log_lines": f"SELECT '[' || strftime(mtime, '%Y-%m-%d %H:%M:%S') || '] file ' || file_id AS line FROM {_F} WHERE file_id % 9 <> 0 ORDER BY strftime(mtime, '%Y-%m-%d %H:%M:%S') DESC, line DESC LIMIT 20",
    "bookmark_levels": f"""WITH c AS (SELECT DISTINCT file_id, chapter_id, coalesce(title, ' ') AS t, chapter_no % 2 AS level FROM chapters WHERE file_id IS NOT NULL), u AS (SELECT *, min(level) OVER (PARTITION BY file_id) AS low FROM c WHERE {S.strip('t')} <> ''),
        v AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM u WHERE level = low) SELECT file_id, chapter_id FROM v WHERE n >= 3""",
    "raw_texts": f"""WITH {_LINES}, {_KEPT}, by_page AS (SELECT file_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS t FROM kept GROUP BY file_id, page_no),
        books AS (SELECT file_id, string_agg(t, chr(10) ORDER BY page_no) AS body FROM by_page GROUP BY file_id), done AS (SELECT file_id, {_REFLOW} AS text FROM books) SELECT file_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text FROM done""",
    "glyph_kinds": """WITH c AS (SELECT DISTINCT unnest(string_split(txt || chr(65534) || chr(65535) || chr(9) || chr(13) || chr(7) || chr(160) || chr(8195) || chr(8203), '')) AS ch FROM txt_pages WHERE txt IS NOT NULL)
        SELECT CASE WHEN ch IN (chr(65534), chr(65535)) THEN 'broken' WHEN regexp_matches(ch, '\\pC') THEN 'drop' WHEN regexp_matches(ch, '\\pZ') THEN 'space' ELSE 'real' END AS kind, count(*) AS n_chars FROM c GROUP BY 1""",
    "written_chapters": """SELECT chapter_id, md5(body || CASE WHEN length(stem) % 2 = 0 THEN '!' ELSE '' END) AS body, CASE WHEN stem LIKE 'a%' THEN 2 ELSE 1 END::BIGINT AS n_marks FROM (SELECT DISTINCT stem, chapter_no, chapter_id, coalesce(body, '') AS body FROM chapters WHERE stem IS NOT NULL)""",
    "noted_categories": f"SELECT category, count(*) AS n, CAST(sum(length(note)) AS BIGINT) AS n_chars FROM (SELECT DISTINCT note_id, coalesce(nullif({S.strip('category')}, ''), '기타') AS category, coalesce(body, '') AS note FROM wiki_notes) GROUP BY category",
}
