"""Queries of joins, aggregates, sets and queues over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.functions import text as T
from folioforge.functions.biblio import upload_token
from folioforge.operators import matching as M
from folioforge.operators import stages as Q
from folioforge.operators.model import validity
from folioforge.plans import sqltext as S
from folioforge.plans.text_queries import _asks, _filename, _key
from folioforge.session import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "txt_files").select("file_id", "stem", "ext", F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"), "mtime", F.coalesce(F.length("txt"), F.lit(0)).alias("n_chars")).distinct()


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").select("chapter_id", "file_id", "stem", "chapter_no", "title", "mode", "start_pos", F.coalesce(F.length("body"), F.lit(0)).alias("n_chars")).distinct()


def pending_anti(spark: SparkSession, d: str) -> DataFrame:
    """Files without a stored chapter, and those whose note's file name is missing, smallest first."""
    f, c = _files(spark, d), _chapters(spark, d)
    left = M.pending(f.select("file_id", "stem", "size_bytes"), c, ["file_id"], "size_bytes")
    notes = table(spark, d, "wiki_notes").select(T.note_filename(F.col("stem")).alias("file")).distinct()
    missing = M.without_note(left, notes, "stem", "file").select("file_id", F.lit(True).alias("no_note"))
    return left.join(missing, "file_id", "left").select("file_id", "size_bytes", F.coalesce("no_note", F.lit(False)).alias("no_note"))


def known_inbox(spark: SparkSession, d: str) -> DataFrame:
    """Papers whose file is or isn't among the converted ones, by stem."""
    p = table(spark, d, "papermeta").select("paper_id", "stem").distinct()
    return M.split_known(p, _chapters(spark, d).select("stem"), "stem").select("paper_id", "known")


def orphan_audit(spark: SparkSession, d: str) -> DataFrame:
    return M.orphan_audit(_files(spark, d), _chapters(spark, d), table(spark, d, "wiki_notes").filter("summary is not null"), "stem")


def queue_plan(spark: SparkSession, d: str) -> DataFrame:
    queued = table(spark, d, "papermeta").select("stem").filter("stem is not null")
    done = _chapters(spark, d).filter("mode <> 'single'")
    return M.queue_plan(queued, _files(spark, d).filter("stem is not null"), done, "stem", "n_chars", 800)


def source_index(spark: SparkSession, d: str) -> DataFrame:
    """The first file of each entity key."""
    return M.first_by_key(_files(spark, d), "stem", "file_id")


def entity_links(spark: SparkSession, d: str) -> DataFrame:
    """Notes linked to files: their stem with every third one damaged, then their chapter's title."""
    n = table(spark, d, "wiki_notes").select("note_id", "stem", "chapter").distinct().filter("stem is not null")
    typed = F.when(F.col("note_id") % 3 == 0, F.concat(F.substring("stem", 1, 3), F.lit("q"), F.substring(F.col("stem"), F.lit(4), F.length("stem")))).otherwise(F.col("stem"))
    cand = F.array(T.entity_key(typed), T.entity_key(F.coalesce("chapter", F.lit(""))))
    keys = _files(spark, d).select(T.entity_key(F.col("stem")).alias("key"))
    return M.link_entities(n.select("note_id", cand.alias("c")), keys, "note_id", "c", "key")


def exact_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of ``entity_links`` that need no likeness."""
    return entity_links(spark, d).filter("how = 'exact'").select("note_id", "key")


def preferred_text(spark: SparkSession, d: str) -> DataFrame:
    """Each chapter's text to summarise: the translated paragraphs, else its body."""
    c = table(spark, d, "chapters").select("chapter_id", "body").distinct()
    p = table(spark, d, "translate_pairs").select("chapter_id", "idx", "out", "status").distinct().filter("status = 'translated' and out is not null")
    ko = p.groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "out"))), lambda x: x["out"]), "\n\n").alias("ko"))
    both = M.prefer(c.select("chapter_id"), ["chapter_id"], [(ko, "ko"), (c, "body")], "text")
    return both.select("chapter_id", F.md5("text").alias("text"))


def translation_cache(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "translate_pairs").select("stem", "pair_id", "src", F.col("out").alias("tgt")).distinct()
    c = M.translation_cache(b, ["stem", "pair_id"])
    return c.select(F.md5("src").alias("src"), F.md5("tgt").alias("tgt"))


def best_translation(spark: SparkSession, d: str) -> DataFrame:
    """Of each stem the chapter with the most translated paragraphs."""
    p = table(spark, d, "translate_pairs").select("stem", "chapter_id", "pair_id", "status").distinct().filter("stem is not null")
    n = p.groupBy("stem", "chapter_id").agg(F.count_if(F.col("status") == "translated").alias("n"))
    return M.best_by_count(n, "stem", "chapter_id", "n")


def refresh_list(spark: SparkSession, d: str) -> DataFrame:
    """Chaptered books that have a note (refresh) or not (new), with their progress."""
    return M.refresh_list(_chapters(spark, d), table(spark, d, "wiki_notes").filter("summary is not null"), "stem", "chapter_id")


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Quotations cut from chapters, every other one changed, held against their chapter."""
    c = table(spark, d, "chapters").select("chapter_id", "body").distinct().filter("body is not null")
    quote = F.concat(F.lit("“"), F.substring("body", 20, 60), F.when(F.col("chapter_id") % 2 == 0, "").otherwise("☂"), F.lit("”"))
    return M.verify_citations(c.select("chapter_id", quote.alias("quote")), c, "chapter_id", "quote", "body").select("chapter_id", "verified")


def metadata_override(spark: SparkSession, d: str) -> DataFrame:
    """Files' author and date: the sidecar's before what notes say."""
    f = _files(spark, d).select("file_id").distinct()
    side = table(spark, d, "papermeta").groupBy("file_id").agg(F.min(F.nullif(T.strip(F.col("author")), F.lit(""))).alias("author"), F.min(F.nullif(T.strip(F.col("published_date")), F.lit(""))).alias("day"))
    notes = table(spark, d, "wiki_notes").join(_chapters(spark, d).select("chapter_id", "file_id"), "chapter_id").groupBy("file_id").agg(F.min(F.nullif(T.strip(F.col("author")), F.lit(""))).alias("guess"))
    j = f.join(side, "file_id", "left").join(notes, "file_id", "left")
    return j.select("file_id", F.coalesce(M.override(F.col("guess"), F.col("author")), F.lit("")).alias("author"), F.coalesce("day", F.lit("")).alias("day"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "translate_pairs").select("chapter_id", "pair_id", "status").distinct()
    return Q.status_counts(p, "chapter_id")


def stage_counters(spark: SparkSession, d: str) -> DataFrame:
    """Originals, translated files and summarised stems in one row; translated files are those with a translated paragraph."""
    f = _files(spark, d).agg(F.count("*").alias("n_files"), F.count_if(F.col("ext") == "pdf").alias("n_pdf"))
    t = table(spark, d, "translate_pairs").filter("status = 'translated'").agg(F.count_distinct("stem").alias("n_translated"))
    s = table(spark, d, "wiki_notes").filter("summary is not null").agg(F.count_distinct("stem").alias("n_summarised"))
    names = ("n_files", "n_pdf", "n_translated", "n_summarised")
    every = f.unionByName(t, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)
    return every.agg(*[F.max(c).alias(c) for c in names])


def medians(spark: SparkSession, d: str) -> DataFrame:
    """The two medians of chapter lengths by mode, the mean of the middles and the upper one, and the mean.

    Lengths are counted first: a mode's different lengths are few, and the ranks run over
    them as a window's sums, so no task holds all of a mode's chapters.
    """
    n = _chapters(spark, d).groupBy("mode", "n_chars").agg(F.count("*").alias("n"))
    w = W.partitionBy("mode")
    n = n.withColumn("upto", F.sum("n").over(w.orderBy("n_chars"))).withColumn("every", F.sum("n").over(w)).withColumn("sum", F.sum(F.col("n") * F.col("n_chars")).over(w))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("n_chars")))
    low, up = F.floor((F.col("every") - 1) / 2), F.floor(F.col("every") / 2)
    return n.groupBy("mode").agg(((at(low) + at(up)) / 2).cast("double").alias("middle"), at(up).cast("long").alias("upper"), F.round(F.max(F.col("sum") / F.col("every")), 6).alias("mean"))


def chapter_nav(spark: SparkSession, d: str) -> DataFrame:
    from folioforge.operators.notes import neighbours

    c = _chapters(spark, d).select("chapter_id", "stem", "chapter_no", F.coalesce("title", F.lit("")).alias("title"))
    return neighbours(c, "stem", "chapter_no", "title").select("chapter_id", "prev_title", "next_title")


def work_order(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest and the ten smallest files of each kind: two top-k reports."""
    f = _files(spark, d).select("file_id", "ext", "mtime", "size_bytes")

    def top(name: str, *order) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("ext").orderBy(*order, "file_id"))
        return f.withColumn("place", rank).filter("place <= 10").select(F.lit(name).alias("list"), "ext", F.col("place").cast("long").alias("place"), "file_id")

    return top("newest", F.desc("mtime")).unionByName(top("smallest", F.col("size_bytes")))


def name_search(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).filter(F.lower("stem").contains("of the")).select("file_id", "stem")


def queue_ops(spark: SparkSession, d: str) -> DataFrame:
    """A queue of chapters after adding all, removing failed ones, clearing one stage and dropping ghosts."""
    c = _chapters(spark, d).filter("stem is not null").select(Q.route(F.col("stem")).alias("stage"), F.col("stem").alias("item"), F.col("chapter_id").alias("seq"))
    start = _chapters(spark, d).filter("stem is not null and mode <> 'single'").select(Q.route(F.col("stem")).alias("stage"), F.col("stem").alias("item"), F.col("chapter_id").alias("seq"))
    queue = Q.queue_add(start, c)
    failed = table(spark, d, "translate_pairs").filter("status = 'failed' and engine is null").select(F.lit("tab3_ready").alias("stage"), F.col("stem").alias("item"))
    queue = Q.without_ghosts(Q.queue_remove(queue, failed), _files(spark, d).select(F.col("stem").alias("item")))
    return queue.unionByName(Q.queue_clear(queue.withColumn("stage", F.concat("stage", F.lit("_copy"))), "tab4_ready_copy"))


def first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Different titles in order of first chapter, and chapters' keys made different by a number."""
    c = _chapters(spark, d).filter("title is not null")
    first = Q.first_seen(c, "title", "chapter_id").withColumnRenamed("chapter_id", "first_id")
    return Q.disambiguated(c, "title", "chapter_id").join(first, "title").select("chapter_id", "widget_key", "first_id")


def upload_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Delivered files without those whose name, length and content are the same."""
    f = table(spark, d, "txt_files").select("file_id", "stem", F.coalesce("txt", F.lit("")).alias("t"))
    return f.groupBy(upload_token(F.coalesce("stem", F.lit("")), F.col("t")).alias("token")).agg(F.min("file_id").alias("file_id"), F.count("*").alias("n"))


def note_stats(spark: SparkSession, d: str) -> DataFrame:
    from folioforge.operators.notes import accept_rewrite, classify_note

    n = table(spark, d, "wiki_notes").select("note_id", "stem", "model", "body").distinct()
    body = F.repeat(F.concat(F.coalesce("body", F.lit("")), F.lit("\n")), 3)
    fm = F.when(F.col("note_id") % 7 == 0, "").otherwise(F.concat(F.lit("---\ntitle: x\nmodel: "), F.coalesce("model", F.lit("")), F.when(F.col("note_id") % 11 == 0, "\nrefined: y").otherwise(""), F.lit("\n---\n")))
    r = n.select(classify_note(F.concat(fm, body), F.coalesce("stem", F.lit(""))).alias("reason"), accept_rewrite(body, F.coalesce("body", F.lit(""))).alias("accepted"))
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))


def answer_validity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "translate_pairs").select("pair_id", "src", "out").distinct()
    return validity(p, ["pair_id"], "src", "out")


def answer_rules(spark: SparkSession, d: str) -> DataFrame:
    """What of an answer's validity needs no likeness: it isn't blank, doesn't ask for the text, has Hangul; such answers are all the valid ones among."""
    p = table(spark, d, "translate_pairs").select("pair_id", "src", "out").distinct()
    ruled = p.select("pair_id", M.ruled_answer(F.col("out")).alias("ruled"))
    return ruled.join(validity(p, ["pair_id"], "src", "out"), "pair_id").select("pair_id", "ruled", (F.col("valid") & ~F.col("ruled")).alias("against"))


def resume_states(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that have to be asked again: failed ones, and those whose source has changed."""
    p = table(spark, d, "translate_pairs").select("chapter_id", F.col("idx").cast("long").alias("idx"), "src", "status", "pair_id").distinct().filter("src is not null and chapter_id is not null")
    now = p.withColumn("src", F.when(F.col("pair_id") % 9 == 0, F.concat("src", F.lit("!"))).otherwise(F.col("src")))
    return Q.unfinished(now.select("chapter_id", "idx", "src"), p).groupBy("chapter_id").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        pending_anti, known_inbox, orphan_audit, queue_plan, source_index, entity_links, exact_links, preferred_text, translation_cache, best_translation, refresh_list, citation_check, metadata_override, status_counts, stage_counters, medians, chapter_nav, work_order,
        name_search, queue_ops, first_occurrences, upload_dedup, note_stats, answer_validity, answer_rules, resume_states,
    )
}

_F = "(SELECT DISTINCT file_id, stem, ext, coalesce(size_bytes, -1) AS size_bytes, mtime, coalesce(length(txt), 0) AS n_chars FROM txt_files)"
_C = "(SELECT DISTINCT chapter_id, file_id, stem, chapter_no, title, mode, start_pos, coalesce(length(body), 0) AS n_chars FROM chapters)"
_ROUTE = f"CASE WHEN NOT regexp_matches(stem, '{T.HANGUL_WIDE}') THEN 'tab3_ready' ELSE 'tab4_ready' END"
_DS = lambda x: S.sub(S.sub(S.sub(x, r"\([^)]*\)"), f"{T.WS}+"), "^[\"“”‘’ ]+|[\"“”‘’ ]+$")

SQL = {
    "pending_anti": f"SELECT file_id, size_bytes, NOT coalesce({_filename('stem')} IN (SELECT {_filename('stem')} FROM wiki_notes WHERE stem IS NOT NULL), false) AS no_note FROM (SELECT DISTINCT file_id, stem, size_bytes FROM {_F}) WHERE file_id NOT IN (SELECT file_id FROM chapters WHERE file_id IS NOT NULL)",
    "known_inbox": "SELECT paper_id, coalesce(stem IN (SELECT stem FROM chapters WHERE stem IS NOT NULL), false) AS known FROM (SELECT DISTINCT paper_id, stem FROM papermeta)",
    "orphan_audit": """SELECT count(*) AS n_stems, count(*) FILTER (NOT p) AS n_orphans, count(*) FILTER (NOT p AND n) AS n_noted, count(*) FILTER (NOT p AND NOT n) AS n_lost FROM (SELECT stem, coalesce(stem IN (SELECT stem FROM chapters WHERE stem IS NOT NULL), false) AS p,
        coalesce(stem IN (SELECT stem FROM wiki_notes WHERE summary IS NOT NULL AND stem IS NOT NULL), false) AS n FROM (SELECT DISTINCT stem FROM txt_files))""",
    "queue_plan": f"""WITH t AS (SELECT stem, max(n_chars) AS n FROM {_F} WHERE stem IS NOT NULL GROUP BY stem), q AS (SELECT DISTINCT stem FROM papermeta WHERE stem IS NOT NULL), c AS (SELECT DISTINCT stem FROM chapters WHERE mode <> 'single')
        SELECT coalesce(t.stem, q.stem) AS stem, CASE WHEN n IS NULL THEN 'missing' WHEN coalesce(t.stem, q.stem) IN (SELECT stem FROM c) THEN 'dup' WHEN n < 800 THEN 'short' ELSE 'pending' END AS state, q.stem IS NOT NULL AS queued FROM t FULL JOIN q ON t.stem = q.stem""",
    "source_index": f"SELECT k AS key, arg_min(stem, (file_id, stem)) AS stem, count(*) AS n_sources FROM (SELECT *, {_key('stem')} AS k FROM {_F}) WHERE k <> '' GROUP BY k",
    "exact_links": f"""WITH n AS (SELECT DISTINCT note_id, stem, chapter, CASE WHEN note_id % 3 = 0 THEN substring(stem, 1, 3) || 'q' || substring(stem, 4) ELSE stem END AS typed FROM wiki_notes WHERE stem IS NOT NULL), k AS (SELECT DISTINCT {_key('stem')} AS key FROM {_F} WHERE stem IS NOT NULL),
        c AS (SELECT note_id, 0 AS ord, {_key('typed')} AS cand FROM n UNION ALL SELECT note_id, 1, {_key("coalesce(chapter, '')")} FROM n) SELECT note_id, arg_min(key, ord) AS key FROM c JOIN k ON cand = key WHERE cand <> '' GROUP BY note_id""",
    "answer_rules": f"""SELECT pair_id, {S.squeeze("coalesce(out, '')")} <> '' AND NOT ({_asks}) AND {S.hangul(S.squeeze("coalesce(out, '')"))} >= 0.08 AS ruled, false AS against FROM (SELECT DISTINCT pair_id, src, out FROM translate_pairs)""",
    "preferred_text": """WITH k AS (SELECT chapter_id, string_agg(out, chr(10) || chr(10) ORDER BY idx, out) AS ko FROM (SELECT DISTINCT chapter_id, idx, out FROM translate_pairs WHERE status = 'translated' AND out IS NOT NULL) GROUP BY chapter_id)
        SELECT chapter_id, md5(coalesce(nullif(ko, ''), nullif(body, ''))) AS text FROM (SELECT DISTINCT chapter_id, body FROM chapters) LEFT JOIN k USING (chapter_id)""",
    "translation_cache": "SELECT md5(src) AS src, md5(arg_min(out, (stem, pair_id))) AS tgt FROM (SELECT DISTINCT stem, pair_id, src, out FROM translate_pairs WHERE src <> '' AND out <> '' AND NOT starts_with(out, '(원문 보존')) GROUP BY src",
    "best_translation": """SELECT stem, chapter_id, n FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, chapter_id) AS r FROM (SELECT stem, chapter_id, count(*) FILTER (status = 'translated') AS n FROM (SELECT DISTINCT stem, chapter_id, pair_id, status FROM translate_pairs WHERE stem IS NOT NULL) GROUP BY stem, chapter_id) WHERE n > 0) WHERE r = 1""",
    "refresh_list": """WITH c AS (SELECT stem, count(DISTINCT chapter_id) AS n_chapters FROM chapters WHERE stem IS NOT NULL GROUP BY stem), s AS (SELECT stem, count(DISTINCT chapter_id) AS n_done FROM wiki_notes WHERE summary IS NOT NULL GROUP BY stem)
        SELECT stem, n_chapters, coalesce(n_done, 0) AS n_done, CASE WHEN n_done IS NULL THEN 'new' ELSE 'refresh' END AS state FROM c LEFT JOIN s USING (stem)""",
    "citation_check": f"""SELECT chapter_id, length({_DS('quote')}) >= 10 AND contains({S.sub('body', f'{T.WS}+')}, {_DS('quote')}) AS verified FROM (SELECT chapter_id, body, '“' || substring(body, 20, 60) || CASE WHEN chapter_id % 2 = 0 THEN '' ELSE '☂' END || '”' AS quote FROM (SELECT DISTINCT chapter_id, body FROM chapters WHERE body IS NOT NULL))""",
    "metadata_override": f"""WITH s AS (SELECT file_id, min(nullif({S.strip('author')}, '')) AS author, min(nullif({S.strip('published_date')}, '')) AS day FROM papermeta GROUP BY file_id), n AS (SELECT file_id, min(nullif({S.strip('author')}, '')) AS guess FROM wiki_notes JOIN {_C} USING (chapter_id) GROUP BY file_id)
        SELECT file_id, coalesce(author, guess, '') AS author, coalesce(day, '') AS day FROM (SELECT DISTINCT file_id FROM txt_files) LEFT JOIN s USING (file_id) LEFT JOIN n USING (file_id)""",
    "status_counts": "SELECT chapter_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in Q.STATES) + ", count(*) AS n FROM (SELECT DISTINCT chapter_id, pair_id, status FROM translate_pairs) GROUP BY chapter_id",
    "stage_counters": f"""SELECT (SELECT count(*) FROM {_F}) AS n_files, (SELECT count(*) FROM {_F} WHERE ext = 'pdf') AS n_pdf, (SELECT count(DISTINCT stem) FROM translate_pairs WHERE status = 'translated') AS n_translated, (SELECT count(DISTINCT stem) FROM wiki_notes WHERE summary IS NOT NULL) AS n_summarised""",
    "medians": f"SELECT mode, quantile_cont(n_chars, 0.5)::DOUBLE AS middle, CAST((list_sort(list(n_chars)))[count(*) // 2 + 1] AS BIGINT) AS upper, round(avg(n_chars), 6) AS mean FROM {_C} GROUP BY mode",
    "chapter_nav": f"SELECT chapter_id, lag(t) OVER w AS prev_title, lead(t) OVER w AS next_title FROM (SELECT *, coalesce(title, '') AS t FROM {_C}) WINDOW w AS (PARTITION BY stem ORDER BY chapter_no)",
    "work_order": f"""SELECT 'newest' AS list, ext, place, file_id FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY mtime DESC, file_id) AS place FROM {_F}) WHERE place <= 10
        UNION ALL SELECT 'smallest', ext, place, file_id FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY size_bytes, file_id) AS place FROM {_F}) WHERE place <= 10""",
    "name_search": f"SELECT file_id, stem FROM {_F} WHERE contains(lower(stem), 'of the')",
    "queue_ops": f"""WITH c AS (SELECT {_ROUTE} AS stage, stem AS item, min(chapter_id) AS seq FROM chapters WHERE stem IS NOT NULL GROUP BY ALL),
        q AS (SELECT * FROM c WHERE NOT (stage = 'tab3_ready' AND item IN (SELECT stem FROM translate_pairs WHERE status = 'failed' AND engine IS NULL AND stem IS NOT NULL)) AND item IN (SELECT stem FROM txt_files))
        SELECT * FROM q UNION ALL SELECT stage || '_copy', item, seq FROM q WHERE stage <> 'tab4_ready'""",
    "first_occurrences": f"SELECT chapter_id, CASE WHEN r = 1 THEN title ELSE title || '__' || (r - 1) END AS widget_key, first_id FROM (SELECT chapter_id, title, row_number() OVER (PARTITION BY title ORDER BY chapter_id) AS r, min(chapter_id) OVER (PARTITION BY title) AS first_id FROM {_C} WHERE title IS NOT NULL)",
    "upload_dedup": "SELECT coalesce(stem, '') || ':' || length(t) || ':' || substring(sha1(t), 1, 12) AS token, min(file_id) AS file_id, count(*) AS n FROM (SELECT file_id, stem, coalesce(txt, '') AS t FROM txt_files) GROUP BY 1",
    "note_stats": f"""WITH n AS (SELECT note_id, coalesce(stem, '') AS stem, coalesce(body, '') AS b, repeat(coalesce(body, '') || chr(10), 3) AS body FROM (SELECT DISTINCT note_id, stem, model, body FROM wiki_notes)),
        r AS (SELECT CASE WHEN note_id % 7 = 0 THEN 'not_pipeline' WHEN note_id % 11 = 0 THEN 'already_done' WHEN NOT contains(body, '## 핵심 요약') AND NOT contains(body, '## 주요 내용') THEN 'not_summary' WHEN contains(stem, '_번역') OR length(body) + 1 > 35000 THEN 'full_text'
            WHEN length({S.strip('body')}) < 800 THEN 'thin' ELSE '' END AS reason, length({S.strip('b')}) >= greatest(600, floor(length({S.strip('body')}) * 0.6)) AND contains(b, '## ') AS accepted FROM n) SELECT reason, count(*) AS n, count(*) FILTER (accepted) AS n_accepted FROM r GROUP BY reason""",
    "resume_states": """WITH p AS (SELECT DISTINCT chapter_id, idx, src, status, pair_id FROM translate_pairs WHERE src IS NOT NULL AND chapter_id IS NOT NULL) SELECT chapter_id, count(*) AS n FROM p WHERE pair_id % 9 = 0 OR NOT EXISTS (SELECT 1 FROM p o WHERE o.chapter_id = p.chapter_id AND o.idx = p.idx AND o.src = p.src AND o.status <> 'failed') GROUP BY chapter_id""",
}
