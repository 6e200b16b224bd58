"""Queries of the model stages with offline models, whose answers SQL can state too."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import books as B
from folioforge.operators.model import OfflineModel, RateLimited, summarise, translate_chapters, with_waits
from folioforge.plans import sqltext as S
from folioforge.plans.text_queries import AUTHOR, _filename
from folioforge.session import table

DAY = "2020-01-01"


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").select("chapter_id", "body").distinct()


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of all chapters; blank ones fail."""
    return summarise(_bodies(spark, d), "chapter_id", "body", OfflineModel()).select("chapter_id", "status", F.md5("summary").alias("summary"), F.md5("body").alias("body"))


class Quoter:
    """A model that quotes the head of a text, and what stands nowhere."""

    def complete(self, system: str, prompt: str, max_tokens: int) -> str:
        head = " ".join(prompt.replace("|", " ").split())[:40].strip()
        return json.dumps({"summary": "s", "body": f"## 핵심 요약\n\nx\n\n## 핵심 인용\n\n| 주제 | 인용 |\n|---|---|\n| a | {head} |\n| b | an invented sentence that is long |"}, ensure_ascii=False)


def cited_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Chapters' summaries with the quotations that are real, of a model that invents one of two."""
    return B.cited_summaries(_bodies(spark, d), "chapter_id", "body", Quoter(), 3).select("chapter_id", "status", F.coalesce("n_cites", F.lit(0)).cast("long").alias("n_cites"), F.coalesce(F.col("body").contains("invented"), F.lit(False)).alias("invented"))


class BusyModel(OfflineModel):
    """Asks to wait for every second prompt, until it has waited."""

    def __init__(self, waited: bool = False) -> None:
        self.waited = waited

    def complete(self, system: str, prompt: str, max_tokens: int = 4096) -> str | None:
        if not self.waited and len(prompt) % 2:
            raise RateLimited
        return super().complete(system, prompt, max_tokens)


def limited_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The same from a provider that asks to wait: rows that were limited are asked for again, the others aren't."""
    model = BusyModel()
    got = with_waits(lambda df: summarise(df, "chapter_id", "body", BusyModel(model.waited)), _bodies(spark, d), "chapter_id", lambda _: setattr(model, "waited", True))
    return got.select("chapter_id", "status", F.md5("summary").alias("summary"))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "wiki_notes").select("stem", "note_id", "chapter", "summary").distinct().filter("stem is not null")
    texts = table(spark, d, "txt_files").select("stem", "txt").filter("stem is not null")
    return B.overview_prompts(notes, texts, "stem", "note_id", "chapter", "summary", "txt")


def overview_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model is asked for each book's overview."""
    return _prompts(spark, d).select("stem", F.md5("prompt").alias("prompt"))


def overviews(spark: SparkSession, d: str) -> DataFrame:
    """Overview files of all books, read back."""
    o = B.parse_overview(F.col("file"))
    got = B.overviews(_prompts(spark, d), "stem", OfflineModel(), "offline", DAY)
    return got.select("stem", "status", o["category"].alias("category"), o["author"].alias("author"), F.md5(o["summary"]).alias("summary"), F.md5(o["intro"]).alias("intro"), o["model"].alias("model"))


def book_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes of all whole files."""
    f = table(spark, d, "txt_files").select("stem", "txt").distinct()
    got = B.book_notes(f, "stem", "txt", OfflineModel(), "offline", DAY)
    return got.select("stem", "status", "category", "filename", F.md5("note").alias("note"), F.col("n_cites").cast("long").alias("n_cites"))


class Rewriter:
    """A model that gives a note's body back with keywords."""

    def complete(self, system: str, prompt: str, max_tokens: int) -> str:
        body = prompt[prompt.find("\n---", 4) + 4 :].strip()
        return json.dumps({"body": body + "\n\n## 핵심 키워드\nold", "keywords": "#a\nnone\n #b", "author": " A B "}, ensure_ascii=False)


def _front(key: Column, model: Column) -> Column:
    """Front matter of test notes: none for every seventh, already rewritten for every eleventh."""
    return F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("---\ntitle: x\nmodel: "), F.coalesce(model, F.lit("")), F.when(key % 11 == 0, "\nrefined: y").otherwise(""), F.lit("\n---\n")))


def _old_notes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "wiki_notes").select("note_id", "stem", "model", "body").distinct()
    return n.select("note_id", "stem", F.concat(_front(F.col("note_id"), F.col("model")), F.repeat(F.concat(F.coalesce("body", F.lit("")), F.lit("\n")), 3)).alias("text"))


def rewritten_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes written anew, with why the others stay."""
    got = B.rewritten_notes(_old_notes(spark, d), "note_id", "stem", "text", Rewriter(), "offline", DAY)
    return got.select("note_id", "outcome", F.md5("note").alias("note"))


def rewrite_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many notes have each outcome."""
    return B.rewritten_notes(_old_notes(spark, d), "note_id", "stem", "text", Rewriter(), "offline", DAY).groupBy("outcome").agg(F.count("*").alias("n"))


def offline_translation(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph states after an offline run: stored answers are kept, failed and new ones asked again."""
    p = table(spark, d, "translate_pairs").select("chapter_id", F.col("idx").cast("long").alias("idx"), "src", "out", "status").distinct().filter("src is not null and chapter_id is not null")
    state = p.select("chapter_id", "idx", "src", F.col("out").alias("tgt"), "status")
    new = translate_chapters(p.select("chapter_id", "idx", "src"), state, OfflineModel())
    return new.select("chapter_id", "idx", "status", F.md5(F.coalesce("tgt", F.lit(""))).alias("tgt"))


QUERIES = {f.__name__: f for f in (summaries, limited_summaries, cited_summaries, overview_prompts, overviews, book_notes, rewritten_notes, rewrite_outcomes, offline_translation)}


def _last(p: str) -> str:
    """The last paragraph of a prompt."""
    return S.strip(f"list_extract(string_split({p}, chr(10) || chr(10)), -1)")


def _sentences(t: str) -> str:
    return f"list_filter(string_split(regexp_replace({t}, {S.q(f'([.!?。]){T.WS}+')}, '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '')"


_FRONT = "CASE WHEN note_id % 7 = 0 THEN '' ELSE 'title: x' || chr(10) || 'model: ' || coalesce(model, '') || CASE WHEN note_id % 11 = 0 THEN chr(10) || 'refined: y' ELSE '' END END"
_REWRITTEN = f"""n AS (SELECT note_id, coalesce(stem, '') AS stem, {_FRONT} AS fm, repeat(coalesce(body, '') || chr(10), 3) AS body FROM (SELECT DISTINCT note_id, stem, model, body FROM wiki_notes)),
    a AS (SELECT *, {S.strip('body')} || chr(10) || chr(10) || '## 핵심 키워드' || chr(10) || 'old' AS new FROM n),
    r AS (SELECT *, CASE WHEN note_id % 7 = 0 THEN 'not_pipeline' WHEN note_id % 11 = 0 THEN 'already_done' WHEN NOT contains(body, '## 핵심 요약') AND NOT contains(body, '## 주요 내용') THEN 'not_summary' WHEN contains(stem, '_번역') OR length(body) + 1 > 35000 THEN 'full_text'
        WHEN length({S.strip('body')}) < 800 THEN 'thin' WHEN length(new) >= greatest(600, floor(length({S.strip('body')}) * 0.6)) AND contains(new, '## ') THEN 'done' ELSE 'too_short' END AS outcome FROM a)"""
_PROMPT = f"""l AS (SELECT stem, string_agg(line, chr(10) ORDER BY note_id, line) AS listed FROM (SELECT stem, note_id, note_id || '. ' || coalesce(chapter, '') || ': ' || summary AS line FROM (SELECT DISTINCT stem, note_id, chapter, summary FROM wiki_notes WHERE stem IS NOT NULL) WHERE {S.strip("coalesce(summary, '')")} <> '') GROUP BY stem),
    e AS (SELECT stem, arg_max(substring(txt, 1, 3500) || chr(10) || '…' || chr(10) || right(txt, 1500), (length(txt), substring(txt, 1, 3500))) AS ends FROM txt_files WHERE stem IS NOT NULL AND txt IS NOT NULL GROUP BY stem),
    p AS (SELECT stem, concat_ws(chr(10) || chr(10), listed, {S.strip('ends')}) AS prompt FROM l LEFT JOIN e USING (stem))"""
_DROP = f"({S.strip('src')} = '' OR (length({S.strip('src')}) <= {T.DROP_CHARS} AND regexp_matches({S.strip('src')}, {S.q(T.NUMBER_ONLY)})))"
_SKIP = "(" + " OR ".join([f"{S.strip('src')} = ''", *(f"regexp_matches({S.strip('src')}, {S.q(x)})" for x in (T.DAGGER, T.NUMBERED_CITATION, T.BULLET_CITATION)), *(f"(length({S.strip('src')}) < {T.SHORT_CITATION} AND regexp_matches({S.strip('src')}, {S.q(x)}))" for x in (T.FOOTNOTE_START, T.CITED_URL))]) + ")"
_ECHO = f"'번역: ' || array_to_string(list_transform({S.tokens(_last('src'))}, lambda w: repeat(substring('가나다라마바사아자차카타파하', CAST(list_sum(list_transform(string_split(w, ''), lambda c: ord(c))) % 14 + 1 AS INTEGER), 1), greatest(1, length(w) // 2))), ' ')"
_QUOTE = S.strip(f"substring({S.squeeze("replace(body, '|', ' ')")}, 1, 40)")
_BARE = S.sub(S.sub(S.sub("q", r"\([^)]*\)"), f"{T.WS}+"), "^[\"“”‘’ ]+|[\"“”‘’ ]+$")
SQL = {
    "cited_summaries": f"""SELECT chapter_id, CASE WHEN {S.strip("coalesce(body, '')")} = '' THEN 'failed' ELSE 'done' END AS status, CAST(coalesce({S.strip('body')} <> '' AND length({_BARE}) >= 10 AND NOT contains(q, '---') AND contains({S.sub('body', f'{T.WS}+')}, {_BARE}), false) AS BIGINT) AS n_cites,
        false AS invented FROM (SELECT *, {_QUOTE} AS q FROM (SELECT DISTINCT chapter_id, body FROM chapters))""",
    "summaries": f"""WITH c AS (SELECT chapter_id, {_last("coalesce(body, '')")} AS t FROM (SELECT DISTINCT chapter_id, body FROM chapters)), s AS (SELECT chapter_id, t, {_sentences('t')} AS s FROM c)
        SELECT chapter_id, CASE WHEN t = '' THEN 'failed' ELSE 'done' END AS status, CASE WHEN t <> '' THEN md5(substring(array_to_string(s[1:2], ' '), 1, 300)) END AS summary, CASE WHEN t <> '' THEN md5('## 핵심 요약' || chr(10) || chr(10) || array_to_string(s[1:5], ' ')) END AS body FROM s""",
    "limited_summaries": f"""WITH c AS (SELECT chapter_id, {_last("coalesce(body, '')")} AS t FROM (SELECT DISTINCT chapter_id, body FROM chapters)), s AS (SELECT chapter_id, t, {_sentences('t')} AS s FROM c)
        SELECT chapter_id, CASE WHEN t = '' THEN 'failed' ELSE 'done' END AS status, CASE WHEN t <> '' THEN md5(substring(array_to_string(s[1:2], ' '), 1, 300)) END AS summary FROM s""",
    "overview_prompts": f"WITH {_PROMPT} SELECT stem, md5(prompt) AS prompt FROM p",
    "overviews": f"""WITH {_PROMPT}, s AS (SELECT stem, {_sentences(_last('prompt'))} AS s FROM p)
        SELECT stem, 'done' AS status, '기타' AS category, {AUTHOR} AS author, md5({S.squeeze("substring(array_to_string(s[1:2], ' '), 1, 300)")}) AS summary, md5({S.strip("array_to_string(s[1:3], ' ')")}) AS intro, 'offline' AS model FROM s""",
    "book_notes": f"""WITH f AS (SELECT stem, {_sentences(_last('txt'))} AS s FROM (SELECT DISTINCT stem, txt FROM txt_files) WHERE {S.strip("coalesce(txt, '')")} <> '')
        SELECT stem, 'done' AS status, '기타' AS category, {_filename('stem')} AS filename, md5('---' || chr(10) || 'title: ' || stem || chr(10) || 'summary: ' || {S.strip("substring(array_to_string(s[1:2], ' '), 1, 300)")} || chr(10) || 'tags: ["mill"]' || chr(10) || 'source: ' || stem || '.txt' || chr(10) || 'model: offline' || chr(10) || 'generated: {DAY}' || chr(10) || '---' || chr(10) || chr(10)
            || '# ' || stem || chr(10) || chr(10) || '## 핵심 요약' || chr(10) || chr(10) || {S.strip("array_to_string(s[1:5], ' ')")} || chr(10) || chr(10) || '## 핵심 인용' || chr(10) || chr(10) || '| 주제 | 원문 인용(대조 검증) |' || chr(10) || '|---|---|' || chr(10) || '| (원문 확인된 직접 인용 없음) | |' || chr(10) || chr(10) || '## sources' || chr(10) || '- `' || stem || '.txt`' || chr(10)) AS note, CAST(0 AS BIGINT) AS n_cites FROM f""",
    "rewritten_notes": f"""WITH {_REWRITTEN} SELECT note_id, outcome, CASE WHEN outcome = 'done' THEN md5('---' || chr(10) || fm || chr(10) || 'author: A B' || chr(10) || 'refined: offline ({DAY})' || chr(10) || '---' || chr(10) || chr(10)
        || regexp_replace(regexp_replace(new, '(?s)\\n## 핵심 키워드\\n.*$', ''), '\\s+$', '') || chr(10) || chr(10) || '## 핵심 키워드' || chr(10) || '#a' || chr(10) || '#b' || chr(10)) END AS note FROM r""",
    "rewrite_outcomes": f"WITH {_REWRITTEN} SELECT outcome, count(*) AS n FROM r GROUP BY outcome",
    "offline_translation": f"""WITH p AS (SELECT DISTINCT chapter_id, CAST(idx AS BIGINT) AS idx, src, out, status FROM translate_pairs WHERE src IS NOT NULL AND chapter_id IS NOT NULL)
        SELECT chapter_id, idx, CASE WHEN status <> 'failed' THEN status WHEN {_DROP} THEN 'dropped' WHEN {_SKIP} THEN 'preserved' ELSE 'translated' END AS status,
            md5(coalesce(CASE WHEN status <> 'failed' THEN out WHEN {_DROP} THEN '' WHEN {_SKIP} THEN src ELSE {_ECHO} END, '')) AS tgt FROM p""",
}
