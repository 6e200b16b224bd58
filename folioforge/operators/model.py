"""Model-backed stages behind a small interface, with an offline model that needs no network and always gives the same answer."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import difflib
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut_lineage

#: Share of Hangul and likeness to the source of a valid answer, characters compared, attempts and waits of calls.
VALID_RATIO, VALID_LIKE, VALID_CHARS, ATTEMPTS, LIMIT_WAIT, WAIT = 0.08, 0.82, 2000, 5, 65, 4
HEADING = re.compile(r"(?i)\s*(?:\d+(?:\.\d+)*|[IVXLC]+)\s+.+")


class TextModel(Protocol):
    def complete(self, system: str, prompt: str, max_tokens: int) -> str | None: ...


class RateLimited(Exception):
    """A provider asks to wait."""


class OfflineModel:
    """Answers without a network: a marked echo in Hangul for a translation, extracts for a summary."""

    def complete(self, system: str, prompt: str, max_tokens: int = 4096) -> str | None:
        text = prompt.rsplit("\n\n", 1)[-1].strip()
        if "JSON" in system:
            sentences = [s for s in re.split(r"(?<=[.!?。])\s+", text) if s]
            return json.dumps({"summary": " ".join(sentences[:2])[:300], "intro": " ".join(sentences[:3]), "body": "## 핵심 요약\n\n" + " ".join(sentences[:5]), "tags": ["mill"]}, ensure_ascii=False)
        return "번역: " + " ".join("가나다라마바사아자차카타파하"[sum(map(ord, w)) % 14] * max(1, len(w) // 2) for w in text.split())


def complete_json(model: TextModel, system: str, prompt: str, max_tokens: int, wait: Callable[[float], None] | None = None) -> dict | None:
    """A JSON answer, asked for again where it doesn't parse; None if it never does.

    Without ``wait`` a provider that asks to wait raises ``RateLimited`` at once: inside a
    task that would hold a core, so operators mark the row and ``with_waits`` asks again.
    """
    for attempt in range(ATTEMPTS):
        try:
            got = lenient_json(model.complete(system, prompt, max_tokens) or "")
            if isinstance(got, dict):
                return got
        except RateLimited:
            if wait is None:
                raise
            if attempt + 1 < ATTEMPTS:
                wait(LIMIT_WAIT)
            continue
        except (ValueError, OSError):
            pass
        if wait is not None and attempt + 1 < ATTEMPTS:
            wait(WAIT)
    return None


def with_waits(ask: Callable[[DataFrame], DataFrame], rows: DataFrame, key: str, wait: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> DataFrame:
    """``ask(rows)``, whose result has ``status``; rows that are ``limited`` are asked for again after a wait on the driver, while no task holds a core.

    Each attempt's answers go through the checkpoint folder, so none is paid for twice. What is
    still limited after the last attempt stays so and can be asked for by a later run.
    """
    done = None
    for attempt in range(attempts):
        got = cut_lineage(ask(rows))
        last = attempt + 1 == attempts
        ready = got if last else got.filter("status <> 'limited'")
        done = ready if done is None else done.unionByName(ready)
        if last or got.filter("status = 'limited'").isEmpty():
            break
        rows = rows.join(got.filter("status = 'limited'").select(key), key, "left_semi")
        wait(LIMIT_WAIT)
    return done


def lenient_json(raw: str) -> dict:
    """The JSON of an answer: without a fence around it, else its first to last brace."""
    text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", raw)
    try:
        return json.loads(text)
    except ValueError:
        m = re.search(r"(?s)\{.*\}", text)
        if not m:
            raise
        return json.loads(m.group())


def lenient_json_column(raw: Column, schema: str) -> Column:
    """The same for a column with a declared schema; null where nothing parses."""
    text = F.regexp_replace(raw, r"^\s*```\w*\s*|\s*```\s*$", "")
    whole = F.when(F.ltrim(text).startswith("{"), F.from_json(text, schema))
    return F.coalesce(whole, F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema))


def valid_answer(src: str | None, out: str | None) -> bool:
    """Is it a Korean answer: not blank, not a request for the text, with Hangul and unlike its source?"""
    a, b = " ".join((src or "").split()), " ".join((out or "").split())
    if not b or _asks(b) or len(re.findall("[가-힣]", b)) / len(b) < VALID_RATIO:
        return False
    return not a or difflib.SequenceMatcher(None, a[:VALID_CHARS], b[:VALID_CHARS]).ratio() <= VALID_LIKE


def _asks(text: str) -> bool:
    from folioforge.functions.text import ASKS_FOR_TEXT, ASKS_PATTERN

    return any(p in text for p in ASKS_FOR_TEXT) or re.search(ASKS_PATTERN, text.lower()) is not None


def validity(df: DataFrame, keep: list[str], src: str, out: str) -> DataFrame:
    """``keep`` and ``valid`` of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = [valid_answer(s, o) for s, o in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(flags, pa.bool_())], names=[*keep, "valid"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, src, out).mapInArrow(run, f"{kinds}, valid boolean")


def retry_prompt(paragraph: Column) -> Column:
    return F.concat(F.lit("Translate the following academic paragraph into Korean. Preserve numbering. Output ONLY the Korean text.\n\n"), paragraph)


def heading_like(paragraph: Column) -> Column:
    """Does a paragraph begin with a section number, so that its answer must keep it?"""
    return paragraph.rlike(r"(?i)^\s*(?:\d+(?:\.\d+)*|[IVXLC]+)\s+[^\n]+")


#: Fixed value: proper nouns of a glossary that a prompt carries, the latest ones.
GLOSSARY_MOST = 80


def translate_system(glossary: list[tuple[str, str]] | None = None) -> str:
    """The system prompt of a translation; with proper nouns that were introduced before, only their Korean form is wanted."""
    pairs = "; ".join(f"{en} = {ko}" for en, ko in (glossary or [])[-GLOSSARY_MOST:])
    return "translate" + (f" Proper nouns already introduced, Korean form only: {pairs}" if pairs else "")


def translate_rows(df: DataFrame, keep: list[str], src: str, model: TextModel, glossary: list[tuple[str, str]] | None = None) -> DataFrame:
    """``keep, tgt, status``: up to three prompts a paragraph until an answer is valid; null and ``failed`` else, ``limited`` where the provider asks to wait. Filter with built-ins before."""
    system = translate_system(glossary)

    def one(p: str) -> tuple[str | None, str]:
        prompts = ["", "Translate into Korean, output ONLY the Korean text.\n\n"] + (["This is a section heading. Keep the numbering.\n\n"] if HEADING.match(p) else [])
        try:
            answer = next((a for q in prompts if valid_answer(p, a := model.complete(system, q + p, 4096))), None)
        except RateLimited:
            return None, "limited"
        return answer, "failed" if answer is None else "translated"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(p) if p and p.strip() else (None, "failed") for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array([g[i] for g in got], pa.string()) for i in (0, 1))], names=[*keep, "tgt", "status"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, src).mapInArrow(run, f"{kinds}, tgt string, status string")


def translate_chapters(paras: DataFrame, state: DataFrame, model: TextModel) -> DataFrame:
    """The new state of all paragraphs (chapter_id, idx, src): dropped and kept ones by rule, reusable ones as they were, the rest by the model."""
    from folioforge.functions.text import drop_paragraph, skip_paragraph
    from folioforge.operators.stages import unfinished, upsert_state

    todo = unfinished(paras, state)
    drop, skip = drop_paragraph(F.col("src")), skip_paragraph(F.col("src"))
    ruled = todo.filter(drop | skip).select("chapter_id", "idx", "src", F.when(drop, F.lit("")).otherwise(F.col("src")).alias("tgt"), F.when(drop, "dropped").otherwise("preserved").alias("status"))
    asked = translate_rows(todo.filter(~drop & ~skip), ["chapter_id", "idx", "src"], "src", model)
    asked = asked.withColumn("status", F.when(F.col("status") == "limited", "failed").otherwise(F.col("status")))  # a failed one is asked again by the next run
    return upsert_state(state, ruled.unionByName(asked))


def ask_json(df: DataFrame, key: str, prompt: str, model: TextModel, fields: tuple[str, ...], needed: tuple[str, ...] = (), max_tokens: int = 16_000) -> DataFrame:
    """``key, status`` and the string ``fields`` of a model's JSON answer to each prompt; lists come as JSON.

    ``done``, ``failed`` (no JSON, or a needed field is missing or empty; a blank prompt isn't
    asked) or ``limited`` (the provider asks to wait; see ``with_waits``). Fields are null unless done.
    """

    def one(p: str | None) -> tuple[str, dict]:
        if not p or not p.strip():
            return "failed", {}
        try:
            got = complete_json(model, "Answer in JSON", p, max_tokens)
        except RateLimited:
            return "limited", {}
        return ("done", got) if got is not None and all(got.get(c) for c in needed) else ("failed", {})

    def text(v: object) -> str | None:
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(p) for p in b.column(1).to_pylist()]
            cols = [pa.array([text(g.get(c)) for _, g in got], pa.string()) for c in fields]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.string()), *cols], names=[key, "status", *fields])

    kinds = ", ".join(f"{c} string" for c in fields)
    return df.select(key, prompt).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, status string, {kinds}")


def summarise(df: DataFrame, key: str, text: str, model: TextModel) -> DataFrame:
    """``key, status, summary, body`` from a model's JSON, which must have both."""
    return ask_json(df, key, text, model, ("summary", "body"), ("summary", "body"))
