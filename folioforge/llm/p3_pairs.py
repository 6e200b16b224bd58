"""Problem 3: broken prompt and response pairs.

Ordered rules over ``(src, out)``, one narrow Arrow pass in which a good pair leaves
after a few cheap tests and only defective rows come back to the JVM. (As built-in
expressions the same rules took 450 microseconds a pair: the optimizer repeats shared
regular expressions in the filter, and none of them can be left early.)
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import table

#: Rules in the order in which they decide; the first that holds names the pair's defect.
ORDER = ("empty", "refusal", "copy", "wrong_language", "truncated")

#: Stand-ins that are no answer, in lower case without blanks.
PLACEHOLDERS = (
    "na", "none", "null", "nil", "nan", "undefined", "todo", "tbd", "empty", "blank", "없음", "해당없음", "내용없음",
    "빈칸", "미정", "keine", "leer", "aucun", "vide", "ninguno", "vacío", "なし", "該当なし",
)

#: Labels that are put in front of an answer.
LABELS = r"(?is)^\s*(?:\[(?:ko|en|de|fr|es|ja)\]|(?:다음은\s*)?번역(?:문|본|\s*결과)?(?:입니다)?\s*[:：.]|(?:here is the )?translation\s*[:：]|übersetzung\s*[:：]|traduction\s*[:：]|traducción\s*[:：]|訳\s*[:：]|답변?\s*[:：]|answer\s*[:：])\s*"

#: Ways to decline, or to ask for the text, in six languages.
REFUSALS = (
    r"\b(?:cannot|can ?not|can.t|could not|won.t be able to|am not able to|am unable to|unable to|not able to) (?:\w+ ){0,3}?(?:help|assist|translat|process|provid|render|fulfil|comply|do that|answer)",
    r"\b(?:must|have to|need to) decline\b",
    r"\boutside (?:of )?what i can do\b",
    r"\b(?:please|could you|can you|would you) (?:\w+ )?(?:send|paste|provide|share|supply)\b.{0,30}\b(?:text|paragraph|passage|source|sentence|content)",
    r"\bno (?:\w+ )?(?:text|paragraph|passage|source|content|input)\b.{0,25}\b(?:was|were|is|has been)\b.{0,15}\b(?:included|provided|given|supplied|found|attached)",
    r"\bas an? (?:\w+ ){0,2}(?:tool|model|assistant|ai)\b.{0,60}\b(?:cannot|can.t|unable|won.t|not able|decline)",
    r"^(?:죄송|미안|아쉽|양해|유감).{0,70}(?:없습니다|없네요|없어요|못합니다|주세요|주시겠어요|주십시오|바랍니다|시작하겠습니다|않았습니다|어렵습니다)",
    r"(?:번역|옮길|옮겨|옮기|처리|도와|제공|다룰|다루).{0,14}(?:수\s*없습니다|수\s*없네요|수\s*없어요|못합니다|어렵습니다|않는\s*것이\s*좋겠)",
    r"(?:원문|본문|문장|단락|문단|텍스트|입력|글)[을를이가은는도 ].{0,24}(?:제공되지\s*않았|비어\s*있|붙여\s*넣어\s*주|보내\s*주|알려\s*주|입력해\s*주)",
    r"어떤\s*문장을\s*옮겨야",
    r"\b(?:ich kann|kann ich|ich bin nicht in der lage)\b.{0,60}\b(?:nicht|leider)\b|\bleider\b.{0,40}\bnicht (?:übersetzen|helfen|bearbeiten)|\bbitte\b.{0,30}\b(?:senden|schicken|geben|fügen)\b.{0,30}\b(?:text|absatz)",
    r"\bje (?:ne peux|ne suis|regrette|suis désolé)\b.{0,60}\b(?:pas|traduire|aider)|\bveuillez\b.{0,30}\b(?:envoyer|fournir|coller)\b.{0,30}\b(?:texte|paragraphe)",
    r"\b(?:lo siento|no puedo|no me es posible)\b.{0,60}\b(?:traducir|ayudar|procesar|texto)|\bpor favor\b.{0,30}\b(?:envíe|pegue|proporcione)\b.{0,30}\b(?:texto|párrafo)",
    r"(?:申し訳|すみません).{0,60}(?:できません|いただけます|ください)|(?:原文|本文|文章).{0,20}(?:ありません|送って|貼り付け)",
)

#: Share of an answer's sentences that decline from which it is a refusal wherever they stand; one that begins so always is.
REFUSAL_SHARE = 0.3
#: Share of the answer's words that must be words of ``src`` for a copy; share of the words of ``src``, and how many at least, that an answer must begin with.
COPY_SHARE, PREFIX_SHARE, PREFIX_WORDS = 0.6, 0.6, 4
#: Share of Hangul among an answer's letters from which it is Korean.
KOREAN_SHARE = 0.25
#: An answer with fewer than this share of the sentences of ``src`` lacks most of them.
SENTENCE_SHARE = 0.5

#: Blanks that are no answer by themselves.
BLANKS = " \t\r\n\f\v\u00a0\u3000\u200b\ufeff"
#: Stems without which no refusal in Korean or Japanese is looked for.
REFUSAL_STEMS = ("없습니다", "없네요", "없어요", "못합니다", "주세요", "주시", "주십", "바랍니다", "겠습니다", "않았", "어렵", "비어", "좋겠", "옮겨야", "ません", "ください", "いただ", "送って", "貼り付け")

_LABEL = re.compile(LABELS)
_REFUSAL = [re.compile(p) for p in REFUSALS]
_QUOTED = re.compile(r"[\"“«「][^\"”»」]*[\"”»」]")
_NOT_HANGUL = re.compile("[^가-힣]+")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_BARE = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"""[.?!。？！]+(?=[\s"'”’»›」』)\]*]|$)|다["”](?=[고라])""")
_SRC_ENDS = re.compile(r"""[.?!。？！…]["'”’»›」』)\]*]*\s*$""")
_ENDS = re.compile(r"""[.?!。？！]["'”’»›」』)\]*]*$""")
_CUT_MARK = re.compile(r"(?:…|\.\.\.|\ufffd|[\[(]\s*(?:계속\s*)?[\])]?|[,;:·—–-])$")
_WHOLE = re.compile(r"""(?:[한된있없같이았었했였린긴킨쓴른]다|는가|은가|까|시오|하라|세요)["”]?$""")


def _declines(body: str, korean: bool) -> bool:
    """Does the answer begin with a refusal, or decline in a good part of its sentences? Quotations don't count; its length doesn't matter."""
    if korean and not any(x in body for x in REFUSAL_STEMS):
        return False
    text = _QUOTED.sub("", body).lower().strip()
    at = sorted(m.start() for p in _REFUSAL for m in p.finditer(text))
    if not at:
        return False
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    if not ends or at[0] < ends[0]:
        return True
    declining = len({bisect_right(ends, i) for i in at})
    return declining >= REFUSAL_SHARE * (len(ends) + (ends[-1] < len(text)))


def _copies(body: str, src: str) -> bool:
    words = {w for w in _BARE.split(body.lower()) if w}
    return bool(words) and len(words & set(_BARE.split(src.lower()))) >= COPY_SHARE * len(words)


def _begins_with(body: str, src: str) -> bool:
    """Does the answer begin with the words of the source, whatever stands behind them?"""
    if body[:1].lower() != src.lstrip(BLANKS)[:1].lower() and body[:1].isalnum():
        return False
    own, asked = ([w for w in _BARE.split(t.lower()) if w] for t in (body, src))
    same = next((i for i, (x, y) in enumerate(zip(own, asked)) if x != y), min(len(own), len(asked)))
    return same >= max(PREFIX_WORDS, PREFIX_SHARE * len(asked))


def defects_of(src: str | None, out: str | None) -> list[str]:
    """Every triggered defect of a pair, in rule order; none for a null ``src``. An empty answer has nothing that another rule could judge."""
    if src is None:
        return []
    body = (out or "").strip(BLANKS)
    if body and (body[0] in "[번다답訳" or body[0].isascii() or body[0] in "ÜüTt"):
        body = _LABEL.sub("", body, count=1).strip(BLANKS)
    hangul = len(_NOT_HANGUL.sub("", body))
    if not hangul or len(body) < 12:
        bare = _BARE.sub("", body.lower())
        if not bare or bare in PLACEHOLDERS:
            return ["empty"]
    korean = hangul > 0 and (hangul * 2 > len(body) or hangul >= KOREAN_SHARE * len(_NOT_LETTER.sub("", body)))
    found = []
    if _declines(body, korean):
        found.append("refusal")
    if _begins_with(body, src) or not korean and _copies(body, src):
        found.append("copy")
    if not korean and len(_NOT_LETTER.sub("", body)) >= 2:
        found.append("wrong_language")
    if _is_cut(src, body):
        found.append("truncated")
    return found


def _is_cut(src: str, body: str) -> bool:
    """An unclosed delimiter, an abrupt ending, or most sentences missing."""
    if _CUT_MARK.search(body):
        return True
    if not _SRC_ENDS.search(src):
        return False
    if body.count('"') % 2 or sum(map(body.count, "([（「『“«")) > sum(map(body.count, ")]）」』”»")):
        return True
    had, has = len(_SENTENCE.findall(src)), len(_SENTENCE.findall(body))
    if has < SENTENCE_SHARE * had:
        return True
    return not _ENDS.search(body) and not (_WHOLE.search(body) and has + 1 >= had)


def find_defects(df: DataFrame, keep: list[str], src: str = "src", out: str = "out") -> DataFrame:
    """The defective rows of ``df``: the columns ``keep`` and ``defects``, every triggered defect in rule order.

    A null ``src`` triggers nothing. A null, empty or blank ``out``, one without letters
    or digits and a placeholder are ``empty``. Texts are read whole; repeated rows come
    back as often as they occur; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, flags = [], []
            for i, (s, o) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())):
                if found := defects_of(s, o):
                    rows.append(i)
                    flags.append(found)
            at = pa.array(rows, pa.int64())
            cols = [c.take(at) for c in batch.columns[: len(keep)]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(flags, pa.list_(pa.string()))], names=[*keep, "defects"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, src, out).mapInArrow(run, f"{kinds}, defects array<string>")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose answer counts: a source paragraph that was to be translated."""
    kept = ~F.coalesce(F.col("status"), F.lit("")).isin("preserved", "dropped")
    return table(spark, sf_dir, "translate_pairs").filter(F.col("src").isNotNull() & kept)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defective pair once, with the first defect in rule order."""
    hit = find_defects(_answers(spark, sf_dir), ["pair_id"])
    return hit.select("pair_id", F.col("defects")[0].alias("defect")).distinct()


def p3_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered defect type of every pair, with its place in the rule order."""
    hit = find_defects(_answers(spark, sf_dir), ["pair_id"])
    return hit.select("pair_id", F.posexplode("defects").alias("rule_no", "defect")).distinct()


def p3_engine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every engine: its pairs, the defective ones, and how many have each first defect (exact copies of a row count once; a null engine is the empty one)."""
    rows = _answers(spark, sf_dir).withColumn("engine", F.coalesce("engine", F.lit("")))
    bad = find_defects(rows, ["pair_id", "engine"]).select("pair_id", "engine", F.col("defects")[0].alias("defect"))
    # A pair and its defect meet in one aggregation, so an engine without defects keeps its row.
    one = rows.select("pair_id", "engine", F.lit(None).cast("string").alias("defect")).unionByName(bad).groupBy("pair_id", "engine").agg(F.max("defect").alias("defect"))
    return one.groupBy("engine").agg(F.count("*").alias("n_pairs"), F.count("defect").alias("n_defective"), *[F.count_if(F.col("defect") == d).alias(f"n_{d}") for d in ORDER])


QUERIES = {"p3_found": p3_found, "p3_defects": p3_defects, "p3_engine_report": p3_engine_report}
