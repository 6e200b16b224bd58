"""Scalar text functions as Spark expressions: cleanup, quality, routing predicates, names and keys.

Nulls: a null text counts as an empty one wherever a number or flag is computed, and
stays null where a text is returned. ``WS`` is white space as Unicode has it, spelled out
so that the JVM and SQL engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
HANGUL = "[가-힣]"
HANGUL_WIDE = "[가-힣ᄀ-ᇿㄱ-ㆎ㄰-㆏]"

#: Thresholds of the text rules.
LONG_TOKEN, BAD_HEALTH = 26, 0.03
SAMPLE_CHARS, TARGET_RATIO, ALREADY_RATIO = 3000, 0.3, 0.6
SHORT_CITATION, DROP_CHARS = 500, 80

#: Patterns of citations, footnotes and paragraphs that aren't text.
DAGGER = r"^\s*†\s"
NUMBERED_CITATION = r"^\s*\[?[0-9]+\*?\]?\s+[A-Z][^.]*,\s+[A-Z]"
BULLET_CITATION = r"^\s*-\s+[0-9]+\*?\s+[A-Z]"
CITED_URL = r"(?i)(https?://|arxiv|doi\.org|dx\.doi)"
NUMBER_ONLY = r"^[0-9\s,.\-–—%]+$"
FOOTNOTE_START = r"^\s*(?:\[?[0-9]{1,3}\]?[\s.,):]|[0-9]\s[0-9][\s.,):])\s*\S"
EXPLICIT_CITE = (
    r"(?i)같은\s*책|위의\s*책|앞의\s*책|ibid|op\.\s*cit|p\.\s*[0-9]+|pp\.\s*[0-9]+|각주\s*[0-9]|[0-9]+\s*쪽|쪽[,. ]|[A-Z][a-z]{1,15},\s+[A-Z]|\b(19|20)[0-9]{2}[),]|"
    r"마태|누가복음|요한복음|로마서|고린도|갈라디|에베|시편\s*[0-9]|잠언\s*[0-9]|창세기|출애굽|이사야|예레미야|https?://|doi:\s*10|www\."
)
CITE_MARK = r"(?i)[0-9]|같은|참조|ibid|op\.|p\.|각주|위의|앞의|출처|see\s|cf\."
#: Phrases in which a model asks for the text instead of translating it.
ASKS_FOR_TEXT = ("번역할 학술 문단을 아직 받지 못했습니다", "번역하실 텍스트", "텍스트를 붙여넣어", "원문을 제공", "본문을 보내")
ASKS_PATTERN = r"(?is)(?:please\s+provide|send|paste).{0,80}(?:text|paragraph|source)|(?:no|not|haven't|have\s+not).{0,80}(?:text|paragraph|source).{0,80}(?:translate|received)"
#: Titles of sections after the text, and of parts of a Korean book.
NOTE_SECTIONS = ("notes", "endnotes", "bibliography", "references", "index", "works cited", "acknowledgments", "주", "미주", "참고문헌", "찾아보기")
SKIPPED_SECTIONS = (
    "references", "bibliography", "works cited", "참고문헌", "literaturverzeichnis", "bibliographie", "références", "referencias", "参考文献", "referências", "referenties",
    "список литературы", "список источников", "المراجع", "قائمة المراجع", "ביבליוגרפיה", "מקורות", "ማጣቀሻዎች", "tài liệu tham khảo", "daftar pustaka", "referensi", "รายการอ้างอิง",
)
KO_MAJOR = r"(?i)^(?:제\s*)?([0-9]+)\s*장\b|^(머리말|서론|서문|결론|에필로그|프롤로그|후기|맺음말|맺는말|들어가며|나가며)$"
#: Limits of a model's input in characters.
INPUT_CAPS = {"gemini": 1_900_000, "openai": 400_000, "anthropic": 140_000, "claude_cli": 140_000, "codex_cli": 400_000}


def _none(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(_none(text), f"{WS}+"), lambda t: t != "")


def token_health(text: Column) -> Column:
    """Share of tokens that are so long that words must have run together; 1 without tokens."""
    t = tokens(text)
    return F.when(F.size(t) == 0, F.lit(1.0)).otherwise(F.size(F.filter(t, lambda x: F.length(x) >= LONG_TOKEN)) / F.size(t))


def vertical_noise(line: Column) -> Column:
    """A line of single characters, as rotated text is read."""
    t = tokens(line)
    chars = F.aggregate(t, F.lit(0), lambda a, x: a + F.length(x))
    return (F.size(t) >= 6) & (chars / F.size(t) <= 1.3)


def hangul_ratio(text: Column) -> Column:
    t = _none(text)
    return F.regexp_count(t, F.lit(HANGUL)) / F.greatest(F.length(t), F.lit(1))


def needs_translation(text: Column) -> Column:
    return hangul_ratio(F.substring(_none(text), 1, SAMPLE_CHARS)) < TARGET_RATIO


def already_target(paragraph: Column) -> Column:
    p = strip(_none(paragraph))
    return (p != "") & (hangul_ratio(p) >= ALREADY_RATIO)


def title_needs_translation(stem: Column) -> Column:
    return ~_none(stem).rlike(HANGUL_WIDE)


def drop_paragraph(paragraph: Column) -> Column:
    p = strip(_none(paragraph))
    return (p == "") | ((F.length(p) <= DROP_CHARS) & p.rlike(NUMBER_ONLY))


def skip_paragraph(paragraph: Column) -> Column:
    p = strip(_none(paragraph))
    short = F.length(p) < SHORT_CITATION
    return (p == "") | p.rlike(DAGGER) | p.rlike(NUMBERED_CITATION) | p.rlike(BULLET_CITATION) | (short & (p.rlike(FOOTNOTE_START) | p.rlike(CITED_URL)))


def asks_for_text(answer: Column) -> Column:
    a = _none(answer)
    found = F.lower(strip(a)).rlike(ASKS_PATTERN)
    for phrase in ASKS_FOR_TEXT:
        found = found | a.contains(phrase)
    return (strip(a) != "") & found


def footnote_number(paragraph: Column) -> Column:
    """The number a footnote begins with, two digits that were read apart joined; null for headings, sections and prose."""
    p = strip(_none(paragraph))
    apart = F.regexp_extract(p, r"^([0-9]\s[0-9])[\s.,):]\s*\S", 1)
    plain = F.regexp_extract(p, r"^\[?([0-9]{1,3})\]?[\s.,):].", 1)
    decimal = p.rlike(r"^\[?[0-9]{1,3}\]?\.[0-9]")
    rest = strip(F.when(apart != "", F.regexp_replace(p, r"^[0-9]\s[0-9][\s.,):]\s*", "")).otherwise(F.regexp_replace(p, r"^\[?[0-9]{1,3}\]?[\s.,):]", "")))
    heading = rest.rlike(r"^판\s*[0-9]") | ((F.length(rest) <= 20) & ~rest.rlike(CITE_MARK))
    number = F.when(apart != "", F.regexp_replace(apart, r"\s", "")).when((plain != "") & ~decimal, plain)
    return F.when(~p.contains("\n") & ~heading, number.cast("int"))


def note_title(title: Column) -> Column:
    t = strip(_none(title))
    return t.rlike(r"^\s*[0-9]+[.)]\s") | F.lower(t).isin(*NOTE_SECTIONS)


def ko_major_chapter(title: Column) -> Column:
    return strip(_none(title)).rlike(KO_MAJOR)


def clean_sentence(sentence: Column) -> Column:
    """Fit to be quoted: of usual length, mostly Hangul, without broken letters, runs of Han or odd signs."""
    s = strip(_none(sentence))
    n = F.length(s)
    odd = F.regexp_count(s, F.lit(r"[^0-9A-Za-z_가-힣()\.,'\"·\-—%·:!?\s]"))
    return (n >= 25) & (n <= 180) & (F.regexp_count(s, F.lit(HANGUL)) >= n * 0.45) & ~s.rlike("[ᄀ-ᇿ㄰-㆏]") & ~s.rlike("[一-鿿]{2,}") & (odd <= 3)


def fuzzy_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^0-9A-Za-z가-힣ぁ-んァ-ヶ一-龥À-ÖØ-öø-ÿ]+", ""))


def entity_key(name: Column) -> Column:
    """A key of a file or book name: without suffix, upload prefix, translation mark, subtitle and number. Each rewrite works on what the last left."""
    key = F.lower(name)
    for pattern in (r"\.(txt|pdf|md)$", r"^add_pdf[_\s-]*", r"_?(?:ko|번역|레퍼런스삭제_번역)$", r"_home-miniui-macmini\.local_.*?_conflict$", r"\s+—\s+.*$", r"^[0-9]{1,2}[_\s.-]+", r"[^0-9a-z가-힣]+"):
        key = F.regexp_replace(key, pattern, "")
    return key


def note_filename(title: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(title, r"[/\\:]", " - "), r'[*?"<>|]', "")
    safe = F.regexp_replace(strip(safe), r"\s{2,}", " ")
    return F.concat(F.when(safe == "", F.lit("untitled")).otherwise(safe), F.lit(".md"))


def chapter_filename(no: Column, title: Column) -> Column:
    """``NN_title.md``: cut at a word within 60 characters."""
    safe = F.regexp_replace(strip(F.regexp_replace(title, r'[/\\:*?"<>|]', " ")), r"\s{2,}", " ")
    cut = F.substring(safe, 1, 60)
    safe = F.when(F.length(safe) > 60, F.when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)).otherwise(safe)
    safe = F.regexp_replace(safe, r"^[ .,\-:]+|[ .,\-:]+$", "")
    return F.concat(F.when(no < 10, F.concat(F.lit("0"), no.cast("string"))).otherwise(no.cast("string")), F.lit("_"), F.when(safe == "", F.lit("장")).otherwise(safe), F.lit(".md"))


def single_chapter_name(stem: Column) -> Column:
    safe = F.regexp_replace(F.substring(strip(F.regexp_replace(stem, r'[/\\:*?"<>|]', " ")), 1, 50), r"^[ .,:\-]+|[ .,:\-]+$", "")
    return F.concat(F.lit("01_"), F.when(safe == "", F.lit("본문")).otherwise(safe), F.lit(".txt"))


def folder_name(stem: Column) -> Column:
    return strip(F.regexp_replace(stem, r'[/\\:*?"<>|]', "_"))


def author_from_stem(stem: Column) -> Column:
    """The last part of ``title_author``, if it may be a name; else empty."""
    parts = F.filter(F.transform(F.split(_none(stem), "_"), strip), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when((F.size(parts) >= 2) & (F.length(last) > 1) & (F.length(last) <= 25) & ~last.rlike("[0-9]"), last).otherwise(F.lit(""))


def demote_headings(md: Column) -> Column:
    return F.regexp_replace(md, r"(?m)(?d)^(#{2,5})(\s)", "#$1$2")


def strip_chapter_number(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(title, r"^\s*[0-9]+[.)]\s*", ""), r"^[ :：]+|[ :：]+$", "")


def strip_md_noise(md: Column) -> Column:
    md = F.regexp_replace(md, r"!\[[^\]]*\]\([^)]*\)\s*", "")
    return F.replace(F.regexp_replace(md, r"(?s)<!--.*?-->", ""), F.lit("\f"), F.lit("\n"))


def toc_title(title: Column) -> Column:
    """Without dot leaders, other repeated leaders and the page number behind them."""
    t = squeeze(title)
    t = strip(F.regexp_replace(t, r"(?i)\s*[.·ㆍ…]{2,}\s*(?:[0-9]+|[ivxlcdm]+)\s*$", ""))
    t = strip(F.regexp_replace(t, r"(?i)\s*(.)\1{3,}\s*(?:[0-9]+|[ivxlcdm]+)\s*$", ""))
    return F.regexp_replace(t, r"^[ .·ㆍ…]+|[ .·ㆍ…]+$", "")


def roman_value(roman: Column) -> Column:
    """Value of a Roman numeral: a letter before a larger one counts negative."""
    value = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])
    letters = F.reverse(F.split(F.upper(roman), ""))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))

    def add(a: Column, c: Column) -> Column:
        v = F.coalesce(F.try_element_at(value, c), F.lit(0))
        return F.struct((a["sum"] + F.when(v < a["most"], -v).otherwise(v)).alias("sum"), F.greatest(a["most"], v).alias("most"))

    return F.aggregate(letters, start, add, lambda a: a["sum"])


def version_parts(version: Column) -> Column:
    """Numbers of a version, comparable as an array; a part without digits is 0."""
    parts = F.split(F.regexp_replace(strip(_none(version)), "^[vV]+", ""), r"\.")
    digits = F.transform(parts, lambda p: F.regexp_replace(p, "[^0-9]", ""))
    return F.transform(digits, lambda d: F.when(d == "", F.lit(0)).otherwise(d.cast("int")))


def yaml_line(key: str, value: Column) -> Column:
    """``key: value`` with a line feed, quoted where needed; empty for a blank value."""
    v = strip(F.regexp_replace(strip(_none(value)), "\n", " "))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(v == "", F.lit("")).otherwise(F.concat(F.lit(f"{key}: "), F.when(v.rlike(r"""[:#\[\]{}&,*!|>'"%@`]"""), quoted).otherwise(v), F.lit("\n")))


def mask_key(key: Column) -> Column:
    """The ends of a key, or only dots where it is short."""
    k = _none(key)
    return F.when(F.length(k) > 10, F.concat(F.left(k, F.lit(4)), F.lit("…"), F.right(k, F.lit(4)))).otherwise(F.repeat(F.lit("•"), F.length(k)))


def strip_emoji(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{200D}]", ""), " {2,}", " ")


def clean_pct(pct: Column) -> Column:
    """The length setting in 5..40, 15 where it is missing."""
    return F.greatest(F.lit(5), F.least(F.lit(40), F.coalesce(pct.try_cast("int"), F.lit(15))))


def length_params(chars: Column, pct: Column) -> Column:
    """Targets of a summary from the length of the text and the percentage wanted (rounding half to even)."""
    target = F.greatest((1200 + pct * 90).cast("long"), F.floor(chars * pct / 100)).cast("long")
    n_sub = F.greatest(F.lit(3), F.least(F.lit(24), F.bround(target / 700).cast("long"))).cast("long")
    n_cite = F.greatest(F.lit(3), F.least(F.lit(14), F.bround(n_sub * F.lit(0.7).cast("double")).cast("long"))).cast("long")
    span = lambda low, width: F.concat_ws("~", low.cast("string"), (low + width).cast("string"))
    return F.struct(
        target.alias("target"), n_sub.alias("n_sub"), F.greatest(F.lit(1), F.floor(target / n_sub)).cast("long").alias("per_sub"), n_cite.alias("n_cite"),
        span(F.greatest(F.lit(5), 4 + F.floor(pct / 8)), 4).alias("n_kw"), span(3 + F.floor(pct / 10), 2).alias("sent_ov"), span(5 + F.floor(pct / 8), 3).alias("intro_sent"),
        F.least(F.lit(64000), F.greatest(F.lit(6000), F.floor(target * F.lit(2.6).cast("double")))).cast("long").alias("max_out"),
    )


def note_budgets(chars: Column) -> Column:
    div = lambda n: F.floor(chars / n)
    n_sub = F.least(F.lit(24), F.greatest(F.lit(7), div(35000)))
    return F.struct(
        n_sub.cast("long").alias("n_sub"), F.least(F.lit(30), F.greatest(F.lit(8), div(28000))).cast("long").alias("n_cite"),
        F.least(F.lit(15), F.greatest(F.lit(4), div(110000))).cast("long").alias("cite_keep"), F.least(F.lit(60000), F.greatest(F.lit(16384), n_sub * 2200)).cast("long").alias("max_out"),
    )


def cap_input(provider: Column, text: Column) -> Column:
    caps = F.create_map(*[F.lit(x) for kv in INPUT_CAPS.items() for x in kv])
    return F.substring(text, F.lit(1), F.coalesce(F.try_element_at(caps, provider), F.lit(400_000)))


def bilingual(block: Column) -> Column:
    """(src, tgt) of a block in one of three forms; null for a block of none."""
    b = strip(_none(block))
    old, head = b.contains("\n\n[KO]\n"), b.startswith("[EN]\n")
    cut = lambda sep: F.split(b, sep, 2)
    left, right = cut("\n\n\\[KO\\]\n")[0], F.get(cut("\n\n\\[KO\\]\n"), 1)
    old_src = F.when(head, F.substring(left, F.lit(6), F.length(left))).otherwise(left)
    new = ~b.startswith("[") & b.contains("\n\n")
    pair = lambda s, t: F.struct(strip(s).alias("src"), strip(t).alias("tgt"))
    return (
        F.when(b == "", F.lit(None))
        .when(old, pair(old_src, right))
        .when(new, pair(cut("\n\n")[0], F.get(cut("\n\n"), 1)))
        .when(head, pair(F.substring(b, F.lit(6), F.length(b)), F.lit("")))
    )


def despace(text: Column) -> Column:
    """Without brackets' contents, white space and quotation marks at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), f"{WS}+", ""), "^[\"“”‘’ ]+|[\"“”‘’ ]+$", "")
