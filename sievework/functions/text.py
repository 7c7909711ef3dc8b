"""Text functions as Column expressions; Python only where Spark has no equivalent (NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"
#: Words that a query's terms leave out.
STOPWORDS = (
    "a an the of in on at to for with and or my me that this these those from about where what which who when is was "
    "are were be it its some any find show file files photo photos picture image images screenshot screenshots video "
    "videos pdf document documents recording "
    "এবং ও এই সেই একটি আমার থেকে জন্য সাথে মধ্যে কোথায় কোন কী কি যে ছবি স্ক্রিনশট ভিডিও ফাইল পিডিএফ "
    "في من على الى عن مع هذا هذه ذلك التي الذي اين ما صورة صور لقطة شاشة فيديو ملف مستند"
).split()
#: The kind of file that a word asks for.
KIND_WORDS = {
    "screenshot": "screenshot screenshots স্ক্রিনশট لقطة",
    "image": "photo photos picture pictures image images ছবি صورة صور",
    "pdf": "pdf pdfs paper papers পিডিএফ",
    "doc": "document documents note notes নোট مستند ملاحظات",
    "video": "video videos clip movie ভিডিও فيديو مقطع",
    "audio": "audio song podcast voice sound অডিও গান রেকর্ডিং صوت تسجيل اغنية",
}
#: Code points that normalisation drops, and alefs that become one.
DROPPED = [0x00AD, 0x061C, *range(0x200C, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF, 0x0640, *range(0x064B, 0x0660), 0x0670]
ALEFS = [0x0622, 0x0623, 0x0625, 0x0671]
_MAP = {c: None for c in DROPPED} | {c: 0x0627 for c in ALEFS} | {0x200B: " "}
INFLECTING = r"[ऀ-෿؀-ۿ]"


def normalize(text: str) -> str:
    """NFKC, invisible marks dropped, one alef."""
    return unicodedata.normalize("NFKC", text).translate(_MAP)


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    return text.map(normalize, na_action="ignore")


def inflects(word: Column) -> Column:
    return word.rlike(INFLECTING)


def words(text: Column) -> Column:
    """Lower-case words of two code points or more, in order."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: F.length(w) >= 2)


def terms(text: Column) -> Column:
    """A query's content words, each once, in order."""
    return F.array_except(F.array_distinct(words(text)), F.array(*map(F.lit, STOPWORDS)))


def query_terms(query: str) -> list[str]:
    """`terms` of one query string on the driver."""
    import regex

    found = [w for w in regex.split(WORD_BREAK, normalize(query).lower()) if len(w) >= 2 and w not in STOPWORDS]
    return list(dict.fromkeys(found))


def patterns(found: Column, prefix_last: Column | bool = False) -> Column:
    """Quoted terms; with a star where a prefix is meant."""
    last = F.size(found) - 1
    return F.transform(found, lambda t, i: F.concat(F.lit('"'), t, F.lit('"'), F.when(inflects(t) | (F.lit(prefix_last) if isinstance(prefix_last, bool) else prefix_last) & (i == last), "*").otherwise("")))


def fts_query(text: Column, prefix_last: bool = False) -> Column:
    found = terms(text)
    return F.when(F.size(found) > 0, F.array_join(patterns(found, prefix_last), " OR "))


def _starting(pattern: str):
    return lambda w: w.rlike(pattern)


def kind_hints(text: Column) -> Column:
    """Kinds that a query asks for; a Bengali or Arabic kind word also at the start of a longer word."""
    found = words(text)
    hits = []
    for kind, names in KIND_WORDS.items():
        exact = F.arrays_overlap(found, F.array(*map(F.lit, names.split())))
        stems = "|".join(n for n in names.split() if ord(n[0]) > 0x5FF and len(n) >= 3)
        longer = F.exists(found, _starting(f"^({stems})")) if stems else F.lit(False)
        hits.append(F.when(exact | longer, F.lit(kind)))
    return F.array_compact(F.array(*hits))


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))


def has_words(text: Column) -> Column:
    """At least a fifth of what isn't space is letters."""
    letters, solid = letter_count(text), F.length(F.regexp_replace(text, r"\s", ""))
    return (letters > 0) & (letters * 4 >= solid - letters)


def has_prose(text: Column) -> Column:
    """`has_words`, and four words or more with a letter."""
    worded = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{M}]"))
    return has_words(text) & (F.size(worded) >= 4)


def excerpt(text: Column, limit: int = 240) -> Column:
    """White space collapsed; at most `limit` code points and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


#: Named entities.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}
#: HTML in pieces: what is left out whole, tags, texts, and a bracket that opens no tag.
_PIECES = r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>|<[^>]+>|[^<]+|<"
#: Tags that end a line.
_LINE_ENDS = r"(?i)^<(br|/(p|div|li|h[1-6]|tr|section|article))\b"
_ENTITY_PIECES = r"&#?\w+;|[^&]+|&"


def _entity(piece: Column) -> Column:
    """A named or numbered entity's letter; a number that is no letter is a space, an unknown name stays."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])[piece]
    is_hex, is_number = piece.rlike("^&#x[0-9a-fA-F]+;$"), piece.rlike("^&#[0-9]+;$")
    digits = F.regexp_extract(piece, "^&#x?0*([0-9a-fA-F]+);$", 1)
    code = F.when(F.length(digits) > 8, F.lit(1 << 40)).when(is_hex, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    fine = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    letter = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(" ")
    return F.coalesce(named, F.when(is_hex | is_number, letter), piece)


def decoded_entities(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(_ENTITY_PIECES), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("&"), _entity(p)).otherwise(p)), "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """HTML as text, in one pass over its pieces: what holds no text is dropped, tags that end a block are line ends,
    other tags spaces; then entities are decoded, each once."""
    pieces = F.regexp_extract_all(html, F.lit(_PIECES), F.lit(0))
    shown = lambda p: F.when(~p.startswith("<") | (p == "<"), p).when(p.rlike(_LINE_ENDS), "\n").otherwise(" ")
    text = decoded_entities(F.array_join(F.transform(pieces, shown), ""))
    lines = F.transform(F.split(text, r"\s*\n\s*"), lambda x: F.regexp_replace(x, r"[ \t]+", " "))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def is_lookup(found: Column) -> Column:
    """Only codes and long numbers: every term has a digit, and a letter or four letters and digits."""
    code = lambda t: t.rlike(r"\p{N}") & (t.rlike(r"\p{L}") | (F.length(t) >= 4))
    return (F.size(found) > 0) & F.forall(found, code)


def identifier(query: Column) -> Column:
    """The lower-case parts of a name in code, or null."""
    name = F.regexp_replace(F.trim(query), r"\(\)$", "")
    shape = name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|::|->|#)[A-Za-z_$][A-Za-z0-9_$]*)*$")
    marked = name.rlike(r"[a-z][A-Z]|[_.:#$0-9]")
    return F.when(shape & marked, F.filter(F.split(F.lower(name), r"[^a-z0-9]+"), lambda w: w != ""))


def line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")) + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def code_query(text: Column) -> Column:
    """What follows "code:", or null."""
    found = F.regexp_extract(text, r"(?is)^\s*code:\s*(.*)$", 1)
    return F.when(text.rlike(r"(?i)^\s*code:"), found)


def clock(seconds: Column) -> Column:
    """"0:05", "1:01:40"; null of null."""
    whole = F.floor(seconds)
    long = F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.when(whole >= 3600, long).when(whole.isNotNull(), F.format_string("%d:%02d", F.floor(whole / 60), whole % 60))


def is_right_to_left(text: Column) -> Column:
    return F.regexp_extract(text, r"(\p{L})", 1).rlike(r"[֐-ࣿיִ-﷿ﹰ-ﻼ]")
