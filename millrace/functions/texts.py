"""Text expressions, all on the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that markup is decoded from; numbers are decoded by unescape().
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
CJK = r"\x{4e00}-\x{9fff}"
#: Words that counts of vocabulary leave out.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "but", "and", "or", "not", "no", "nor", "so", "yet", "both", "either", "neither", "each", "every", "all",
    "any", "few", "more", "most", "other", "some", "such", "than", "too", "very", "just", "about", "up", "out", "if", "then", "it", "its", "this",
    "that", "these", "those", "i", "me", "my", "you", "your", "he", "she", "we", "they", "them", "his", "her", "our", "their", "what", "which",
    "who", "whom", "how", "when", "where", "why", "rt", "https", "http", "co", "amp", "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一",
    "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
)


def blank_to_null(x: Column) -> Column:
    """Null where a text is null, empty or only blanks: missing is one thing."""
    return F.nullif(F.trim(x), F.lit(""))


def unescape(x: Column) -> Column:
    """Decodes the common entities; the ampersand comes last, so nothing is decoded twice."""
    for entity, sign in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return x


def strip_html(x: Column) -> Column:
    """Tags become blanks, entities are decoded and runs of white space become one blank."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(x, r"<[^>]*>", " ")), r"\s+", " "))


def shorten(x: Column, most: int = 500, mark: str = "...") -> Column:
    """The first ``most`` code points with a mark, if there are more."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(mark))).otherwise(x)


def normalize_title(x: Column) -> Column:
    """Lower case, every sign but letters, digits and underscores a blank, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+", " "))


def title_tokens(x: Column, digits: bool = False) -> Column:
    """Distinct runs of a-z and single CJK signs of a normalised title; with ``digits``, runs may hold digits."""
    run = "[a-z0-9]+" if digits else "[a-z]+"
    return F.array_distinct(F.regexp_extract_all(normalize_title(x), F.lit(f"{run}|[{CJK}]"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays of distinct elements; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def has_cjk(x: Column) -> Column:
    return F.coalesce(x.rlike(f"[{CJK}]"), F.lit(False))


def language_mix(x: Column) -> Column:
    """chinese, mixed or english: CJK signs alone, with Latin words of three letters or more, or none."""
    return F.when(has_cjk(x) & x.rlike("[a-zA-Z]{3,}"), "mixed").when(has_cjk(x), "chinese").otherwise("english")


def add_flag(flags: Column, flag: str) -> Column:
    """flags with one more, once."""
    return F.array_union(F.coalesce(flags, F.array().cast("array<string>")), F.array(F.lit(flag)))


def vocabulary(x: Column, stop: bool = True) -> Column:
    """The words of a text for counting: lower case, without links, two signs or more, no stop words (with ``stop``; counts leave them out at less cost)."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(x), r"https?://\S+", ""), rf"[^a-z0-9_{CJK}]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS)) if stop else words


def bounded(keyword: str, unicode: bool = True) -> str:
    """A pattern for a keyword that no word sign touches; blanks in it match any white space, case doesn't count.

    The border is spelled out, since what \\b means depends on the engine.
    """
    sign = r"[\p{L}\p{N}_]" if unicode else "[A-Za-z0-9_]"
    words = r"\s+".join(re.escape(w) for w in keyword.split())
    return rf"(?iu)(?<!{sign}){words}(?!{sign})"


def any_bounded(alternatives: str) -> str:
    """A pattern for alternatives with ASCII borders, ignoring case."""
    return rf"(?i)(?<![A-Za-z0-9_])({alternatives})(?![A-Za-z0-9_])"


def first_match(x: Column, rules: Sequence[tuple[str, str]] | Mapping[str, str], other: str) -> Column:
    """The label of the first pattern that the text matches."""
    out = None
    for label, pattern in rules.items() if isinstance(rules, Mapping) else rules:
        hit = x.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(other) if out is None else out.otherwise(other)


def contains_any(x: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword is part of the text, ignoring case."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(low, k)) if keywords else F.lit(False)


def json_object(x: Column) -> Column:
    """The first {...} without a brace inside, as models wrap their answers in prose; null without one."""
    return blank_to_null(F.regexp_extract(x, r"\{[^}]+\}", 0))


def labelled(key: Column, labels: Mapping[str, Mapping[str, str]], language: str, fallback: str = "zh") -> Column:
    """A text by key in a language, else in the fallback language, else the key."""
    def table(of: str) -> Column:
        entries = [F.lit(v) for kv in labels.get(of, {}).items() for v in kv]
        return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")

    return F.coalesce(F.try_element_at(table(language), key), F.try_element_at(table(fallback), key), key)


def fill(template: str, **values: Column) -> Column:
    """A template whose {name} places are filled by columns; a null fills with nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def front_matter(x: Column) -> Column:
    """The key: value lines between the two --- lines that a text begins with, as a map; the first of a key counts."""
    lines = F.split(F.regexp_extract(x, r"(?s)\A---\r?\n(.*?)\r?\n---", 1), r"\r?\n")
    entries = F.filter(F.transform(lines, lambda l: F.struct(F.trim(F.regexp_extract(l, r"^([^:#\s][^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(l, r"^[^:]*:(.*)$", 1)).alias("value"))), lambda e: e["key"] != "")
    first = F.element_at(F.transform(F.array(entries), lambda all_: F.filter(all_, lambda e, i: F.array_position(F.transform(all_, lambda o: o["key"]), e["key"]) == i + 1)), 1)
    return F.map_from_entries(first)


def markdown_links(x: Column) -> Column:
    """The targets of [text](target) links."""
    return F.regexp_extract_all(x, F.lit(r"\[[^\]\n]*\]\(([^)\s]+)\)"), F.lit(1))


def examples(x: Column) -> Column:
    """How many fenced blocks a text holds."""
    return F.floor(F.regexp_count(x, F.lit(r"(?m)^```")) / 2)
