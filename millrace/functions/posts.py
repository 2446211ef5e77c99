"""Expressions on news items and social posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import any_bounded, first_match
from .times import age_hours

#: Labels of posts and how they are recognised, first match first.
CONTENT_TYPES = {
    "教程/经验分享": r"(?i)经验|教程|step|how to|指南|分享",
    "观点评论": r"(?i)观点|认为|觉得|think|believe|opinion",
    "产品发布": r"(?i)发布|launch|release|announce|introducing|新功能",
    "研究解读": r"(?i)research|paper|study|论文|研究",
    "数据洞察": r"(?i)数据|data|统计|report|调查",
}
OTHER_CONTENT = "信息分享"
ANGLES = {
    "教程/经验分享": "提炼关键步骤，加入自己实践经验，降低阅读门槛",
    "观点评论": "引述原观点后加入自己的思考和延伸，提出不同视角或补充",
    "产品发布": "从用户视角解读价值点，对比同类产品，分析适用场景",
    "研究解读": "用通俗语言解释核心发现，补充背景知识，讨论实际影响",
    "数据洞察": "可视化关键数据，结合行业趋势解读，给出可操作建议",
    "信息分享": "提炼核心信息，加入个人见解或使用体验",
}
OTHER_ANGLE = "结合个人经验进行二次创作"
CATEGORIES = {
    "AI/ML": any_bounded("ai|artificial intelligence|machine learning|llm|gpt|claude|deep learning|neural|transformer|model|training|inference|rag|agent|openai|anthropic|gemini|chatgpt"),
    "Programming": any_bounded(r"code|coding|programming|developer|dev|api|javascript|typescript|python|rust|golang|react|vue|next\.?js|node\.?js|github|git|bug|debug|deploy|docker|kubernetes"),
    "Product": any_bounded("product|launch|feature|app|tool|startup|saas|ship|release|beta|announcement|introducing"),
    "Design": any_bounded("design|ui|ux|figma|css|layout|animation|typography|color|pixel|responsive|interface"),
    "Business": any_bounded("business|revenue|growth|market|investor|funding|valuation|profit|strategy|startup|founder|vc|enterprise"),
    "Science": any_bounded("research|paper|study|experiment|discovery|science|physics|biology|chemistry|arxiv|journal|peer.review"),
}
ORIGINAL, QUOTE, THREAD, REPLY, LONG = "原创", "引用", "线程", "回复", "长文"


def content_type(text: Column) -> Column:
    return first_match(text, CONTENT_TYPES, OTHER_CONTENT)


def rewrite_angle(kind: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in ANGLES.items() for v in kv))
    return F.coalesce(F.try_element_at(table, kind), F.lit(OTHER_ANGLE))


def category(text: Column) -> Column:
    return first_match(F.coalesce(text, F.lit("")), CATEGORIES, "Other")


def engagement(likes: Column, reposts: Column, bookmarks: Column) -> Column:
    """Likes, three times the reposts and twice the bookmarks; what is missing counts nothing."""
    return F.coalesce(likes, F.lit(0)) + 3 * F.coalesce(reposts, F.lit(0)) + 2 * F.coalesce(bookmarks, F.lit(0))


def article_score(published: Column, weight: Column, topic_score: Column, reference: Column) -> Column:
    """Recency (100, less 2 an hour), source weight and topic score; an unknown date has no recency."""
    recency = F.greatest(F.lit(0.0), 100 - 2 * age_hours(published, reference))
    return F.coalesce(recency, F.lit(0.0)) + F.coalesce(weight, F.lit(5)) * 10 * 0.5 + F.coalesce(topic_score, F.lit(0)) * 5 * 0.3


def full_text(full: Column, note: Column, text: Column) -> Column:
    """The first of the three that isn't empty, else an empty text."""
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(note, F.lit("")), text, F.lit(""))


def type_label(kind: Column) -> Column:
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit(ORIGINAL))


def is_link_only(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^https?://\S+$"), F.lit(False))


def short_count(n: Column) -> Column:
    """1.2M, 3.4K or the number itself."""
    tenth = lambda x: F.regexp_replace(F.format_number(x, 1), ",", "")
    return F.when(n >= 1_000_000, F.concat(tenth(n / 1_000_000), F.lit("M"))).when(n >= 1_000, F.concat(tenth(n / 1_000), F.lit("K"))).otherwise(F.coalesce(n, F.lit(0)).cast("string"))


def metrics_line(likes: Column, reposts: Column, replies: Column, views: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return F.format_string("likes %d, reposts %d, replies %d, views %d", zero(likes), zero(reposts), zero(replies), zero(views))


def username_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "^@", ""))


def icon(text: Column, icons: dict[str, str], other: str) -> Column:
    """The icon of the first keyword that the text contains."""
    out, low = None, F.lower(text)
    for word, sign in icons.items():
        out = F.when(F.contains(low, F.lit(word.lower())), sign) if out is None else out.when(F.contains(low, F.lit(word.lower())), sign)
    return F.lit(other) if out is None else out.otherwise(other)


def numeric_id(x: Column) -> Column:
    """64-bit ids are kept as texts and compared as numbers."""
    return F.expr("try_cast(null as decimal(20,0))") if x is None else x.try_cast("decimal(20,0)")
