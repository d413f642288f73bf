"""Text functions, Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword search leaves out.
SEARCH_STOPWORDS = ("的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这")
#: Words that are no keywords of a text.
KEYWORD_STOPWORDS = ("的", "了", "和", "是", "在", "有", "与", "这", "那", "之", "或", "及", "a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "with")
#: Capitalised words that are no entities.
COMMON_WORDS = ("I", "You", "He", "She", "It", "We", "They", "The", "A", "An")
#: Titles after Chinese names.
NAME_TITLES = ("先生", "女士", "老师", "教授", "博士")
#: Words of each topic area.
TOPICS = {
    "技术": ("python", "java", "javascript", "html", "css", "coding", "algorithm", "programming", "编程", "算法", "代码", "开发", "软件", "数据库", "测试", "部署", "服务器"),
    "商业": ("market", "business", "company", "strategy", "investment", "customer", "product", "市场", "商业", "公司", "策略", "投资", "客户", "产品", "营销", "销售"),
    "教育": ("education", "teaching", "learning", "student", "school", "university", "course", "教育", "教学", "学习", "学生", "学校", "大学", "课程", "培训"),
    "医疗": ("medical", "healthcare", "disease", "patient", "treatment", "medicine", "doctor", "医疗", "健康", "疾病", "患者", "治疗", "药物", "医生", "医院"),
}
#: White space as both Java and RE2 can spell it.
WS = r"[\x20\x09-\x0D]"
WORD = r"[\p{L}\p{N}_]+"
CJK = r"[\x{4e00}-\x{9fff}]"
_MARK = "\x01"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def normalize(text: Column) -> Column:
    """Everything but words and white space becomes a space; runs of white space are one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\x20\x09-\x0D]", " "), rf"{WS}+", " "))


#: A token: one Chinese character, or a run of other word characters.
TOKEN = rf"{CJK}|[\p{{L}}\p{{N}}_&&[^\x{{4e00}}-\x{{9fff}}]]+"


def tokens(text: Column, stopwords: tuple[str, ...] = SEARCH_STOPWORDS) -> Column:
    """Words of the normalised text, each Chinese character its own, without stop words; case is kept."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda x: ~x.isin(*stopwords))


def words(text: Column) -> Column:
    """Lower-cased words of two letters or more that aren't keyword stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), lambda x: (F.length(x) > 1) & ~x.isin(*KEYWORD_STOPWORDS))


def html_to_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), rf"{WS}+", " "))


def basic_markdown(text: Column) -> Column:
    """Paragraphs trimmed, the blank ones left out."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != ""), "\n\n")


def entities(text: Column) -> Column:
    """Distinct runs of capitalised words, without common single words, and names before Chinese titles."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-zA-Z]*(?:{WS}+[A-Z][a-zA-Z]*)*)(?![\p{{L}}\p{{N}}_])"), 1)
    good = F.filter(runs, lambda x: ~x.isin(*COMMON_WORDS) & ((F.length(x) > 3) | x.rlike(WS)))
    titles = "|".join(NAME_TITLES)
    return F.array_distinct(F.concat(good, F.regexp_extract_all(text, F.lit(rf"({CJK}{{2,3}})(?:{titles})"), 1)))


def topic_areas(keywords: Column) -> Column:
    return F.filter(F.array(*(F.when(F.arrays_overlap(keywords, F.array(*map(F.lit, terms))), F.lit(name)) for name, terms in TOPICS.items())), lambda x: x.isNotNull())


def time_references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]{4}年|[0-9]{4}-[0-9]{2}|[0-9]{4}/[0-9]{2}|[0-9]{4}\.[0-9]{2}"), 0)


def references(text: Column) -> Column:
    """Urls, then citations such as [3], as structs of type and value."""
    entry = lambda kind: lambda x: F.struct(F.lit(kind).alias("type"), x.alias("value"))
    urls = F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\x20\x09-\x0D]+"), 0), entry("url"))
    return F.concat(urls, F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), 1), entry("citation")))


def sentences_keeping_ends(text: Column) -> Column:
    """Pieces that end with a sentence sign and the white space after it; blank ones are left out."""
    marked = F.regexp_replace(text, rf"([.!?。！？；;]{WS}*)", "$1" + _MARK)
    return F.filter(F.split(marked, _MARK), lambda x: strip(x) != "")


def sentences(text: Column) -> Column:
    """Pieces between sentence signs that white space follows; the white space is dropped."""
    return F.split(F.regexp_replace(text, rf"([.!?。！？]){WS}+", "$1" + _MARK), _MARK)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def query_terms(query: Column) -> Column:
    """The query's terms of three letters or more, lower-cased."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(query), rf"{WS}+", " ")), " "), lambda x: F.length(x) > 2)


def _relevance(text: Column, terms: Column) -> Column:
    held = let(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))
    return F.when(F.size(terms) == 0, F.lit(0.5)).otherwise(held / F.size(terms))


def keyword_relevance(text: Column, query: Column) -> Column:
    """Share of the query's terms of three letters or more that the text holds; 0.5 where it has none."""
    return let(query_terms(query), lambda terms: _relevance(text, terms))


def core_sentences(text: Column, query: Column, ratio: float = 0.7) -> Column:
    """The sentences most relevant to the query, in their order; texts of up to three sentences stay whole."""

    def core(x: Column) -> Column:
        keep = F.greatest(F.lit(1), F.floor(F.size(x["pieces"]) * F.lit(ratio)).cast("int"))
        ranked = F.array_sort(F.transform(x["pieces"], lambda s, i: F.struct((-_relevance(s, x["terms"])).alias("r"), i.alias("i"), s.alias("s"))))
        return let(F.transform(F.slice(ranked, 1, keep), lambda y: y["s"]), lambda chosen: F.array_join(F.filter(x["pieces"], lambda s: F.array_contains(chosen, s)), " "))

    pieces = F.struct(sentences(text).alias("pieces"), query_terms(query).alias("terms"))
    return let(pieces, lambda x: F.when(F.size(x["pieces"]) <= 3, text).otherwise(core(x)))


def summary(text: Column, longest: int = 200) -> Column:
    cut = lambda first: F.when(F.length(first) > longest, F.concat(F.substring(first, 1, longest - 3), F.lit("..."))).otherwise(first)
    return let(F.array_join(F.slice(sentences(text), 1, 3), " "), cut)


def compressed(text: Column, query: Column, ratio: float = 0.7) -> Column:
    """Very relevant texts whole, relevant ones as their core sentences, others as a summary, or null where short."""
    by = lambda score: F.when(score > 0.8, text).when(score > 0.5, core_sentences(text, query, ratio)).when(F.length(text) > 50, summary(text))
    return let(keyword_relevance(text, query), by)


def slug(title: Column) -> Column:
    plain = F.lower(F.regexp_replace(title, "<[^>]*>", ""))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9一-龥]+", "-"), "^-+|-+$", "")


def embedded_metadata(chunk: Column, **fields: Column) -> Column:
    """The chunk with its non-empty lists of metadata appended."""
    parts = [F.when(F.size(v) > 0, F.concat(F.lit(f"{k}=["), F.array_join(v, ", "), F.lit("]; "))).otherwise(F.lit("")) for k, v in fields.items()]
    return F.concat(chunk, F.lit("\n\n---\n元数据: "), *parts)


def hash_bucket(term: Column) -> Column:
    """Bucket 0 to 63 of a term, from the first two hex digits of its MD5: four times the first one, and the second one modulo 4."""
    digits = F.conv(F.substring(F.md5(term), 1, 2), 16, 10).cast("int")
    return (F.shiftright(digits, 4) * 4 + digits.bitwiseAND(3)).cast("int")
