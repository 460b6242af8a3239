"""Scalar text functions: column in, column out, all inside the JVM.

Patterns given as data follow the usual Perl-like syntax with these flags: case-insensitive with Unicode case, Unicode classes, `.` stops at `\\n` only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iudU)"
CASED = "(?udU)"
CJK = "[一-鿿]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: a column that an expression names many times is else computed as often, above all inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(x: Column | str) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(F.regexp_replace(col(x), r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def normalized(x: Column | str) -> Column:
    """FN-1: no white space, punctuation in one form. Curly quotes stay as they are."""
    return F.translate(F.regexp_replace(col(x), r"(?U)\s+", ""), "（）【】：，。；！？—–", "()[]:,.;!?--")


def text_hash(x: Column | str) -> Column:
    """FN-2: 16 hex digits of the SHA-256 of the normalized text."""
    return F.substring(F.sha2(normalized(x), 256), 1, 16)


def grams(x: Column | str, n: int = 3) -> Column:
    """Distinct character n-grams; empty if the text is shorter than n."""

    def of(c: Column) -> Column:
        at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n))))

    return let(col(x), of)


def gram_codes(x: Column | str) -> Column:
    """The distinct 3-grams of a text of three characters at least as numbers (21 bits a character), in time linear in its length."""
    wide = lambda c, i: F.get(c, i).cast("long")
    one = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.shiftleft(wide(c, i), 42) + F.shiftleft(wide(c, i + 1), 21) + wide(c, i + 2))
    return let(F.transform(F.split(col(x), ""), F.ascii), lambda c: F.array_distinct(one(c)))


def overlap(a: Column, b: Column, of: str = "min") -> Column:
    """FN-4 ("min") and SEG-4 ("max"): common grams by the size of the smaller or larger set; 0 if either is empty."""
    size = F.least(F.size(a), F.size(b)) if of == "min" else F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / size).otherwise(F.lit(0.0))


def ngram_overlap(a: Column | str, b: Column | str, n: int = 3) -> Column:
    return overlap(grams(normalized(a), n), grams(normalized(b), n))


def first_match(x: Column | str, patterns: list[tuple[str, int]]) -> Column:
    """The group of the first pattern that is found; null if none is."""
    c = col(x)
    return F.coalesce(*(F.when(c.rlike(p), F.regexp_extract(c, p, g)) for p, g in patterns))


def section_name(x: Column | str) -> Column:
    """FN-6: the section that a location or description names; '' if none."""
    # fixed values: the forms of a location
    forms = [("《([^》]+)》", 1), ("缺少《(.+?)》", 1), ("应在《(.+?)》中", 1), (r"(?U)^(.+?)[\s~:：]", 1)]
    return F.coalesce(strip(first_match(F.coalesce(col(x), F.lit("")), forms)), F.lit(""))


def tokens_estimate(x: Column | str, ratio: float = 2.0) -> Column:
    """FN-7"""
    return F.ceil(F.length(col(x)) * F.lit(ratio)).cast("long")


def risk_of_score(x: Column | str) -> Column:
    """FN-8"""
    c = col(x)
    return F.when(c >= 85, "pass").when(c >= 60, "medium").when(c >= 40, "high").otherwise("critical")


def risk_penalty(risk: Column | str, weight: Column | str) -> Column:
    """FN-9. Any level but high and medium, critical included, counts as low."""
    r, w = col(risk), col(weight)
    high = F.when(w >= 20, 15.0).when(w >= 10, 10.0).otherwise(8.0)
    medium = F.when(w >= 15, 7.0).when(w >= 5, 5.0).otherwise(3.0)
    return F.when(r == "high", high).when(r == "medium", medium).otherwise(F.when(w >= 10, 2.0).otherwise(1.0))


def line_of(text: Column | str, start: Column | str) -> Column:
    """FN-10: number of the line of an offset, from 1."""
    return F.regexp_count(F.left(col(text), col(start)), F.lit("\n")) + 1


def context_of(text: Column | str, start: Column | str, length: Column, around: int = 20) -> Column:
    """FN-10: the match with so many characters on both sides, on one line, trimmed."""
    s = col(start)
    a = F.greatest(s - around, F.lit(0))
    return strip(F.replace(F.substring(col(text), a + 1, s + length + around - a), F.lit("\n"), F.lit(" ")))


def cost(prompt: Column | str, completion: Column | str, price_in: Column | str, price_out: Column | str) -> Column:
    """FN-11"""
    return col(prompt) / 1000 * col(price_in) + col(completion) / 1000 * col(price_out)


def json_array(x: Column | str, schema: str) -> Column:
    """FN-12: the array of JSON objects in an answer: fenced as json, fenced, the whole text, or from the first [ to the last ]; null if none parses."""
    c = col(x)

    def parsed(t: Column) -> Column:
        t = F.trim(t)
        got = F.from_json(t, schema, {"mode": "PERMISSIVE"})
        return F.when(F.json_array_length(t).isNotNull(), got)

    fences = [parsed(F.nullif(F.regexp_extract(c, p, 1), F.lit(""))) for p in (r"(?s)```json\s*(\[.*?\])\s*```", r"(?s)```\s*(\[.*?\])\s*```")]
    return F.coalesce(*fences, parsed(c), parsed(F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit(""))))


# fixed values: decision by the first of these words that the text has
DECISIONS = [("驳回投诉", "rejected"), ("驳回", "rejected"), ("投诉不成立", "rejected"), ("投诉成立", "upheld"), ("责令重新", "upheld"), ("中标无效", "upheld"), ("部分成立", "partial"), ("部分", "partial"), ("撤销合同", "upheld"), ("废标", "upheld"), ("重新开展", "upheld")]


def decision_type(x: Column | str, decisions: list[tuple[str, str]] | None = None, none: str = "dismissed") -> Column:
    """FN-13"""
    c = col(x)
    return F.coalesce(*(F.when(c.contains(k), F.lit(v)) for k, v in decisions or DECISIONS), F.lit(none))


def labelled_field(x: Column | str, label: str, most: int = 500) -> Column:
    """FN-14: what follows a label, to the next numbered heading, known heading, blank line, or the end; cut to so many characters and `...`."""
    # fixed values: where a field ends
    ends = [r"(.+?)(?:\n(?:[一二三四五六七八九十]、|$))", "(.+?)(?:[一二三四五六七八九十]、|基本情况|处理依据及结果|处理依据|处理决定|其他补充)", r"(.+?)(?:\n\n)", "(.+)"]
    found = strip(first_match(x, [(rf"(?sU){label}[：:]\s*{e}", 1) for e in ends]))
    return F.coalesce(F.when(F.length(found) > most, F.concat(F.left(found, F.lit(most)), F.lit("..."))).otherwise(found), F.lit(""))


def last_date(x: Column | str, pattern: str = r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日") -> Column:
    """FN-15: the last date of a text as yyyy-MM-dd; '' if none."""
    c = col(x)
    year, month, day = (F.element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(i)), -1) for i in (1, 2, 3))
    return F.when(c.rlike(pattern), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))).otherwise(F.lit(""))


# fixed values: words that tag a complaint
TAGS = ["参数", "品牌", "排他", "指向", "歧视", "授权", "检测报告", "资质", "中小企业", "虚假", "串通", "低价", "异常低价", "评分", "评审", "混包", "标准", "进口", "认证", "业绩", "售后"]


def tags(x: Column | str, words: list[str] | None = None) -> Column:
    """FN-16: the words of a list that a text contains, in the order of the list."""
    c = col(x)
    return F.filter(F.array(*map(F.lit, words or TAGS)), lambda k: c.contains(k))


# fixed values: names of procurement methods, the first that a name contains
METHODS = [("公开招标", "公开招标"), ("邀请招标", "邀请招标"), ("竞争性谈判", "竞争性谈判"), ("谈判", "竞争性谈判"), ("竞争性磋商", "竞争性磋商"), ("磋商", "竞争性磋商"), ("询价", "询价"), ("单一来源", "单一来源"), ("资格预审", "资格预审")]


def procurement_method(x: Column | str) -> Column:
    """FN-17: method of a template's name, or the name."""
    c = col(x)
    return F.coalesce(*(F.when(c.contains(k), F.lit(v)) for k, v in METHODS), c)


def short_id(prefix: str, x: Column | str) -> Column:
    """FN-18"""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(col(x)), 1, 8)))


def valid_rule_id(x: Column | str) -> Column:
    """FN-19"""
    return F.coalesce(col(x).rlike(r"^[A-Z0-9_-]{3,32}\z"), F.lit(False))


def period_key(x: Column | str) -> Column:
    """FN-20"""
    return F.date_format(col(x), "yyyy-MM")


# fixed values: forms of a blank to fill in
PLACEHOLDERS = [
    "[（(][^）)]*?(?:项目名称|采购人|招标人|供应商|投标人|金额|日期|时间|地点|地址|名称|编号|数量|规格|参数|要求|内容|说明|填写|自定|根据|视情|协商|约定)[^）)]*?[）)]",
    "[（(][^）)]{0,30}[）)]",
    "【[^】]{0,50}】",
    "[Xx_＿]{2,}",
    "(?:根据项目|根据实际|视项目|按项目|协商|约定|自定|参照).{0,20}(?:确定|执行|处理|填写)",
    "此处.*?(?:填写|填入|插入|自定|自定义)",
    "详见.{0,20}(?:附件|附表|下文|下表|要求)",
]


#: Each blank and each sign of template text (operators.label) holds one of these: a text without any needs no further look.
SIGNED = "[Xx_＿]{2}|[(（【□一-鿿]"


def is_placeholder(x: Column | str, of: str = "fingerprint") -> Column:
    """FN-21: either of the two lists ("fingerprint", "marker")."""
    extra = "（.*?）" if of == "fingerprint" else "□"
    return col(x).rlike(SIGNED) & col(x).rlike(CASED + "|".join([*PLACEHOLDERS, extra]))


def budget(x: Column | str) -> Column:
    """SEG-15: the first budget of a text, in units (万 is 10,000); null if none parses."""
    # fixed values: forms of a budget
    forms = [
        r"(?:预算|采购预算|项目预算|预算金额|最高限价)[：:\s]*([0-9][0-9,.]*)\s*(?:万元|万元人民币|元)",
        r"(?:预算|采购预算|项目预算)[：:\s]*人民币\s*([0-9][0-9,.]*)\s*(?:万元|元)",
        r"([0-9][0-9,.]*)\s*(?:万元|元)\s*(?:人民币)?[。，,\s]*(?:预算|最高限价)",
    ]
    c = col(x)

    def one(p: str) -> Column:
        amount = F.replace(F.regexp_extract(c, "(?U)" + p, 1), F.lit(","), F.lit("")).try_cast("double")
        return amount * F.when(F.regexp_extract(c, "(?U)" + p, 0).contains("万"), 10_000.0).otherwise(1.0)

    # each form has one of the words, so other texts need no look
    return F.when(c.contains("预算") | c.contains("最高限价"), F.coalesce(*map(one, forms)))


# fixed values: pairs of words that count as near
SYNONYMS = [("指定品牌", "指定"), ("唯一授权", "唯一"), ("指定型号", "指定"), ("本地注册", "本地"), ("注册资金", "注册"), ("本市注册", "本市"), ("地域限制", "限制"), ("独家", "独家"), ("必须", "必须"), ("倾向", "倾向"), ("仅限", "仅限")]


def similarity(a: Column | str, b: Column | str) -> Column:
    """FN-5: longest common substring (2 characters at least) by the length of the shorter text, or 0.6 / 0.8 for a near pair; lower-cased; 3 decimals."""
    x, y = F.lower(col(a)), F.lower(col(b))
    pair = F.struct(F.when(F.length(x) <= F.length(y), x).otherwise(y).alias("s"), F.when(F.length(x) <= F.length(y), y).otherwise(x).alias("t"))

    def longest(p: Column) -> Column:
        # a common substring has common substrings of every smaller length, so its length is found by halving; one length compares two sets
        pieces = lambda t, k: F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substring(t, i, k))
        n = F.length(p["s"])

        def halve(acc: Column, _: Column) -> Column:
            def one(k: Column) -> Column:
                found = F.arrays_overlap(pieces(p["s"], k), pieces(p["t"], k))
                return F.when(found, F.struct(k.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), (k - 1).alias("hi")))

            return F.when(acc["lo"] < acc["hi"], let(F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int"), one)).otherwise(acc)

        rounds = F.sequence(F.lit(1), F.length(F.bin(n.cast("long"))))
        size = F.aggregate(rounds, F.struct(F.lit(1).alias("lo"), n.alias("hi")), halve, lambda acc: acc["lo"])
        return F.when((n >= 2) & (size >= 2), size).otherwise(F.lit(0)) / F.greatest(n, F.lit(1))

    near = reduce(F.greatest, [F.when((x.contains(p) & y.contains(q)) | (x.contains(q) & y.contains(p)), 0.6).when(x.contains(p) & y.contains(p), 0.8).otherwise(0.0) for p, q in SYNONYMS])
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), F.lit(0.0)).otherwise(F.bround(F.greatest(let(pair, longest), near), 3))


def sentences(x: Column | str) -> Column:
    """Pieces after each of 。！？； and line feed, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(x), r"(?U)(?<=[。！？；\n])\s*", -1), strip), lambda s: s != "")


def template_sentences(x: Column | str) -> Column:
    """SEG-14: sentences that are more than digits and signs, with three CJK characters at least."""
    return F.filter(sentences(x), lambda s: ~s.rlike(r"(?U)^[\d\s.,;:!?\-_/\\|()\[\]{}]+\z") & (F.regexp_count(s, F.lit(CJK)) >= 3))


def matches(text: Column | str, pattern: Column | str) -> Column:
    """array<struct<start, match>> of all matches of a pattern that never matches the empty string; start counts characters from 0."""
    t, p = col(text), col(pattern)
    # the gap before each match; the gap after the last one is left out
    parts = F.arrays_zip(F.split(t, p, -1).alias("gap"), F.regexp_extract_all(t, p, F.lit(0)).alias("match"))
    kind = "array<struct<start:int,match:string>>"
    one = lambda acc, x: F.struct((acc["pos"] + F.length(x["gap"])).alias("start"), x["match"].alias("match"))
    step = lambda acc, x: F.when(x["match"].isNull(), acc).otherwise(F.struct((acc["pos"] + F.length(x["gap"]) + F.length(x["match"])).alias("pos"), F.array_append(acc["out"], one(acc, x)).alias("out")))
    return F.aggregate(parts, F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
