"""Names of companies and titles, categories and directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ABBREVIATIONS, AREA_PREFIXES, COMPANY_SUFFIXES, DEFAULT_DIRECTION, OTHER_CATEGORY, TITLE_NOISE, UNKNOWN_CATEGORY, UNKNOWN_COMPANY, UNKNOWN_TITLE
from ..functions.text import abbreviations, bound, brackets, collapse, first_label, lookup, safe, without_space


def alias_map(aliases: dict[str, list[str]]) -> dict[str, str]:
    """alias -> canonical name; each name stands for itself, aliases also without blanks, later ones win."""
    out: dict[str, str] = {}
    for name, others in aliases.items():
        for a in (name, *others):
            for form in (a.strip(), "".join(a.split())):
                if form:
                    out[form] = name
    return out


def company(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """The company's plain name: alias, bracketed text and tail out, one suffix and one area prefix off, alias again."""
    aliases = aliases or {}

    def bare_of(raw: Column) -> Column:
        return without_space(F.regexp_replace(F.regexp_replace(raw, r"（.*?）|\(.*?\)|【.*?】|\[.*?\]", ""), r"(?s)[｜|/\\].*$", ""))

    def shorter_of(bare: Column) -> Column:
        # of nested suffixes the longest starts first, which is the one the ordered list takes
        short = F.regexp_replace(bare, f"(?<=.)({'|'.join(COMPANY_SUFFIXES)})$", "")
        return F.regexp_replace(short, f"^({'|'.join(AREA_PREFIXES)})(?=.{{3}})", "")

    def named(raw: Column, bare: Column, shorter: Column) -> Column:
        name = F.when(shorter != "", shorter).otherwise(raw)
        return F.when(raw == "", UNKNOWN_COMPANY).otherwise(F.coalesce(lookup(raw, aliases), lookup(bare, aliases), lookup(shorter, aliases), name))

    return bound(safe(c), lambda raw: bound(bare_of(raw), lambda bare: bound(shorter_of(bare), lambda shorter: named(raw, bare, shorter))))


def title_base(c: Column | str) -> Column:
    """The title without separators, noise words and punctuation; abbreviations in their usual case."""
    out = abbreviations(collapse(brackets(c)))
    out = F.regexp_replace(F.regexp_replace(out, r"[｜|/\\]", " "), "[-—_]+", " ")
    for noise in TITLE_NOISE:
        out = F.regexp_replace(out, noise, "")
    return without_space(F.regexp_replace(out, "[【】\\[\\]（）(),，。:：;；!！?？\"“”'‘’]", ""))


def title(c: Column | str, rules: dict[str, str] | None = None) -> Column:
    """The title's standard form: a rule for it as it is or cleaned, else an ordered heuristic, else cleaned."""
    rules = rules or {}

    def by_rule(s: Column) -> Column:
        has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(s, F.lit(w)) for w in ws])
        return (
            F.when(has("产品经理") & has("大模型", "LLM"), "大模型产品经理")
            .when(has("产品经理") & has("AI", "人工智能", "AIGC"), "AI产品经理")
            .when(has("数据分析", "BI") & ~has("工程师") & has("产品"), "数据产品经理")
            .when(has("数据分析", "BI") & ~has("工程师") & has("师", "分析"), "数据分析师")
            .when(has("算法工程师") & has("大模型", "LLM", "NLP"), "大模型算法工程师")
            .otherwise(s)
        )

    def named(raw: Column, s: Column) -> Column:
        return F.when(raw == "", UNKNOWN_TITLE).otherwise(F.coalesce(lookup(raw, rules), F.when(s == "", UNKNOWN_TITLE), lookup(s, rules), by_rule(s)))

    return bound(safe(c), lambda raw: bound(title_base(raw), lambda s: named(raw, s)))


def category(c: Column | str, rules: dict[str, list[str]]) -> Column:
    t = safe(c)
    return F.when((t == "") | (t == UNKNOWN_TITLE), UNKNOWN_CATEGORY).otherwise(first_label(t, rules, OTHER_CATEGORY))


def direction(title_norm: Column | str, detail: Column | str, rules: dict[str, list[str]]) -> Column:
    return first_label(F.concat_ws(" ", safe(title_norm), safe(detail)), rules, DEFAULT_DIRECTION)


def apply(jobs: DataFrame, aliases: dict[str, list[str]], rules: dict[str, dict]) -> DataFrame:
    """jobs with company_raw, company_norm, title_raw, title_norm, category, direction; columns that lack count as blank."""
    have = lambda name: F.col(name) if name in jobs.columns else F.lit("")
    out = jobs.withColumns({"company_raw": safe(have("company")), "title_raw": safe(have("title")), "_detail": safe(have("detail"))})
    out = out.withColumns({"company_norm": company("company_raw", alias_map(aliases)), "title_norm": title("title_raw", rules.get("normalization", {}))})
    out = out.withColumns({"category": category("title_norm", rules.get("category_rules", {})), "direction": direction("title_norm", "_detail", rules.get("direction_rules", {}))})
    return out.drop("_detail")


KNOWN_ABBREVIATIONS = tuple(ABBREVIATIONS.values())
