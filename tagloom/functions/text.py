"""Text functions as column expressions: cleaning, matching, snippets, sections, parsing.

Null and blank are one thing throughout: ``safe`` turns null into "" and strips Unicode space.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ABBREVIATIONS, CITIES, JD_REPAIRS, PRIVATE_DIGITS

ASCII_WORD = re.compile(r"[A-Za-z0-9_+#.\-]+")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without space at the ends, ideographic and no-break space included."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def safe(c: Column | str) -> Column:
    return strip(F.coalesce(col(c).cast("string"), F.lit("")))


def collapse(c: Column | str) -> Column:
    """Runs of space as one blank."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def without_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+", "")


def brackets(c: Column | str) -> Column:
    return F.translate(col(c), "（）", "()")


def bound(value: Column, make) -> Column:
    """make(value), with value worked out once a row: inside a lambda an expression is worked out for every element."""
    return F.transform(F.array(value), make)[0]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, words: list[str], fold: bool = True) -> Column:
    """Whether any word is contained, with case ignored if ``fold``."""
    text = F.lower(c) if fold else c
    return any_of([F.contains(text, F.lit(w.lower() if fold else w)) for w in words if w])


def first_label(c: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The first label, in order, any of whose keywords is contained, case ignored."""
    out = F.lit(default)
    for label, words in reversed(list(rules.items())):
        out = F.when(contains_any(c, [words] if isinstance(words, str) else words), label).otherwise(out)
    return out


def normalized(c: Column | str) -> Column:
    """Lower case, markup and addresses out, only CJK, letters, digits and + # . kept, blanks collapsed."""
    out = F.lower(safe(c))
    for pattern in ("<[^>]+>", r"(?U)https?://\S+", r"[\r\n\t]+", r"[^一-龥a-zA-Z0-9+#.]+"):
        out = F.regexp_replace(out, pattern, " ")
    return collapse(out)


def lookup(c: Column, known: dict[str, str]) -> Column:
    """The value of a literal map, null if there is none."""
    if not known:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), c)


def region(c: Column | str, cities: dict[str, str] | None = None) -> Column:
    """The city: of the whole text, else of the first part that is one, else the first contained in map order, else the text."""
    cities = CITIES if cities is None else cities
    s = strip(F.translate(safe(c), "·_", "--"))
    parts = F.transform(F.split(s, r"(?U)[-/|,，、\s]+"), lambda p: lookup(p, cities))
    held = F.coalesce(*[F.when(F.contains(s, F.lit(a)), to) for a, to in cities.items()], F.lit(None))
    return F.coalesce(lookup(s, cities), F.try_element_at(F.filter(parts, lambda p: p.isNotNull()), F.lit(1)), held, s)


def tokens(c: Column | str, stopwords: set[str] = frozenset(), low_value: set[str] = frozenset(), min_len: int = 2) -> Column:
    """Words of the normalised text without short, stop and low-value ones.

    Blanks and changes between CJK and other script part words; a CJK run is cut into
    overlapping pairs, the usual stand-in where no segmenter is installed.
    """
    spaced = F.regexp_replace(normalized(c), r"([一-龥]+)", " $1 ")
    pairs = lambda w: F.when(w.rlike(r"^[一-龥]{3,}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))
    words = F.flatten(F.transform(F.filter(F.split(spaced, " "), lambda w: w != ""), pairs))
    out = F.filter(words, lambda w: F.length(w) >= min_len)
    drop = sorted(set(stopwords) | set(low_value))
    return F.filter(out, lambda w: ~w.isin(drop)) if drop else out


def abbreviations(c: Column | str) -> Column:
    """Known abbreviations in their usual case where no ASCII letter adjoins."""
    out = col(c)
    for low, proper in sorted(ABBREVIATIONS.items(), key=lambda x: (-len(x[0]), x[0])):
        out = F.regexp_replace(out, f"(?i)(?<![A-Za-z]){re.escape(low)}(?![A-Za-z])", proper)
    return out


def boundary(word: str) -> str:
    """The pattern of a dictionary word: bounded if it is ASCII, else literal."""
    quoted = re.sub(r"([^A-Za-z0-9_一-龥 ])", r"\\\1", word)
    return f"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])" if ASCII_WORD.fullmatch(word) else quoted


def has_word(c: Column, word: str, case_sensitive: bool = False) -> Column:
    """Whether a dictionary word occurs; the cheap containment test goes first."""
    text, w = (c, word) if case_sensitive else (F.lower(c), word.lower())
    if not w:
        return F.lit(False)
    held = F.contains(text, F.lit(w))
    return held & text.rlike(boundary(w)) if ASCII_WORD.fullmatch(w) else held


def count_word(c: Column, word: str) -> Column:
    """How often a dictionary word occurs, case ignored, without overlaps."""
    text, w = F.lower(c), word.lower()
    if ASCII_WORD.fullmatch(w):
        return F.regexp_count(text, F.lit(boundary(w)))
    return ((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / F.lit(len(w))).cast("int")


def snippet(c: Column, word: Column | str, window: int) -> Column:
    """The first literal occurrence, case ignored, with ``window`` characters on both sides; "" without one."""
    w = F.lit(word) if isinstance(word, str) else word
    at = F.instr(F.lower(c), F.lower(w))
    start = F.greatest(at - window, F.lit(1))
    return F.when((at > 0) & (F.length(w) > 0), F.substring(c, start, at + F.length(w) + window - start)).otherwise(F.lit(""))


def bounded_snippet(c: Column, word: str, window: int) -> Column:
    """As ``snippet``, but dictionary boundaries hold; line breaks become blanks and ends are stripped."""
    at = F.regexp_instr(c, F.lit("(?i)" + boundary(word)))
    start = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, strip(F.replace(F.substring(c, start, at + len(word) + window - start), F.lit("\n"), F.lit(" ")))).otherwise(F.lit(""))


def repaired(c: Column | str) -> Column:
    """A posting's text: space unified, known recognition errors mended, A as AI before its nouns."""
    out = collapse(safe(c))
    for wrong, right in JD_REPAIRS.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.regexp_replace(out, "(?<![A-Za-z])A(?=(智能体|系统|对话|服务|项目|工具|应用|平台))", "AI")


def section(c: Column, starts: list[str], stops: list[str]) -> Column:
    """What stands after the earliest start marker (of equals the first named) and before the next stop marker."""
    begins = F.array(*[F.struct(F.lit(m).alias("mark"), F.lit(i).alias("turn"), F.lit(len(m)).alias("size")) for i, m in enumerate(starts)])
    ends = F.array(*[F.lit(m) for m in stops])

    def inside(t: Column, begin: Column) -> Column:
        end = F.array_min(F.filter(F.transform(ends, lambda m: F.call_function("locate", m, t, begin)), lambda at: at > 0))
        return F.regexp_replace(F.substring(t, begin, F.coalesce(end, F.length(t) + 1) - begin), "^[ ：:;；]+|[ ：:;；]+$", "")

    def found(t: Column) -> Column:
        first = F.array_min(F.filter(F.transform(begins, lambda b: F.struct(F.instr(t, b["mark"]).alias("at"), b["turn"].alias("turn"), b["size"].alias("size"))), lambda x: x["at"] > 0))
        return bound(first, lambda f: F.when(f.isNull(), F.lit("")).otherwise(bound(f["at"] + f["size"], lambda begin: inside(t, begin))))

    return bound(c, found)


def clean_html_text(c: Column | str, keep_lines: bool = True) -> Column:
    """Captured text: tags, no-break and zero-width characters out, blanks and empty lines collapsed."""
    out = F.coalesce(col(c).cast("string"), F.lit(""))
    out = F.regexp_replace(out, "(?i)<br\\s*/?>|</p>|</div>|</li>", "\n") if keep_lines else out
    out = F.regexp_replace(out, "<[^>]+>", "" if keep_lines else " ")
    out = F.translate(out, " 　​‌‍﻿", "  ")
    if not keep_lines:
        return collapse(out)
    out = F.regexp_replace(F.regexp_replace(out, "\r\n?", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, " *\n *", "\n"), "\n{2,}", "\n"))


def digits(c: Column | str) -> Column:
    """Private-use digits of a salary text as plain ones."""
    return F.translate(col(c), "".join(PRIVATE_DIGITS), "".join(PRIVATE_DIGITS.values()))


def absolute_url(c: Column | str, host: str) -> Column:
    """Absolute addresses as they are; protocol- and root-relative ones completed."""
    u = safe(c)
    return F.when(u.rlike("^https?://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(F.lit(host), u)).otherwise(u)


def html_title(c: Column | str) -> Column:
    return collapse(F.regexp_extract(F.coalesce(col(c), F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1))


def urls(c: Column | str) -> Column:
    """The distinct http addresses among blank-separated words, in order."""
    return F.array_distinct(F.filter(F.split(safe(c), r"(?U)[\s,，;；]+"), lambda w: w.rlike("^https?://")))


def distinct_lines(c: Column | str) -> Column:
    """Line ends unified, blanks collapsed, and each non-blank line only once."""
    text = F.regexp_replace(F.regexp_replace(safe(c), "\r\n?", "\n"), "[ \t 　]+", " ")
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")


def distinct_folded(c: Column, max_items: int | None = None) -> Column:
    """Array elements distinct with case ignored, the first of each kept, at most ``max_items``."""
    has = lambda a, x: F.exists(a, lambda y: F.lower(y) == F.lower(x))
    out = F.aggregate(c, F.array().cast("array<string>"), lambda a, x: F.when(has(a, x), a).otherwise(F.array_append(a, x)))
    return F.slice(out, 1, max_items) if max_items else out


def norm_list(c: Column, split: str | None = r"[，,；;、\n]+", strip_chars: str = "", max_items: int | None = None, max_len: int | None = None, fold: bool = False) -> Column:
    """A clean list from a text (cut at ``split``) or an array: stripped, blanks out, cut, distinct, in first-seen order."""
    c = col(c)
    items = F.split(F.coalesce(c, F.lit("")), split) if split else F.coalesce(c, F.array().cast("array<string>"))
    edge = re.sub(r"([\\\]\[^-])", r"\\\1", strip_chars)
    clean = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), rf"(?U)^[\s{edge}]+|[\s{edge}]+$", "")
    items = F.filter(F.transform(items, clean), lambda x: x != "")
    if max_len:
        items = F.transform(items, lambda x: F.substring(x, 1, max_len))
    if fold:
        return distinct_folded(items, max_items)
    items = F.array_distinct(items)
    return F.slice(items, 1, max_items) if max_items else items


def array_tags(c: Column | str) -> Column:
    """An array cell's tags: stripped, blanks and nulls out, distinct; null is empty."""
    a = F.coalesce(col(c), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(a, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def by_length(c: Column) -> Column:
    """Sorted by falling length, then by lower case, then as they are."""
    return F.array_sort(c, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))


def mended_json(body: Column) -> Column:
    """JSON text with trailing commas out and curly quotes straight."""
    return F.regexp_replace(F.translate(body, "“”", '""'), r",\s*([}\]])", "$1")


def without_fence(c: Column | str) -> Column:
    """A model's answer without the code fence around it."""
    return strip(F.regexp_replace(strip(F.regexp_replace(safe(c), "(?i)^```(?:json)?", "")), "```$", ""))


def loose_json(c: Column | str, schema: str, otherwise: str | None = None) -> Column:
    """A struct from a model's answer: what stands between the outermost braces, mended only if it does not parse as it is.

    If nothing parses, null; or, with ``otherwise``, a struct with the whole answer in that field. A blank answer is null.
    """
    body = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?s)\{.*\}", 0)
    sound = lambda x: F.try_parse_json(F.nullif(x, F.lit(""))).isNotNull()
    out = F.when(sound(body), F.from_json(body, schema)).when(sound(mended_json(body)), F.from_json(mended_json(body), schema))
    if otherwise is None:
        return out
    whole = without_fence(c)
    return F.when(out.isNotNull(), out).when(whole != "", F.from_json(F.to_json(F.struct(whole.alias(otherwise))), schema))


def latex(c: Column | str) -> Column:
    """Escaped for LaTeX, one replacement after the other: the backslash first, so its own braces are escaped too."""
    out = F.coalesce(col(c), F.lit(""))
    for plain, escaped in (("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 for empty, unequal or zero ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))
