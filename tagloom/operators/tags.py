"""Dictionary and rule tags, their fusion, and traits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DUTY_SPECS, HARD_SPECS, JOB_TYPE_SPECS, SCENE_SPECS, SECTIONS, SOFT_SPECS, TOOL_SPECS
from ..functions.text import ASCII_WORD, array_tags, bound, by_length, contains_any, count_word, distinct_folded, has_word, lookup, norm_list, repaired, safe, section

TYPES = {"hard": "hard_tags", "soft": "soft_tags", "duty": "duty_tags", "scene": "scene_tags"}


def leaf_words(tree: object) -> list[str]:
    """The distinct words of a dictionary of any depth, in order."""
    out: dict[str, None] = {}
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, (list, tuple, set)):
            stack.extend(reversed(list(x)))
        elif x is not None and str(x).strip():
            out[str(x).strip()] = None
    return list(out)


def text_of(title_norm: str, title_raw: str, detail: str) -> Column:
    """The non-blank of three columns joined by a blank."""
    return F.array_join(F.filter(F.array(safe(title_norm), safe(title_raw), safe(detail)), lambda x: x != ""), " ")


def found(text: Column, words: list[str], synonyms: dict[str, str] | None = None) -> Column:
    """Dictionary words in a text, through synonyms, distinct, longest first.

    Words of letters, digits and _ are looked up among the text's own words in one pass;
    others are tested one by one.
    """
    low = F.lower(text)
    plain = {w.lower(): w for w in words if w.isascii() and w.replace("_", "a").isalnum()}
    own = F.split(low, "[^a-z0-9_]+")
    hits = F.transform(F.array_intersect(own, F.array(*[F.lit(w) for w in plain])), lambda w: lookup(w, plain)) if plain else F.array().cast("array<string>")
    others = [F.when(has_word(text, w), F.lit(w)) for w in words if w.lower() not in plain or plain[w.lower()] != w]
    if others:
        hits = F.concat(hits, F.array_compact(F.array(*others)))
    if synonyms:
        hits = F.transform(hits, lambda w: F.coalesce(lookup(w, synonyms), w))
    return by_length(F.array_distinct(hits))


def apply_dictionary(jobs: DataFrame, dictionary: dict[str, object], text: Column, synonyms: dict[str, str] | None = None) -> DataFrame:
    """jobs with an array column for each type of the dictionary, and all_tags, their union."""
    out = jobs.withColumns({TYPES.get(k, k): found(text, leaf_words(v), synonyms) for k, v in dictionary.items()})
    return out.withColumn("all_tags", by_length(F.array_distinct(F.concat(*[F.col(TYPES.get(k, k)) for k in dictionary]))))


def held(text: Column, patterns: Column) -> Column:
    """The patterns, in lower case, that are contained, case ignored."""
    return bound(F.lower(text), lambda low: F.filter(patterns, lambda p: F.contains(low, p)))


def labels_of(hits: Column, specs: dict[str, list[str]]) -> Column:
    """Labels, in order, any of whose patterns is among hits: one walk through a literal list, whatever its length."""
    known = F.array(*[F.struct(F.lit(k).alias("label"), F.array(*[F.lit(x.lower()) for x in p]).alias("patterns")) for k, p in specs.items()])
    return F.transform(F.filter(known, lambda s: F.arrays_overlap(s["patterns"], hits)), lambda s: s["label"])


def rule_profile(jobs: DataFrame, detail: str, sections: tuple[str, ...] = ()) -> DataFrame:
    """jobs with the rule columns of a posting's text, each after an underscore, and the named sections as _at_<name>.

    The mended text, its sections and the patterns found are columns of their own first, so that
    no expression holds them more than once. The whole text is searched once for each pattern; a
    section is part of it, so only what the text holds is looked for there, and patterns with
    blanks, which may stand across joined sections.
    """
    specs = (HARD_SPECS, SOFT_SPECS, DUTY_SPECS, SCENE_SPECS, JOB_TYPE_SPECS, TOOL_SPECS)
    every = list(dict.fromkeys(p.lower() for s in specs for ps in s.values() for p in ps))
    out = jobs.withColumn("_source", repaired(detail))
    out = out.withColumns({f"_at_{k}": section(F.col("_source"), *marks) for k, marks in SECTIONS.items()} | {"_hits": held(F.col("_source"), F.array(*[F.lit(p) for p in every]))})
    more = F.array_join(F.filter(F.array("_at_bonus", "_at_offer", "_at_highlights"), lambda x: x != ""), " ")
    spaced = F.array(*[F.lit(p) for p in every if " " in p]).cast("array<string>")
    own = lambda k: F.when(F.col(f"_at_{k}") != "", held(F.col(f"_at_{k}"), F.col("_hits"))).otherwise(F.col("_hits"))
    out = out.withColumns({"_duty_hits": own("responsibilities"), "_want_hits": own("requirements"), "_more_hits": held(more, F.array_union("_hits", spaced))})
    source, duty, want, more = (F.col(c) for c in ("_hits", "_duty_hits", "_want_hits", "_more_hits"))
    out = out.withColumns({
        "_rule_hard": labels_of(source, HARD_SPECS),
        "_rule_soft": labels_of(want, SOFT_SPECS),
        "_rule_duties": labels_of(duty, DUTY_SPECS),
        "_rule_requirements": labels_of(want, HARD_SPECS | SOFT_SPECS),
        "_rule_bonus": F.array_distinct(F.concat(labels_of(more, HARD_SPECS), labels_of(more, DUTY_SPECS), labels_of(more, SCENE_SPECS))),
        "_rule_industry": labels_of(source, SCENE_SPECS),
        "_rule_job_type": labels_of(source, JOB_TYPE_SPECS),
        "_rule_must": labels_of(want, HARD_SPECS),
        "_rule_nice": labels_of(more, HARD_SPECS),
        "_rule_tools": labels_of(source, TOOL_SPECS),
    })
    goal = F.when(F.size("_rule_duties") > 0, F.col("_rule_duties")).otherwise(F.col("_rule_industry"))
    out = out.withColumn("_rule_goal", F.substring(F.array_join(F.slice(goal, 1, 3), "、"), 1, 25))
    return out.drop("_source", "_hits", "_duty_hits", "_want_hits", "_more_hits", *[f"_at_{k}" for k in SECTIONS if k not in sections])


def apply_rules(jobs: DataFrame, detail: str, overwrite: bool = False, cap: int = 30) -> DataFrame:
    """Rule columns, filled where blank or all if ``overwrite``; rule hits appended to the tag columns, at most ``cap``."""
    blank = lambda c: (F.size(F.coalesce(F.col(c), F.array())) == 0) if dict(jobs.dtypes)[c].startswith("array") else (safe(c) == "")
    out = rule_profile(jobs, detail)
    made = [c for c in out.columns if c.startswith("_rule_")]
    own = [c[1:] for c in made if c not in ("_rule_hard", "_rule_soft")]
    out = out.withColumns({k: F.col(f"_{k}") if overwrite or k not in jobs.columns else F.when(blank(k), F.col(f"_{k}")).otherwise(F.col(k)) for k in own})
    have = lambda c: array_tags(c) if c in jobs.columns else F.array().cast("array<string>")
    join = {"hard_tags": "_rule_hard", "soft_tags": "_rule_soft", "duty_tags": "_rule_duties", "scene_tags": "_rule_industry"}
    out = out.withColumns({t: distinct_folded(F.concat(have(t), F.col(r)), cap) for t, r in join.items()})
    out = out.withColumn("all_tags", distinct_folded(F.concat(*[F.col(t) for t in join]), cap))
    return out.drop(*made)


def resolver(known: dict[str, str]) -> Callable[[Column], Column]:
    """An element's canonical name, case ignored, else itself."""
    return lambda x: F.coalesce(lookup(F.lower(x), known), x)


def fuse(jobs: DataFrame, sources: dict[str, list[str]], aliases: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """final_<type>_tags: the listed columns (arrays, or texts cut at separators) in order, aliases resolved, distinct; final_all_tags their union in order."""
    aliases, kinds = aliases or {}, dict(jobs.dtypes)
    made = {}
    for kind, columns in sources.items():
        items = F.concat(F.array().cast("array<string>"), *[array_tags(c) if kinds[c].startswith("array") else norm_list(c) for c in columns if c in kinds])
        known = {k.lower(): v for k, v in aliases.get(kind, {}).items()}
        made[f"final_{kind}_tags"] = F.array_distinct(F.transform(items, resolver(known)))
    out = jobs.withColumns(made)
    return out.withColumn("final_all_tags", F.array_distinct(F.concat(*[F.col(c) for c in made])))


def traits(jobs: DataFrame, tree: dict[str, dict[str, list[str]]], text: str, keep: list[str]) -> DataFrame:
    """A row for each job and trait with hits: the kept columns, l1, l2, hits (sum over the trait's distinct keywords)."""
    entries = [F.struct(F.lit(a).alias("l1"), F.lit(b).alias("l2"), sum((count_word(F.col(text), w) for w in {w.lower(): w for w in ws}.values()), F.lit(0)).alias("hits")) for a, group in tree.items() for b, ws in group.items()]
    source = jobs.withColumn(text, F.coalesce(text, F.lit("")))
    return source.select(*keep, F.inline(F.array(*entries))).filter("hits > 0")


def is_bounded(word: str) -> bool:
    """Whether a dictionary word is matched with boundaries."""
    return bool(ASCII_WORD.fullmatch(word))
