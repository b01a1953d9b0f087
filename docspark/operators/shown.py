"""An answer's Markdown for people: its sections, key points, sources and what else they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import grounding

# Headings that begin a section, a reference in an answer, and a key point's mark.
HEADING = r"(?i)^\s*(?:\*\*|#+\s*)?(answer|details|key\s*points|sources?|references?)\b[:\*]*\s*$"
REFERENCE = r"(?i)\[\s*(?:Source\s*)?(\d+)\s*\]"
POINT = r"^(?:[-*•]|\d+[.)])\s+(.*\S)"
SECTIONS = ("answer", "details", "sources", "references")


def without_references(answer: Column) -> Column:
    """An answer without its references and the gaps that they leave; other space before a stop is the text's own and stays."""
    text = F.regexp_replace(answer, rf"(?:[ \t]?{REFERENCE})+(?=[.,;:])", "")
    return X.strip(F.regexp_replace(F.regexp_replace(text, REFERENCE, ""), *grounding.GAPS[0]))


def section_of(heading: Column) -> Column:
    """The section that a heading begins; null for a line that is none."""
    word = F.lower(F.regexp_replace(F.regexp_extract(heading, HEADING, 1), r"\s", ""))
    return F.when(word.startswith("source"), "sources").when(word.startswith("reference"), "references").when(word.isin("details", "keypoints"), "details").when(word == "answer", "answer")


def sections(answer: Column) -> Column:
    """``struct<answer, details, sources, references>``: an answer's lines by the heading above them; lines above the first are the answer."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\r?\n"), lambda x: F.struct(x.alias("line"), section_of(x).alias("begins")))
    start = F.struct(F.lit("answer").alias("now"), *[F.lit("").alias(s) for s in SECTIONS])

    def put(state: Column, x: Column) -> Column:
        now = F.coalesce(x["begins"], state["now"])
        more = lambda s: F.when(x["begins"].isNull() & (now == s), F.concat(state[s], x["line"], F.lit("\n"))).otherwise(state[s])
        return F.struct(now.alias("now"), *[more(s).alias(s) for s in SECTIONS])

    return F.aggregate(lines, start, put, lambda s: F.struct(*[X.strip(s[x]).alias(x) for x in SECTIONS]))


def points(block: Column, most: int | None = None) -> Column:
    """The key points of a block: what stands behind a bullet or a number, line by line."""
    lines = F.transform(F.split(F.coalesce(block, F.lit("")), "\r?\n"), X.strip)
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, POINT, 1)), lambda x: x != "")
    return found if most is None else F.slice(found, 1, most)


def visible(answer: Column, most: int = 4) -> Column:
    """What of an answer is shown: its answer section and the first key points of its details."""
    s = sections(answer)
    return F.concat_ws("\n", s["answer"], F.array_join(F.transform(points(s["details"], most), lambda p: F.concat(F.lit("• "), p)), "\n"))


def shown_sources(answers: DataFrame, answer: str = "answer", sources: str = "sources", most: int = 4, chars: int = 320) -> DataFrame:
    """``answers`` with ``shown``: what is visible with its references renumbered, and ``cards``: number, title, category, url and preview of the sources it cites.

    Only sources that the visible text cites are shown, in its order; without a reference the first one is.
    """
    seen = visible(F.col(answer), most)
    chosen = grounding.displayed_sources(seen, F.col(sources))
    order = grounding.valid_citations(seen, F.size(sources))
    text = lambda s, name: F.coalesce(s[name], F.lit(""))
    cards = F.transform(chosen, lambda s, i: F.struct((i + 1).alias("number"), X.first_of(s["title"], F.lit("Untitled")).alias("title"), text(s, "category").alias("category"), X.safe_href(text(s, "url")).alias("url"), X.snippet(s["text"], chars).alias("preview")))
    return answers.withColumns({"shown": grounding.renumbered(seen, order), "cards": cards})


def related(answers: DataFrame, key: str, sources: str = "kept", most: int = 3) -> DataFrame:
    """``key, position, title, url`` of the documents that an answer's own sources stand for, each once, never of a new search."""
    each = answers.select(key, F.posexplode(sources).alias("position", "s")).select(key, "position", "s.title", "s.url")
    once = each.groupBy(key, "title", "url").agg(F.min("position").alias("position"))
    ranked = once.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "title", "url"))), 1, most).alias("r"))
    return ranked.select(key, F.explode("r").alias("r")).select(key, "r.*")
