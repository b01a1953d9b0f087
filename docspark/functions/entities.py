"""People in queries and author fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import strip

# Titles before a name.
HONORIFICS = "dr prof professor mr mrs ms shri smt".split()
# Words that say a question is about what someone wrote.
AUTHORSHIP = """written write writes wrote author authored authors publish published publication publications blog blogs
article articles paper papers brief briefs report reports op-ed op-eds piece pieces work works contributed contribution
contributions""".split()
# Capitalised words of a question that are no names.
NO_NAMES = "what which who where when why how does is are was were has have india indian".split()

# Topics that pages state where an author should be.
TOPICS = (
    "ai", "artificial intelligence", "geopolitics", "governance", "technology", "policy", "public policy", "economy", "economics", "security", "defence", "defense", "strategy", "science", "health", "education", "climate", "energy",
    "trade", "data", "digital", "cyber", "cybersecurity", "china", "india", "indo-pacific", "staff", "admin", "blog", "blogs", "article", "articles", "publication", "publications", "newsletter", "newsletters", "report", "reports",
    "commentary", "research", "opinion", "analysis", "home", "uncategorized", "issue brief", "discussion document", "high-tech geopolitics", "podcast", "video", "event", "course", "news", "media", "all content", "advanced technology",
)
# Parts of the names of organisations.
ORGANISATIONS = ("institution", "institute", "foundation", " org", "team", "editor", "editorial", "admin", "staff", "programme", "program")


def person_names(query: str, no_names: tuple[str, ...] = ()) -> list[str]:
    """Candidate names in a query: runs of two or more capitalised words, and single long ones that aren't stop words.

    ``no_names`` are further words that are no names, such as that of the corpus' own institution.
    """
    stop = {*NO_NAMES, *(w.lower() for w in no_names)}
    words = [w.strip(".,;:!?\"()") for w in re.sub(r"['’]s\b", "", query).split()]
    out: list[str] = []
    run: list[str] = []
    for w in [*words, ""]:
        bare = w.rstrip(".")
        if bare.lower() in HONORIFICS:
            continue
        if re.fullmatch(r"[A-Z][\w'-]*", bare) and bare.lower() not in stop:
            run.append(bare)
            continue
        if len(run) >= 2 or run and len(run[0]) >= 5:
            out.append(" ".join(run))
        run = []
    return list(dict.fromkeys(out))


def is_authorship_query(query: str) -> bool:
    return not set(re.findall(r"[a-z][a-z-]*", query.lower())).isdisjoint(AUTHORSHIP)


def normal_name(c: Column) -> Column:
    """Lower case without honorifics, dots and repeated spaces."""
    bare = F.regexp_replace(F.lower(c), r"[.,]", " ")
    bare = F.regexp_replace(bare, r"\b(?:" + "|".join(HONORIFICS) + r")\b", " ")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def author_matches(author: Column, names: list[str]) -> Column:
    """Whether an author field is one of the names, or has a name's surname (four letters or more) as a word."""
    own = normal_name(F.coalesce(author, F.lit("")))
    out = F.lit(False)
    for name in names:
        n = re.sub(r"\s+", " ", re.sub(r"[.,]", " ", name.lower())).strip()
        n = " ".join(w for w in n.split() if w not in HONORIFICS)
        if not n:
            continue
        out = out | (own == n)
        if len(n.split()[-1]) >= 4:
            out = out | F.array_contains(F.split(own, "[ ,;&]+"), n.split()[-1])
    return out


def name_pairs(names: DataFrame, authors: DataFrame, name_key: str, name: str, author_key: str, author: str) -> DataFrame:
    """``name_key, author_key, exact``: all names of a table with the author fields they match, as ``author_matches`` tells for one.

    Both sides are normalised once. A name meets an author by its whole normal form, or by its
    last word (four letters or more) as one of the author's words: two equi-joins on those
    blocks, never all pairs. Names of one normal form meet the authors as one, and author
    fields with the same value as one too, so that copies aren't compared again. An author
    field may be a string or an array of strings; nulls and names without words match nothing.
    Both key columns must have different names.
    """
    listed = dict(authors.dtypes)[author].startswith("array")
    fields = authors.select(F.col(author_key), (F.col(author) if listed else F.array(author)).alias("__field"))
    own = names.select(F.col(name_key), normal_name(F.col(name)).alias("__name")).where(F.col("__name") != "")
    forms = own.select("__name").distinct().withColumn("__last", F.element_at(F.split("__name", " "), -1))
    values = fields.select("__field").where(F.size("__field") > 0).distinct()
    parts = values.select("__field", F.explode("__field").alias("__one")).select("__field", normal_name(F.col("__one")).alias("__one")).where(F.col("__one") != "")
    whole = parts.join(forms, F.col("__one") == F.col("__name")).select("__field", "__name", F.lit(True).alias("exact"))
    words = parts.select("__field", F.explode(F.array_distinct(F.split("__one", "[ ,;&]+"))).alias("__word")).where(F.length("__word") >= 4).distinct()
    by_last = words.join(forms, F.col("__word") == F.col("__last")).select("__field", "__name", F.lit(False).alias("exact"))
    met = whole.unionByName(by_last).groupBy("__field", "__name").agg(F.bool_or("exact").alias("exact"))
    return met.join(own, "__name").join(fields, "__field").select(name_key, author_key, "exact")


def author_from_text(text: Column) -> Column:
    """An author named near the start of a text; empty if none is."""
    name = r"([A-Z][\w.'-]+(?: [A-Z][\w.'-]+){1,3})"
    head = F.substring(text, 1, 2000)
    rules = [rf"(?m)^By {name}", rf"(?i:written by) {name}", rf"(?i:authors?): {name}", rf"(?m)^{name} \| "]
    found = [F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in rules]
    return F.coalesce(*[F.when(F.length(x).between(4, 60), x) for x in found], F.lit(""))


def plausible_person(name: Column, not_names: Column | None = None) -> Column:
    """Whether a name can be a person's: 2 to 40 characters with a letter, five words at most, no topic and no organisation.

    One word must be capitalised and alphabetic; of several one must begin with a capital.
    ``not_names`` are further names, in lower case, that are none.
    """
    n = strip(name)
    low = F.lower(n)
    words = F.size(F.split(n, r"\s+"))
    ok = F.length(n).between(2, 40) & n.rlike(r"\p{L}") & (words <= 5)
    ok &= F.when(words > 1, n.rlike(r"(?:^|\s)\p{Lu}")).otherwise(n.rlike(r"^\p{Lu}\p{L}*$"))
    ok &= ~low.isin(*TOPICS)
    for hint in ORGANISATIONS:
        ok &= ~low.contains(hint)
    return ok & ~F.array_contains(not_names, low) if not_names is not None else ok
