"""Addresses: identity keys, scope, page kinds and what their paths say, as Column functions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docspark.functions.text import blank_to_null, repaired, strip

# Query parameters that never change the page.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid gclsrc mc_cid mc_eid ref share replytocom amp".split()
# Path words of navigation pages, of listings, and titles of landing pages.
_NAVIGATION = "author authors people team staff profile tag tags category categories topic topics archive archives search page"
_SECTIONS = "publications? blogs? articles? research commentary reports? papers? briefs? events? news media"
NAVIGATION_URL = "(?i)/(?:" + "|".join(_NAVIGATION.split()) + ")/"
NAVIGATION_TITLE = r"(?i)^(?:tag|category|topic|archive|author|search results?)\s*[:–—-]"
LISTING_URL = "(?i)/(?:pages/)?(?:" + "|".join(_SECTIONS.split()) + "|content|all[-_]?content|home)/?$"
LANDING_TITLE = "(?i)^(?:home|homepage|" + "|".join(_SECTIONS.split()) + ")$"
SKIPPED_EXTENSIONS = ".jpg .jpeg .png .gif .svg .webp .ico .css .js .zip .mp3 .mp4 .avi .mov .doc .docx .xls .xlsx .ppt .pptx".split()


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(strip(url), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def scheme(url: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(strip(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit("")), F.lit("https"))


def host(url: Column) -> Column:
    """Lower-case host (and port) without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(strip(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    rest = F.regexp_replace(strip(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One key for all spellings of a page: no www, fragment, tracking parameters or trailing slash; parameters sorted.

    Parameters keep their spelling, percent signs included.
    """
    own = path(url)
    own = F.when(own == "", F.lit("/")).when(own.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(own, "/+$", ""))
    query = F.regexp_extract(strip(url), r"^[^?#]*\?([^#]*)", 1)
    drop = F.array(*[F.lit(x) for x in TRACKING])
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(drop, F.lower(F.substring_index(p, "=", 1))))
    kept = F.array_join(F.sort_array(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")
    return F.concat(scheme(url), F.lit("://"), host(url), own, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"(\.[A-Za-z0-9]+)$", 1))


def is_pdf(url: Column) -> Column:
    return F.coalesce(F.lower(F.substring_index(url, "?", 1)).endswith(".pdf"), F.lit(False))


def clean_url(url: Column) -> Column:
    return strip(repaired(F.coalesce(url, F.lit(""))))


def is_listing(url: Column, title: Column) -> Column:
    """Whether a page is a section's index, a landing page or the home page."""
    own = F.concat(F.regexp_replace(path(url), "/+$", ""), F.lit("/"))
    bare = F.regexp_replace(path(url), "/+$", "").isin("", "/index", "/index.html", "/home")
    has = blank_to_null(url).isNotNull()
    return F.coalesce(has & (own.rlike(LISTING_URL) | bare), F.lit(False)) | F.coalesce(strip(title).rlike(LANDING_TITLE), F.lit(False))


def is_low_value(url: Column, title: Column, length: Column, least: int = 200, person_title: str | None = None) -> Column:
    """Whether a page can't be the evidence of a claim: navigation, listing, landing, too short.

    ``person_title`` is a pattern for titles that are only a person's name and the site's.
    """
    nav = F.coalesce(url.rlike(NAVIGATION_URL), F.lit(False)) | F.coalesce(strip(title).rlike(NAVIGATION_TITLE), F.lit(False))
    if person_title:
        nav = nav | F.coalesce(strip(title).rlike(person_title), F.lit(False))
    return nav | is_listing(url, title) | (F.coalesce(length, F.lit(0)) < least)


def is_internal(url: Column, hosts: list[str]) -> Column:
    """Exact membership of the host; a host that merely contains an allowed one isn't."""
    return F.coalesce(host(url).isin([h.lower().removeprefix("www.") for h in hosts]), F.lit(False))


def should_follow(url: Column, hosts: list[str], exclude: list[str] = ()) -> Column:
    """Links to follow; the fragment is not part of the test."""
    bare = F.lower(F.substring_index(url, "#", 1))
    out = is_internal(url, hosts) & ~extension(bare).isin(SKIPPED_EXTENSIONS)
    for x in exclude:
        out = out & ~bare.contains(x.lower())
    return out


def should_keep(url: Column, exclude: list[str] = (), include: list[str] = (), listings: bool = False) -> Column:
    """Pages to keep as documents."""
    low = F.lower(url)
    out = F.lit(True)
    for x in exclude:
        out = out & ~low.contains(x.lower())
    if not listings:
        out = out & ~is_listing(url, F.lit(""))
    if include:
        out = out & F.array_contains(F.transform(F.array(*[F.lit(x.lower()) for x in include]), lambda x: low.contains(x)), True)
    return out


def resolve(url: Column, base: Column) -> Column:
    """Absolute address of a link (RFC 3986)."""

    @pandas_udf("string")
    def join(links: pd.Series, bases: pd.Series) -> pd.Series:
        def one(u: str | None, b: str | None) -> str | None:
            if u is None:
                return None
            u = u.strip()
            u = f"https:{u}" if u.startswith("//") else u
            return urljoin(b, u) if b and not u.startswith("http") else u

        return pd.Series([one(u, b) for u, b in zip(links, bases)])

    return join(url, base)


# Topics by what an address says, the first match counts; none is empty.
CATEGORY_RULES = [
    (r"ai[-_\s]?governance|artificial[-_\s]?intelligence", "AI Governance"),
    (r"geospat|gis|satellite|remote[-_\s]?sensing", "Geospatial"),
    (r"semiconductor|chip|foundry", "Semiconductors"),
    (r"indo[-_\s]?pacific|quad|asean", "Indo-Pacific"),
    (r"china|pla|bri\b", "China Studies"),
    (r"climate|environment|energy|lpg|oil|gas", "Energy & Climate"),
    (r"defence|military|security|strateg", "Defence & Security"),
    (r"space[-_\s]?policy|isro|launch", "Space Policy"),
    (r"economy|trade|wto|finance|fiscal", "Economy & Trade"),
    (r"cyber|digital|data|privacy", "Cyber & Digital"),
    (r"health|pharma|pandemic", "Health"),
    (r"education|school|skill", "Education"),
    (r"nuclear|npt|disarma", "Nuclear Policy"),
    (r"pakistan|border|kashmir", "South Asia"),
]
# Source types in the order in which they are looked for.
SOURCE_TYPES = "publication blog research commentary report paper brief policy playbook decision".split()
# Kinds by the words that name them, the first match counts.
KIND_WORDS = [
    ("PDF", ["pdf"]),
    ("Blog", ["blog"]),
    ("Newsletter", ["newsletter"]),
    ("Publication", ["publication", "discussion document", "issue brief", "monograph", "report", "brief", "working paper"]),
    ("Podcast", ["podcast"]),
    ("Video", ["video", "youtube"]),
    ("Article", ["article", "commentary", "op-ed", "opinion", "in the news"]),
    ("Event", ["event", "seminar", "webinar", "workshop", "conference"]),
    ("Course", ["course", "graduate"]),
    ("Playbook", ["playbook"]),
    ("Decision", ["decision"]),
    ("Insight", ["insight"]),
    ("Idea", ["idea"]),
    ("Note", ["note"]),
    ("Research", ["research", "paper", "study"]),
]


def category_of(url: Column) -> Column:
    """The topic of an address; empty if no rule matches."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(pattern), label) for pattern, label in CATEGORY_RULES], F.lit(""))


def source_type_of(url: Column, source: str = "website") -> Column:
    """The type that begins a path segment, or whose plural ends one; else ``page`` on a website and ``kb`` elsewhere."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.coalesce(*[F.when(low.contains(f"/{t}") | low.contains(f"{t}s/"), t) for t in SOURCE_TYPES], F.lit("page" if source == "website" else "kb"))


def kind_of(url: Column, fields: tuple[Column, ...] = (), pdf: Column | None = None, source: Column | None = None, more: dict[str, list[str]] | None = None) -> Column:
    """What a document is, for people: by the words in its type, category and section (``fields``) or at the start of a path segment.

    ``pdf`` says that it is one whatever it is called. ``more`` adds words to kinds, such as
    the names of a corpus' own series. Of what has no kind, pages of the source ``commit_kb`` are named apart.
    """
    words, low = F.lower(F.concat_ws(" ", *fields)) if fields else F.lit(""), F.lower(F.coalesce(url, F.lit("")))
    rules = []
    for label, known in KIND_WORDS:
        hit = F.lit(False)
        for w in [*known, *(more or {}).get(label, [])]:
            hit = hit | words.contains(w) | low.contains(f"/{w}")
        rules.append(F.when(hit, label))
    other = F.when(source == "commit_kb", "Commit page").otherwise("Web page") if source is not None else F.lit("Web page")
    certain = [F.when(pdf, "PDF")] if pdf is not None else []
    return F.coalesce(*certain, *rules, other)
