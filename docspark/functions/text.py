"""Text cleaning, quality, tokens and headers as Column functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


#: Characters of Unicode's White_Space.
_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at the ends; what is between them isn't looked at."""
    return F.btrim(c, F.lit(_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_of(*cs: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def clean_text(c: Column) -> Column:
    """CRLF to LF, at most one blank line, single spaces, no white space at the ends."""
    c = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, "[ \t]{2,}|\t", " "))  # a single space stays as it is


def normalize_whitespace(c: Column) -> Column:
    """As clean_text, and lone CR and no-break spaces too, and no spaces around line ends."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t ]+", " "), " *\n *", "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def word_count(c: Column) -> Column:
    return F.size(whitespace_tokens(c))


def approx_token_count(c: Column) -> Column:
    return F.floor(word_count(c) * F.lit(1.33)).cast("long")


def truncate(c: Column, most: int = 300) -> Column:
    """At most ``most`` characters, cut back to the last space, with an ellipsis."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…")))


def capped(c: Column, most: int = 12_000, notice: str = "\n\n… (cut here: the whole is longer)") -> Column:
    """At most ``most`` characters; where something is cut a notice says so, within the limit."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - len(notice))), F.lit(notice[:most])))


def snippet(c: Column, most: int = 280) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(strip(F.substring(text, 1, most)), F.lit("…")))


# ---- tokens ------------------------------------------------------------------------------

# Words that carry no meaning in a query.
QUERY_STOP = """the a an is are was were be been being what who whom whose which when where why how does do did of in
on to for with and or about tell me us explain describe simple terms please give list behind into that this these those
it its there here no not any some you your can could would should has have had at by as from up out so if than then""".split()
# Words that don't count when an answer is compared with its sources.
GROUNDING_STOP = """the a an and or but if then else for of to in on at by is are was were be been being as that this
these those it its with from into about which who whom whose what when where how why will would can could should may
might must not no do does did has have had they them their we our you your he she his her also there here than such so
some any""".split()


def whitespace_tokens(c: Column) -> Column:
    """Lower-case tokens between white space; punctuation stays in them."""
    return F.array_remove(F.split(F.lower(c), r"\s+"), "")


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def salient_tokens(c: Column) -> Column:
    """Tokens of three characters or more that aren't stop words, repeats included."""
    stop = F.array(*[F.lit(w) for w in QUERY_STOP])
    return F.filter(alnum_tokens(c), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def grounding_tokens(c: Column) -> Column:
    """The distinct tokens that count for grounding."""
    return F.array_except(F.array_distinct(alnum_tokens(c)), F.array(*[F.lit(w) for w in GROUNDING_STOP]))


def overlap_ratio(text: Column, context: Column) -> Column:
    """The share of ``text``'s grounding tokens that are among those of ``context``; 0 without any."""
    own = grounding_tokens(text)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, grounding_tokens(context))) / F.size(own))


# ---- broken encodings ----------------------------------------------------------------------


def misread(c: str, codec: str = "cp1252") -> str:
    """How a character looks when its UTF-8 bytes are read as single-byte text."""
    out = ""
    for b in c.encode():
        try:
            out += bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out += chr(b)
    return out


# Characters whose misread forms are repaired.
_PUNCTUATION = "’‘“”—–…•₹€™"
_LOW_PUNCTUATION = "–—‘’‚“”„…•€₹™"
_SYMBOLS = "£©®°±½¼¾·»«¥¢§¶´¨¯¸¡¿²³¹µªº"
_LETTERS = "éèëêáàâãåäæóòôöõøñíìïîúùüûçÿýÀÉÇÑÄÖÜÅÆØß"
REPAIRS: dict[str, str] = {misread(c): c for c in _PUNCTUATION + _SYMBOLS + _LETTERS} | {misread(c, "latin-1"): c for c in _LOW_PUNCTUATION} | {misread("\u201b", "latin-1"): "\u2018"}
# Forms that have lost a byte, a misread no-break space and a misread replacement character.
REPAIRS |= {"â€?": "’", "â€": "”", "Â\u00a0": " ", "Â ": " ", "ï¿½": ""}
_CERTAIN = sorted(REPAIRS, key=lambda k: (-len(k), k))
# What an emoji leaves behind, and an "â" that stands alone for an apostrophe or a dash.
_LEFT_OVER = r"ðŸ[^\sA-Za-z0-9]{0,4}"
_LONE_APOSTROPHE = r"â(?=(?:s|t|re|ll|ve|d|m)\b)"
_LONE_DASH = r"(?:(?<=\s)|^)â(?=\s|$)|â[�─-▟]+"
_LONE = f"{_LONE_APOSTROPHE}|{_LONE_DASH}"
_BROKEN = re.compile("|".join(map(re.escape, _CERTAIN)) + "|ðŸ|�")
_ANY_REPAIR = re.compile("|".join(map(re.escape, _CERTAIN)))
#: What all of them begin with: a text without any isn't broken.
_LEADS = re.compile("[" + re.escape("".join(sorted({k[0] for k in _CERTAIN} | set("ð�â")))) + "]")


def is_broken(c: Column) -> Column:
    """Whether a text holds sequences that only a wrong decoding makes; accented letters alone aren't."""
    certain = "|".join(re.escape(k).replace("\\ ", " ") for k in _CERTAIN)
    return F.coalesce(c.rlike(certain + "|ðŸ|�") | c.rlike(_LONE), F.lit(False))


def broken(text: str) -> bool:
    """``is_broken`` of one text."""
    if text.isascii() or not _LEADS.search(text):
        return False
    return bool(_BROKEN.search(text) or "â" in text and re.search(_LONE, text))


def repair(text: str) -> str:
    """Repair misread characters; text without them is returned as it is."""
    if not broken(text):
        return text
    for _ in range(3):
        before, text = text, _ANY_REPAIR.sub(lambda m: REPAIRS[m[0]], text)
        suspects = sum(map(text.count, "âÃÂð�"))
        if suspects:
            try:
                whole = text.encode("cp1252").decode("utf-8")
            except UnicodeError:
                whole = text
            if sum(map(whole.count, "âÃÂð�")) < suspects:
                text = whole
        if text == before:
            break
    text = re.sub(_LONE_APOSTROPHE, "’", re.sub(_LEFT_OVER, "", text))
    return re.sub(_LONE_DASH, "–", text).replace("�", "")


def repaired(c: Column) -> Column:
    """Column form of ``repair``: layout stays."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: repair(t) if isinstance(t, str) else t)

    return run(c)


def clean_broken(c: Column) -> Column:
    """Repaired text with normal white space; null is empty."""
    return normalize_whitespace(repaired(F.coalesce(c, F.lit(""))))


# ---- quality --------------------------------------------------------------------------------

# Ranges that only damaged extraction brings into this kind of text.
NOISE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x80-\x9Fɐ-ʯ̀-ͯͰ-ӿ԰-ۿ─-▟-�]"


def is_garbage(tok: Column) -> Column:
    """Whether a token is beyond repair: noise characters, four non-ASCII letters in a row, or mostly non-ASCII."""
    n = F.length(tok)
    foreign = F.length(F.regexp_replace(tok, r"[\x00-\x7F]", ""))
    odd = tok.rlike(r"[\p{L}&&[^\x00-\x7F]]{4}") | ((n >= 5) & (foreign >= n * 0.4) & ~tok.rlike("[aeiouAEIOU]")) | ((n >= 6) & (foreign >= n * 0.5))
    return tok.rlike(NOISE) | (tok.rlike(r"\p{L}") & odd)


#: A token that can be garbage at all: it holds a noise character or two characters beyond ASCII.
_SUSPECT = r"(?<!\S)(?=\S*" + NOISE + r"|\S*[^\x00-\x7F\s]\S*[^\x00-\x7F\s])\S+"


def quality_score(c: Column) -> Column:
    """1 for clean text down to 0 for noise: the lesser of the clean share of token characters and a noise penalty.

    One pass of a pattern picks the few tokens that can be garbage; only they are looked at.
    """
    suspects = F.regexp_extract_all(c, F.lit(f"({_SUSPECT})"), F.lit(1))
    bad = F.aggregate(suspects, F.lit(0), lambda n, t: n + F.when(is_garbage(t), F.length(t)).otherwise(0))
    share = F.lit(1.0) - bad / F.greatest(F.length(F.regexp_replace(c, r"\s+", "")), F.lit(1))
    noise = F.length(c) - F.length(F.regexp_replace(c, NOISE, ""))
    score = F.greatest(F.lit(0.0), F.least(share, F.lit(1.0) - F.least(F.lit(1.0), noise * 4.0 / F.greatest(F.length(c), F.lit(1)))))
    return F.when(F.coalesce(strip(c), F.lit("")) == "", F.lit(1.0)).otherwise(score)


_NOISE_PY = re.compile(NOISE)


def garbage(tok: str) -> bool:
    """``is_garbage`` of one token."""
    if _NOISE_PY.search(tok):
        return True
    foreign, run, longest = 0, 0, 0
    for ch in tok:
        foreign += ch > "\x7f"
        run = run + 1 if ch > "\x7f" and ch.isalpha() else 0
        longest = max(longest, run)
    n = len(tok)
    odd = longest >= 4 or n >= 5 and foreign >= n * 0.4 and not re.search("[aeiouAEIOU]", tok) or n >= 6 and foreign >= n * 0.5
    return odd and any(ch.isalpha() for ch in tok)


def _odd_share(tok: str) -> bool:
    """Whether a token has enough characters beyond ASCII to be garbage without noise: four, or two in five."""
    foreign = len(tok) - len(tok.encode("ascii", "ignore"))
    return foreign >= 4 or foreign > 1 and foreign >= len(tok) * 0.4


def quality(text: str) -> float:
    """``quality_score`` of one text."""
    if not text.strip():
        return 1.0
    noise = len(_NOISE_PY.findall(text))
    if not noise and text.isascii():
        return 1.0
    tokens = text.split()
    bad = sum(len(t) for t in tokens if (noise or not t.isascii()) and (noise and _NOISE_PY.search(t) or _odd_share(t)) and garbage(t))
    if not bad and not noise:
        return 1.0
    share = 1 - bad / max(1, sum(map(len, tokens)))
    return max(0.0, min(share, 1 - min(1.0, noise * 4 / max(1, len(text)))))


def shortened(text: str, run: str, to: str) -> str:
    """``text`` with ``to`` for ``run`` until there is none."""
    while run in text:
        text = text.replace(run, to)
    return text


def whitespace_normalized(text: str) -> str:
    """``normalize_whitespace`` of one text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ").replace("\xa0", " ")
    text = shortened(text, "  ", " ").replace(" \n", "\n").replace("\n ", "\n")
    return shortened(text, "\n\n\n", "\n\n").strip()


def without_garbage(text: str, least: float = 0.5) -> str:
    """``clean_lines`` of one text: what is kept; with ``least`` 0 all lines are."""
    text = repair(text)
    return whitespace_normalized(text if least <= 0 else "\n".join(x for x in text.split("\n") if not x.strip() or quality(x) >= least))


def clean_lines(c: Column) -> Column:
    """``struct(text, dropped)``: lines repaired, garbage lines taken out; blank lines stay."""
    lines = F.split(repaired(F.coalesce(c, F.lit(""))), "\n")
    bad = lambda x: (strip(x) != "") & (quality_score(x) < 0.5)
    kept = normalize_whitespace(F.array_join(F.filter(lines, lambda x: ~bad(x)), "\n"))
    return F.struct(kept.alias("text"), F.filter(lines, bad).alias("dropped"))


# ---- headers and citations -------------------------------------------------------------------


def joined(c: Column) -> Column:
    """A list of names, blanks left out, with commas between."""
    return F.array_join(F.filter(F.transform(c, strip), lambda x: x != ""), ", ")


def meta_header(fields: dict[str, Column]) -> Column:
    """A line for each known field of a document that isn't blank, in a fixed order; a title "untitled" is none."""
    labels = {"title": "Title", "subtitle": "Subtitle", "author": "Author", "date": "Published", "updated_date": "Updated", "category": "Category", "section": "Section", "tags": "Tags", "document_type": "Type", "source_name": "Source"}
    lines = []
    for name, label in labels.items():
        if name in fields:
            value = blank_to_null(fields[name])
            if name == "title":
                value = F.when(F.lower(value) != "untitled", value)
            lines.append(F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n", *lines)


def search_text(header: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", blank_to_null(header), blank_to_null(body))


def markdown_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]<>#|])", r"\\$1")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_href(c: Column) -> Column:
    """The address if its scheme is http or https, else a harmless anchor."""
    return F.when(strip(c).rlike("(?i)^https?://"), strip(c)).otherwise(F.lit("#"))


def linkify(answer: Column, urls: Column) -> Column:
    """Source markers as Markdown links to the source's address, where it has a safe one; links stay as they are."""

    @pandas_udf("string")
    def link(texts: pd.Series, lists: pd.Series) -> pd.Series:
        def one(text: str, known: list) -> str:
            def sub(m: re.Match) -> str:
                i = int(m[1]) - 1
                url = (known[i] or "").strip() if 0 <= i < len(known) else ""
                inside = m.start() > 0 and text[m.start() - 1] == "["
                return m[0] if inside or not re.match("(?i)https?://", url) else f"[[{i + 1}]]({url})"

            return re.sub(r"(?i)\[(?:source\s+)?(\d{1,2})\](?!\()", sub, text)

        return pd.Series([one(t, list(u) if u is not None else []) if isinstance(t, str) else t for t, u in zip(texts, lists)])

    return link(answer, urls)
