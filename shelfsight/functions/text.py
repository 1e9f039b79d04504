"""Text column functions. All take and return columns, so whole pipelines stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsight.functions import fixed
from shelfsight.functions.num import let

SENTENCE_BREAK = r"[.!?]+"
MARK = "\u0001"


def word_bounded(term: str) -> str:
    """ASCII word boundaries, the meaning of \\b in the model (the JVM's own is Unicode-aware)."""
    return rf"(?<![A-Za-z0-9_]){term}(?![A-Za-z0-9_])"


def strip_ws(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def alternation(terms: list[str]) -> str:
    """A pattern for any of the terms, the longest at a place first.

    Shared beginnings are factored out, so the work at a place follows the length of what
    matches there, not the number of terms. The list lives in the plan: tens of thousands at most.
    """
    root: dict = {}
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def spell(node: dict) -> str:
        forks = [re.escape(c).replace("\\ ", " ") + spell(n) for c, n in sorted(node.items()) if c]
        if not forks:
            return ""
        body = forks[0] if len(forks) == 1 else "(?:" + "|".join(forks) + ")"
        return f"(?:{body})?" if "" in node else body
    return spell(root)


def single_words(keywords: list[str]) -> list[str]:
    """Keywords that can occur inside one word; phrases with a space cannot."""
    return [k for k in keywords if not re.search(r"\s", k)]


def _independent(terms: list[str]) -> bool:
    """No term can overlap another, so one alternation equals removing them one by one."""
    for a in terms:
        for b in terms:
            x, y = a.split(" "), b.split(" ")
            if a != b and (set(x) <= set(y) or any(x[-n:] == y[:n] for n in range(1, min(len(x), len(y)) + 1))):
                return False
    return True


def filler_patterns(fillers=None) -> list[str]:
    """Regexes to remove in order: one for independent terms, else one per term."""
    terms = fillers or fixed.FILLER_TERMS
    if _independent(terms):
        return ["(?i)" + word_bounded("(?:" + alternation(terms) + ")")]
    return ["(?i)" + word_bounded("(?:" + alternation([t]) + ")") for t in terms]


def remove_fillers(text: Column, fillers=None) -> Column:
    """STRUCT<text, removed>: filler terms removed, occurrences counted."""
    removed = F.lit(0).cast("long")
    for pat in filler_patterns(fillers):
        removed = removed + F.regexp_count(text, F.lit(pat))
        text = F.regexp_replace(text, pat, "")
    return F.struct(text.alias("text"), removed.alias("removed"))


def drop_sponsor_sentences(text: Column, patterns=None) -> Column:
    """STRUCT<text, dropped>: sentences matching any pattern removed, the rest joined by '. '."""
    pat = "(?i)(?:" + "|".join(patterns or fixed.SPONSOR_PATTERNS) + ")"
    return let(F.split(text, SENTENCE_BREAK), lambda s: let(
        F.filter(s, lambda x: ~x.rlike(pat)), lambda k: F.struct(
            F.array_join(k, ". ").alias("text"), (F.size(s) - F.size(k)).cast("long").alias("dropped"))))


def remove_first(text: Column, pattern: str) -> Column:
    """Replace only the first match; the built-in replaces all."""
    if pattern.startswith("^"):
        return F.regexp_replace(text, "(?i)" + pattern, "")
    return F.regexp_replace(text, rf"(?is)^(.*?)(?:{pattern})", "$1")


def strip_intro_outro(text: Column, patterns=None) -> Column:
    patterns = patterns or fixed.INTRO_OUTRO_PATTERNS
    cut = text
    for p in patterns:
        cut = remove_first(cut, p)
    # Most texts hold none of the patterns; one search spares them the removal passes.
    cut = F.when(text.rlike("(?i)(?:" + "|".join(patterns) + ")"), cut).otherwise(text)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: F.length(strip_ws(s)) > 0)


def keep_keyword_sentences(text: Column, keywords: list[str]) -> Column:
    """STRUCT<text, dropped>: sentences that hold no word containing a keyword are dropped.

    A keyword without blanks lies inside a word exactly when it lies inside the sentence.
    """
    pat = "(?:" + alternation(single_words(keywords)) + ")"
    return let(sentences(text), lambda s: let(
        F.filter(s, lambda x: F.lower(x).rlike(pat)), lambda k: F.struct(
            F.array_join(k, ". ").alias("text"), (F.size(s) - F.size(k)).cast("long").alias("dropped"))))


def word_count(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def keywords_found(text: Column, keywords: list[str]) -> Column:
    """Distinct keywords lying inside a word of the text, in list order.

    One pass takes the longest keyword at each place; the keywords that begin another one are
    found by it as well.
    """
    words = [k for k in dict.fromkeys(single_words(keywords)) if k]
    if not words:
        return F.lit([]).cast("array<string>")
    known = set(words)
    begins = sorted({k[:n] for k in words for n in range(1, len(k)) if k[:n] in known})
    longest = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?=(" + alternation(words) + "))."), F.lit(1)))

    def every(hit):
        if not begins:
            return hit
        return F.array_union(hit, F.filter(F.lit(begins), lambda k: F.exists(hit, lambda x: F.startswith(x, k))))
    return let(let(longest, every), lambda hit: F.filter(F.lit(words), lambda k: F.array_contains(hit, k)))


def entity_focus(text: Column, keywords: list[str], min_density: float = 0.02, aggressive: bool = True) -> Column:
    """STRUCT<text, found, density, high_quality>: sparse texts keep only keyword sentences."""
    pat = "(?:" + alternation(keywords) + ")"

    def build(st):
        density = F.size(st["found"]) / F.greatest(word_count(st["t"]), F.lit(1))
        kept = F.array_join(F.filter(sentences(st["t"]), lambda x: F.lower(x).rlike(pat)), ". ")
        keep_all = (density >= min_density) | F.lit(not aggressive)
        return F.struct(
            F.when(keep_all, st["t"]).otherwise(kept).alias("text"), st["found"].alias("found"),
            density.alias("density"), (density >= min_density).alias("high_quality"))
    return let(F.struct(text.alias("t"), keywords_found(text, keywords).alias("found")), build)


def doubled(keywords: list[str]) -> list[str]:
    """The shortest strings in which a keyword overlaps itself, such as `banana` + `na` of `anana`."""
    return sorted({k + k[b:] for k in keywords for b in range(1, len(k)) if k[:b] == k[-b:]})


def _pieces_apart(t: Column, keywords: list[str]) -> Column:
    """t cut where a keyword starts; of a keyword's overlapping hits the leftmost ones that lie apart count."""
    found = F.filter(F.lit(keywords), lambda k: F.contains(F.lower(t), k))

    def places(k):
        between = F.split(t, F.concat(F.lit("(?iu)\\Q"), k, F.lit("\\E")), -1)
        return let(F.transform(between, F.length), lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(n) - 1, F.lit(1))),
            lambda i: F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda a, x: a + x) + (i - 1) * F.length(k)))
    starts = F.array_sort(F.array_union(F.array(F.lit(0)), F.flatten(F.transform(found, places))))
    return let(starts, lambda at: F.transform(at, lambda p, i: F.substr(
        t, p + 1, F.coalesce(F.get(at, i + 1), F.length(t)) - p)))


def context_windows(text: Column, keywords: list[str], window: int = 200, slack: int = 50, overlapping: bool = True) -> Column:
    """Text within `window` characters of a keyword hit, gaps marked by ' ... '.

    A keyword may overlap itself (`ana` in `banana`): each of its places is a hit, or, unless
    `overlapping`, only the leftmost ones that lie apart. Few texts hold such a place; these are
    cut keyword by keyword, the others as follows.

    The text is cut at every position where a keyword starts (a zero-width lookahead finds
    overlapping hits too). Two hits share a window unless the piece between their starts is
    longer than 2*window + slack, so only piece lengths matter and the job is one linear
    pass over the pieces: no positions, no exploded rows, no shuffle.
    """
    alt = "(?iu)(?:" + alternation(keywords) + ")"
    limit = 2 * window + slack
    twice = [] if overlapping else doubled(keywords)

    def cut(t):
        at_each = F.split(t, "(?=" + alt + ")")
        if not twice:
            return at_each
        return F.when(t.rlike("(?iu)(?:" + alternation(twice) + ")"), _pieces_apart(t, keywords)).otherwise(at_each)

    def join(pieces):
        n = F.size(pieces)

        def piece(p, i):
            first, last = i == 0, i == n - 1
            starts_hit = p.rlike("^" + alt)
            lead = F.when(first & ~starts_hit, F.lit(True)).otherwise(F.lit(False))
            tail = F.when(F.length(p) > window, F.right(p, F.lit(window))).otherwise(p)
            head = F.substring(p, 1, window)
            return (F.when(lead, tail).when(last, head)
                    .when(F.length(p) > limit, F.concat(head, F.lit(MARK), tail)).otherwise(p))
        glued = F.array_join(F.transform(pieces, piece), "")
        return F.array_join(F.transform(F.split(glued, MARK), strip_ws), " ... ")

    def build(t):
        out = F.when(t.rlike(alt), let(cut(t), join)).otherwise(F.lit(""))
        return let(out, lambda o: F.when(F.length(o) > F.length(t), t).otherwise(o))
    return let(text, build)


def dedupe_pieces(text: Column) -> Column:
    """STRUCT<text, repeats>: ' ... ' pieces, first occurrence kept."""
    pieces = F.filter(F.transform(F.split(text, r"\.\.\."), strip_ws), lambda s: F.length(s) > 0)
    return let(pieces, lambda p: let(F.array_distinct(p), lambda k: F.struct(
        F.array_join(k, " ... ").alias("text"), (F.size(p) - F.size(k)).cast("long").alias("repeats"))))


def limit_length(text: Column, max_length: int = 8000) -> Column:
    return let(text, lambda t: F.when(
        F.length(t) > max_length, F.concat(F.substring(t, 1, max_length), F.lit("..."))).otherwise(t))


def keyword_word_share(text: Column, keywords: list[str]) -> Column:
    """Share of words that contain a keyword."""
    pat = "(?:" + alternation(single_words(keywords)) + ")"
    return let(F.split(F.lower(text), r"\s+"), lambda w: F.size(
        F.filter(w, lambda x: x.rlike(pat))) / F.greatest(F.size(w), F.lit(1)))


def slugify(text: Column) -> Column:
    t = F.regexp_replace(strip_ws(F.lower(text)), r"[^A-Za-z0-9_\s-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s_]+", "-"), "-+", "-")
    return F.regexp_replace(t, "^-+|-+$", "")


def normalise_name(text: Column) -> Column:
    """Query normalisation of the entity resolver."""
    t = F.regexp_replace(strip_ws(F.lower(text)), r"[^A-Za-z0-9_\s]", "")
    return F.regexp_replace(t, r"\s+", " ")


def title_words(text: Column, stop_words: list[str], keep: str = "") -> Column:
    """Lower-cased title words of three letters or more, minus stop words."""
    t = F.regexp_replace(F.lower(text), rf"[^A-Za-z0-9_\s{keep}]", " ")
    return F.filter(F.split(t, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(stop_words))


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on."""
    s = F.floor(seconds)
    h, mi, se = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat_ws(":", two(mi), two(se))
    return F.when(h > 0, F.concat_ws(":", two(h), short)).otherwise(short)


def clock_seconds(ts: Column) -> Column:
    p = F.split(ts, ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).cast("double")
    return F.when(F.size(p) == 3, n(1) * 3600 + n(2) * 60 + n(3)).when(
        F.size(p) == 2, n(1) * 60 + n(2)).otherwise(F.lit(0.0))
