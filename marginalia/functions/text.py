"""Columns from text columns: TeX cleaning, tokens, n-grams, sentence features. Built-in functions only.

Null text gives null text and empty token lists' results where a result is a number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L

SPACE = r"(?U)\s+"
TITLE = r"\[\[(SECTION|SUBSECTION):([^\]]+)\]\]"


def _sub(pattern: str, to: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text where equal texts are handled once: two hashes with seeds of their own, since
    among 1e10 texts some share one of 64 bits."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip_comments(c: Column) -> Column:
    """Lines without what follows an unescaped percent sign; line ends become newlines, the last one goes."""
    lines = F.regexp_replace(c, "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n\z", ""), r"(?<!\\)%[^\n]*", "")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(normalize_newlines(c), "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def document_body(c: Column) -> Column:
    """From the first begin to the last end of the document environment; all of it where there is none."""
    pattern = r"(?s)\\begin\{document\}(.*)\\end\{document\}"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def strip_environments(c: Column) -> Column:
    for name in L.BLOCK_ENVIRONMENTS:
        quoted = name.replace("*", r"\*")
        c = F.regexp_replace(c, rf"(?s)\\begin\{{{quoted}\}}.*?\\end\{{{quoted}\}}", f"\n[{name.upper()}]\n")
    return c


def mark_sections(c: Column) -> Column:
    """Headings become [[SECTION:title]] or [[SUBSECTION:title]] lines with squeezed titles."""
    c = F.regexp_replace(c, r"\\section\*?\{((?U)\s*)([^{}]+?)((?U)\s*)\}", "\n[[SECTION:$2]]\n")
    c = F.regexp_replace(c, r"\\(?:subsection|subsubsection)\*?\{((?U)\s*)([^{}]+?)((?U)\s*)\}", "\n[[SUBSECTION:$2]]\n")
    inside = r"(?s)(\G(?!\A)|\[\[(?:SUB)?SECTION:)((?:(?!\]\])(?U:\S))*+)(?U:\s)+(?=(?:(?!\]\]).)*\]\])"
    return F.regexp_replace(F.regexp_replace(c, inside, "$1$2 "), r"\[\[((?:SUB)?SECTION): \]\]", "[[$1:]]")


strip_citations = lambda c: _sub(r"\\(?:ref|eqref|autoref|cref|Cref)\{[^{}]*\}", " [REF] ")(_sub(r"\\cite(?U:\w*)\*?(?:\[[^\]]*\])?\{[^{}]*\}", " [CITATION] ")(c))
strip_footnotes = _sub(r"\\footnote\{[^{}]*\}", " ")


def strip_math(c: Column) -> Column:
    """Patterns are possessive, so that long input cannot exhaust the regex engine's stack; the second alternative is
    what backtracking would find when only an escaped dollar sign can close."""
    c = F.regexp_replace(c, r"(?s)\$\$.*?\$\$", " [MATH] ")
    c = F.regexp_replace(c, r"(?s)\$(?:\\[^\n]|[^$\\]|\\(?=\n))++\$|\$(?!\$)[^$]*(?:\\\$[^$]*)*\\\$", " [MATH] ")
    c = F.regexp_replace(c, r"(?s)\\\[.*?\\\]", " [MATH] ")
    return F.regexp_replace(c, r"(?s)\\\(.*?\\\)", " [MATH] ")


def unwrap_commands(c: Column) -> Column:
    for name in L.INLINE_COMMANDS:
        c = F.regexp_replace(c, rf"\\{name}\*?(?:\[[^\]]*\])?\{{([^{{}}]*)\}}", "$1")
    return c


def strip_commands(c: Column) -> Column:
    c = F.regexp_replace(c, r"\\item(?U:\b)", "\n")
    c = F.regexp_replace(c, r"\\[a-zA-Z@]+\*?\[[^\]]*\]", " ")
    c = F.regexp_replace(c, r"\\[a-zA-Z@]+\*?\{([^{}]*)\}", "$1")
    return F.translate(F.regexp_replace(c, r"\\[a-zA-Z@]+\*?", " "), "{}", "  ")


def strip_placeholders(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "~", " "), r"\[[A-Z_]+\]", " ")


#: The order is part of the result.
CLEANING = (strip_comments, strip_environments, mark_sections, strip_citations, strip_footnotes, strip_math, unwrap_commands, strip_commands, strip_placeholders, normalize_whitespace)


def clean_tex(c: Column) -> Column:
    return reduce(lambda c, step: step(c), CLEANING, c)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")
    return F.when(s == "", "untitled").otherwise(s)


def bib_titles(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?i)title(?U:\s*)=(?U:\s*)\{([^{}]+)\}"), 1), squeeze)


# ---- sentences


def _cut_pattern() -> str:
    names = "|".join(a.replace(".", r"\.") for a in L.ABBREVIATIONS)
    # the stop and what follows are tested first: looking back is dear and so happens at few places
    return rf"([.!?])(?=[ \"')\]]|$)(?<!(?<![A-Za-z.])\.{{0,8}}(?i:{names})\.{{0,8}}[.!?])"


def split_sentences(c: Column) -> Column:
    """Sentences of a text: cut after . ! ? before a blank, quote, bracket or the end, not after an abbreviation."""
    marked = F.regexp_replace(squeeze(c), _cut_pattern(), "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


# ---- tokens and n-grams


def tokens(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), 0), F.array().cast("array<string>"))


def plain_tokens(c: Column) -> Column:
    """Tokens of the text without punctuation: ASCII letters and digits only."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), F.array().cast("array<string>"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once even where f uses it inside of lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def ngrams(tok: Column, n: int, by: str) -> Column:
    return F.when(F.size(tok) >= n, F.transform(F.sequence(F.lit(1), F.size(tok) - (n - 1)), lambda i: F.array_join(F.slice(tok, i, n), by))).otherwise(F.array().cast("array<string>"))


def features(tok: Column) -> Column:
    """Unigrams, bigrams and trigrams of a token list, with repeats."""
    return let(tok, lambda t: F.concat(t, ngrams(t, 2, "_"), ngrams(t, 3, "_")))


def phrases(c: Column, low: int, high: int, min_tokens: int) -> Column:
    """Distinct n-grams of the plain tokens, low <= n <= high; none of fewer than min_tokens tokens."""
    none = F.array().cast("array<string>")
    return let(plain_tokens(c), lambda tok: F.when(F.size(tok) >= min_tokens, F.array_distinct(F.concat(*[ngrams(tok, n, " ") for n in range(low, high + 1)]))).otherwise(none))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def share(tok: Column, words: list[str], inside: bool = True) -> Column:
    """Share of the tokens that are (not) in a list; 0 of none."""
    return ratio(F.size(F.filter(tok, lambda t: t.isin(words) if inside else ~t.isin(words))), tok)


def listed(low: Column, words: list[str]) -> Column:
    """The tokens of a lower-case text that are in a list, with repeats; words are letters, digits and apostrophes."""
    alone = rf"(?<![a-z0-9'])(?:{'|'.join(sorted(words))})(?![a-z0-9'])"
    return F.coalesce(F.regexp_extract_all(low, F.lit(alone), 0), F.array().cast("array<string>"))


def ratio(n: Column, tok: Column) -> Column:
    """n as a share of the tokens; 0 of none."""
    return F.when(F.size(tok) > 0, n.cast("double") / F.size(tok)).otherwise(0.0)


def content_ratio(tok: Column) -> Column:
    return share(tok, L.STOPWORDS, inside=False)


def abstract_ratio(tok: Column) -> Column:
    return share(tok, L.ABSTRACT_WORDS)


def mark_counts(c: Column) -> list[Column]:
    """How often the marks , ; : ( ) are in a text, each."""
    return [(F.length(c) - F.length(F.replace(c, F.lit(m)))).cast("double") for m in ",;:()"]


def punctuation_entropy(c: Column, counts: list[Column] | None = None) -> Column:
    """Shannon entropy, in bits, of the marks , ; : ( ) of a text; counts: of the marks, where they are at hand."""
    counts = mark_counts(c) if counts is None else counts
    total = reduce(Column.__add__, counts)
    terms = [F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(0.0) for n in counts]
    return F.when(total > 0, reduce(Column.__add__, terms)).otherwise(0.0)


def starts_with_marker(tok: Column) -> Column:
    return F.coalesce(F.get(tok, 0).isin(L.DISCOURSE_MARKERS), F.lit(False))


def boilerplate_discount(c: Column, tok: Column) -> Column:
    hits = reduce(Column.__add__, [F.lower(c).contains(p).cast("int") for p in L.BOILERPLATE])
    return F.least(F.lit(0.35), hits.cast("double") / F.greatest(F.size(tok), F.lit(1)) * 4)


def long_tokens(tok: Column) -> Column:
    return F.array_distinct(F.filter(tok, lambda x: F.length(x) > 2))


def lexical_overlap(x: Column, y: Column, min_tokens: int) -> Column:
    """Jaccard similarity of two lists of distinct tokens; 0 if either has too few."""
    enough = (F.size(x) >= min_tokens) & (F.size(y) >= min_tokens)
    return F.when(enough, F.size(F.array_intersect(x, y)).cast("double") / F.greatest(F.size(F.array_union(x, y)), F.lit(1))).otherwise(0.0)


def longest_first(words: Column) -> Column:
    """By falling length, then alphabetically."""
    keyed = F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda s: s["w"])


def low_specificity(tok: Column, content: Column | None = None, abstract: Column | None = None, vague: Column | None = None) -> Column:
    """content, abstract, vague: the ratios, where they are at hand."""
    vague = F.least(F.lit(0.35), (share(tok, L.VAGUE_WORDS) if vague is None else vague) * 1.8)
    gap = F.greatest(F.lit(0.0), 0.7 - (content_ratio(tok) if content is None else content)) * 0.6
    return F.when(F.size(tok) > 0, clamp((abstract_ratio(tok) if abstract is None else abstract) * 1.3 + gap + vague)).otherwise(0.0)


def thinness(tok: Column, content: Column | None = None, abstract: Column | None = None, low: Column | None = None) -> Column:
    """content, abstract, low: both ratios and low_specificity, where they are at hand."""
    content, abstract = content_ratio(tok) if content is None else content, abstract_ratio(tok) if abstract is None else abstract
    low = low_specificity(tok, content, abstract) if low is None else low
    bonus = F.when(starts_with_marker(tok), 0.15).otherwise(0.0) + F.when(F.size(tok) >= 18, 0.1).otherwise(0.0)
    return F.when(F.size(tok) > 0, clamp((1.0 - content) * 0.25 + abstract * 0.25 + low * 0.35 + bonus)).otherwise(0.0)


def classifier(phrase: Column, thin: Column, shift: Column) -> Column:
    return clamp(phrase * 0.5 + thin * 0.3 + shift * 0.2)


def matched_phrases(low: Column, category: str, lexicon: dict[str, list[str]] | None = None) -> Column:
    """The category's phrases that occur in the lower-case text, as substrings, in alphabetical order."""
    phrases, none = sorted(set((lexicon or L.PHRASES)[category])), F.array().cast("array<string>")
    found = F.filter(F.array(*[F.lit(p) for p in phrases]).cast("array<string>"), lambda p: F.coalesce(low.contains(p), F.lit(False)))
    return F.when(reduce(Column.__or__, [low.contains(p) for p in phrases], F.lit(False)), found).otherwise(none)  # most texts have none


def rounded(x: Column, digits: int) -> Column:
    """x to `digits` decimals by its exact binary value, halves to even, as Python and C round it.

    Spark's round() goes by the shortest decimal text instead, and so lifts the double below 0.075 to 0.08. Here x is
    split in two parts whose products with a small integer are exact, so that the side of the half-way point on which x
    lies is known. x is finite, and below 2^50 after the shift by `digits`; null stays null.
    """
    shift = float(10**digits)
    wide = x * float(2**27 + 1)
    high = wide - (wide - x)
    below = F.floor(x * shift).cast("double")
    side = (high * (2 * shift) - (2 * below + 1)) + (x - high) * (2 * shift)
    return F.when(side > 0, below + 1).when(side < 0, below).otherwise(below + F.pmod(below, F.lit(2.0))) / shift


def two_decimals(x: Column) -> Column:
    """x as text with two decimals."""
    return F.format_string("%.2f", rounded(x, 2))


def finding_summary(scores: dict[str, Column], least: float) -> Column:
    """The scores from `least` up, highest first, as label=score, joined by bars; at least the best one if above 0."""
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("n"), F.lit(label).alias("label")) for label, s in sorted(scores.items())]))
    shown = F.filter(ranked, lambda s: -s["n"] >= least)
    best = F.filter(F.slice(ranked, 1, 1), lambda s: -s["n"] > 0)
    text = lambda s: F.concat(s["label"], F.lit("="), two_decimals(-s["n"]))
    return F.array_join(F.transform(F.when(F.size(shown) > 0, shown).otherwise(best), text), "|")


def band(x: Column, high: float, medium: float) -> Column:
    return F.when(x >= high, "high").when(x >= medium, "medium").otherwise("low")


def line_number(text: Column, at: Column) -> Column:
    """1 plus the newlines in the first `at` characters."""
    before = F.substring(text, F.lit(1), F.greatest(at, F.lit(0)))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).cast("int")


def line_label(start: Column, end: Column, prefix: str = "") -> Column:
    one = F.concat(F.lit(f"{prefix}L"), start.cast("string"))
    return F.when(start == end, one).otherwise(F.concat(one, F.lit("-L"), end.cast("string")))
