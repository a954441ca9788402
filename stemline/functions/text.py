"""Text and token functions as Columns; patterns are built through the DataFrame API, never as SQL literals."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column

#: Apostrophes that stand for the ASCII one, and contractions that no rule covers.
APOSTROPHES = "’ʼ＇‘"
IRREGULAR = {"won't": "will not", "can't": "can not", "shan't": "shall not", "ain't": "am not"}
CLITICS = {"'ll": "will", "'ve": "have", "'re": "are", "'m": "am"}
#: Suffixes in the order in which they are tried.
SUFFIXES = ("ness", "ment", "tion", "sion", "able", "ible", "ful", "less", "ing", "edly", "ed", "est", "er", "es", "ly", "al", "y", "s")
#: Closed-class words that carry structure only.
CONNECTORS = (
    "a an the this that these those some any no every each either neither "
    "of to in on at by for with from into onto upon over under about against between among through during before after above below "
    "off out up down as than like near within without along across behind beyond despite since until till towards toward per via "
    "and but or nor so yet if because although though while unless whether "
    "i you he she it we they me him her us them who whom which what whose myself yourself himself herself itself ourselves "
    "yourselves themselves my your his its our their mine yours hers ours theirs "
    "is am are was were be been being have has had do does did will would shall should can could may might must"
).split()
_VOWELS = "aeiou"


def fold_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))


def expand_contractions(text: Column) -> Column:
    """Contractions of lower-case text to their words; ``'s`` and ``'d`` are left, being ambiguous."""
    folded = t = fold_apostrophes(text)
    for short, full in IRREGULAR.items():
        t = F.regexp_replace(t, rf"(?U)\b{short}\b", full)
    t = F.regexp_replace(t, r"(?U)(\w+)n't\b", "$1 not")
    for short, full in CLITICS.items():
        t = F.regexp_replace(t, rf"(?U){short}\b", f" {full}")
    return F.when(F.contains(folded, F.lit("'")), t).otherwise(folded)  # most texts need no pattern at all


def tokens(text: Column) -> Column:
    """Lower-case runs of the letters a to z, longer than one, of a text with its contractions expanded."""
    return F.filter(F.regexp_extract_all(expand_contractions(F.lower(text)), F.lit(r"[a-z]+"), F.lit(0)), lambda t: F.length(t) > 1)


def _last(c: Column, n: int = 1) -> Column:
    return F.substring(c, -n, n)


def _consonant(c: Column) -> Column:
    return F.rlike(c, F.lit("^[a-z]$")) & ~c.isin(*_VOWELS)


def stem_variants(stem: Column) -> Column:
    """Spellings a stem may have had before its suffix: a doubled consonant undone, or else a dropped e restored; y for i; bare; with e."""
    last, before = _last(stem), F.substring(stem, -2, 1)
    body = F.substring(stem, F.lit(1), F.length(stem) - 1)
    n = F.length(stem)
    doubled = (n >= 3) & (last == before) & _consonant(last)
    dropped = (n >= 2) & _consonant(last) & ~last.isin("w", "x", "y") & ~_consonant(before)
    forms = F.array(
        F.when(doubled, body).when(dropped, F.concat(stem, F.lit("e"))),
        F.when((last == "i") & (n >= 2), F.concat(body, F.lit("y"))),
        stem,
        F.concat(stem, F.lit("e")),
    )
    return F.array_distinct(F.array_compact(forms))


def stem_candidates(word: Column) -> Column:
    """What a word may be derived from, in the order to try: per suffix that it ends in, the variants of a stem of two letters or more."""

    def per(suffix: str) -> Column:
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        return F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) >= len(suffix) + 2), stem_variants(stem)).otherwise(F.array().cast("array<string>"))

    all_ = F.flatten(F.array(*[per(s) for s in SUFFIXES]))
    return F.array_distinct(F.filter(F.concat(all_, cy_candidates(word)), lambda c: c != word))


def cy_candidates(word: Column) -> Column:
    """``-cy`` comes from ``-t`` or ``-te`` where five letters or more are left."""
    stem = F.substring(word, F.lit(1), F.length(word) - 2)
    return F.when(F.endswith(word, F.lit("cy")) & (F.length(word) >= 7), F.array(F.concat(stem, F.lit("t")), F.concat(stem, F.lit("te")))).otherwise(F.array().cast("array<string>"))


def regular_forms(word: Column) -> Column:
    """Regular inflected spellings of a word, without itself."""
    n = F.length(word)
    body = F.substring(word, F.lit(1), n - 1)
    hiss = F.rlike(word, F.lit("(s|x|z|ch|sh)$"))
    y = (n > 2) & F.endswith(word, F.lit("y")) & ~F.substring(word, -2, 1).isin(*_VOWELS)
    e = F.endswith(word, F.lit("e"))
    forms = F.array(
        F.concat(word, F.lit("s")),
        F.when(hiss, F.concat(word, F.lit("es"))),
        F.when(y, F.concat(body, F.lit("ies"))),
        F.when(e, F.concat(word, F.lit("d"))).otherwise(F.concat(word, F.lit("ed"))),
        F.when(e, F.concat(body, F.lit("ing"))).otherwise(F.concat(word, F.lit("ing"))),
    )
    return F.filter(F.array_distinct(F.array_compact(forms)), lambda f: f != word)


def root_key(term: Column) -> Column:
    """The key of a reconstructed form: blanks go first, then asterisks, then blanks."""
    return F.trim(F.regexp_replace(F.trim(term), r"^\*+", ""))


def descendant_term(term: Column) -> Column:
    """A stored form's bare term: asterisks go first, then blanks; empty is null."""
    t = F.trim(F.regexp_replace(term, r"^\*+", ""))
    return F.when(t != "", t)


def is_reconstructed(term: Column) -> Column:
    return F.coalesce(F.startswith(term, F.lit("*")), F.lit(False))


def is_affix(term: Column) -> Column:
    """Written as an affix: longer than one sign, with a hyphen at either end."""
    t = F.trim(term)
    return F.coalesce((F.length(t) > 1) & (F.startswith(t, F.lit("-")) | F.endswith(t, F.lit("-"))), F.lit(False))


def is_bound(term: Column, flag: Column) -> Column:
    """The access layer's test: flagged at the source, or written as an affix."""
    return F.coalesce(flag, F.lit(False)) | is_affix(term)


def is_bound_part(term: Column, flag: Column) -> Column:
    """The splitter's test: flagged, or changed by taking hyphens off its ends, or nothing left without them."""
    bare = F.regexp_replace(term, r"^-+|-+$", "")
    return F.coalesce(flag, F.lit(False)) | F.coalesce((bare != term) | (bare == ""), F.lit(True))


def clean_term(term: Column) -> Column:
    """A template's term: null for an anchor (leading colon), no ``#sense``, and of ``term<mods>`` the part before them."""
    t = F.regexp_replace(F.regexp_replace(term, r"(?s)<.*$", ""), r"#.*$", "")
    t = F.trim(t)
    return F.when(F.startswith(F.trim(term), F.lit(":")) | (t == ""), F.lit(None)).otherwise(t)


def modifiers(term: Column, name: str) -> Column:
    """The value of a flat ``<name:value>`` after a term, or null."""
    v = F.regexp_extract(term, rf"<{name}:([^<>]*)>", 1)
    return F.when(v != "", v)


def language_prefix(term: Column) -> Column:
    """``struct(code, term)`` of ``code:term``; both null where the shape is another. Whether the code is known is a join's question."""
    pattern = r"^([a-z][a-z-]{1,11}):(.+)$"
    hit = F.rlike(term, F.lit(pattern))
    return F.struct(F.when(hit, F.regexp_extract(term, pattern, 1)).alias("code"), F.when(hit, F.regexp_extract(term, pattern, 2)).alias("term"))


def template_calls(text: Column) -> Column:
    """``array<array<string>>``: name and arguments of each flat ``{{name|a|b}}``."""
    calls = F.regexp_extract_all(text, F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1))
    return F.transform(calls, lambda c: F.transform(F.split(c, r"\|"), lambda p: F.trim(p)))


def confirmed_root(text: Column) -> Column:
    """The ``root`` template of a page, unless its first template says that nothing is certain."""
    calls = template_calls(text)
    first = F.try_element_at(F.try_element_at(calls, F.lit(1)), F.lit(1))
    roots = F.filter(calls, lambda c: F.try_element_at(c, F.lit(1)) == "root")
    return F.when(first.isin("unc", "unk"), F.lit(None)).otherwise(F.try_element_at(roots, F.lit(1)))


def page_title(lang: Column, term: Column) -> Column:
    """Reconstructed forms live under their own namespace by language."""
    return F.when(is_reconstructed(term), F.concat(F.lit("Reconstruction:"), lang, F.lit("/"), root_key(term))).otherwise(term)


def page_url(title: Column, base: str) -> Column:
    """Percent-encoded, blanks as underscores, slashes kept."""
    enc = F.url_encode(F.regexp_replace(title, " ", "_"))
    return F.concat(F.lit(base), F.regexp_replace(F.regexp_replace(enc, r"\+", "%20"), "%2F", "/"))


def local_name(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1)


def sentence_with(text: Column, name: str, most: int = 200) -> Column:
    """The first sentence that holds ``name``, else the beginning of the text."""
    s = F.trim(F.regexp_extract(text, rf"([^.!?]*\b{name}\b[^.!?]*[.!?]?)", 1))
    return F.when(s != "", s).otherwise(F.substring(text, 1, most))


def truncated(text: Column, most: int = 200, mark: str = "") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def mid_sentence_capitals(text: Column) -> Column:
    """Lower-case forms of words that begin with a capital without beginning a sentence."""
    t = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[.!?]"), F.lit(0))
    # zipped with itself moved by one: a lookup by place would extract anew for every element
    before = F.concat(F.array(F.lit(".")), t)
    hits = F.zip_with(t, before, lambda w, p: F.when(F.rlike(w, F.lit("^[A-Z]")) & ~p.isin(".", "!", "?"), F.lower(w)))
    return F.array_distinct(F.array_compact(hits))


def first_value(args: Column, keys: tuple[str, ...], placeholders: tuple[str, ...] = ("-", "", "...")) -> Column:
    """The first of ``keys`` in a map of arguments that holds more than a placeholder."""
    values = [F.trim(args[k]) for k in keys]
    return reduce(lambda acc, v: F.coalesce(acc, F.when(~v.isin(*placeholders), v)), values, F.lit(None).cast("string"))


def gloss_of(args: Column) -> Column:
    """An explicit gloss of a template's arguments, by the keys that may carry one."""
    return first_value(args, ("t", "gloss", "5", "4"))


def starred_term_of(args: Column) -> Column:
    """The first argument that is a reconstructed form, by the keys that may carry one."""
    values = [args[k] for k in ("3", "2", "4")]
    return reduce(lambda acc, v: F.coalesce(acc, F.when(F.startswith(v, F.lit("*")), v)), values, F.lit(None).cast("string"))


def bar(percent: Column) -> Column:
    """One sign for two percent, halves to even."""
    return F.repeat(F.lit("#"), F.bround(percent / 2).cast("int"))


def in_dictionary_pool(word: Column) -> Column:
    """Lower-case letters only, three to nineteen of them."""
    return F.rlike(word, F.lit(r"^\p{Ll}{3,19}$"))


def asserts(text: Column, claim: str, denial: str) -> Column:
    """A claim is made and not denied; both are patterns without case."""
    return F.coalesce(F.rlike(text, F.lit(f"(?i){claim}")) & ~F.rlike(text, F.lit(f"(?i){denial}")), F.lit(False))


def report_line(bucket: Column, percent: Column) -> Column:
    """One line of a report: the group, its share, its bar."""
    return F.concat(F.format_string("  %-16s %5.1f%%  ", bucket, F.bround(percent, 1)), bar(percent))
