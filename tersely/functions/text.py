"""Text rewrites as column expressions."""

from __future__ import annotations

import json
import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.functions.names import let
from tersely.functions.rules import CATEGORIES, FOLDED, rules

#: Unicode classes, line ends of ``\n`` only, and case folding where the category asks for it.
_FLAGS = {True: "(?iuUd)", False: "(?Ud)"}
MONTHS = "January February March April May June July August September October November December".split()


def _java(category: str, ascii_only: bool = False) -> list[tuple[str, str]]:
    if ascii_only:
        return [(ascii_pattern(p, category in FOLDED), r) for p, r in rules(category)]
    flags = _FLAGS[category in FOLDED]
    return [(flags + p, r) for p, r in rules(category)]


# classes where words are of ASCII only, as Java has them without (?U) but for its white space, and an edge of such a word
_ASCII_CLASSES = {"w": r"\w", "s": r"\t\n\f\r ", "d": r"\d"}
_BEFORE, _AFTER = r"(?<!\w)", r"(?!\w)"
_EDGE = rf"(?:(?<=\w){_AFTER}|{_BEFORE}(?=\w))"
# the same where what follows is a letter or digit, in ASCII or counted as one
_OPENING = "(?<!\\w(?![\u017f\u212a]))(?=\\w|(?<=\\w)[\u017f\u212a])"
#: The letters outside of ASCII that count as one of ASCII where case is ignored.
_ALSO = {"s": "\u017f", "k": "\u212a"}


@cache
def ascii_pattern(pattern: str, ignore_case: bool) -> str:
    """``pattern`` for ``regexp_replace`` as an engine reads it whose words, digits and white space are those of ASCII, such as the one of SQL.

    There an accented letter ends a word.  Case is ignored by simple folding: a long s is an s and the sign of kelvin a k, but no dotless i is an i.
    """
    folded = ignore_case or pattern.startswith("(?i)")
    also = lambda chars: "".join(_ALSO[c] for c in chars if folded)
    out, k, letter = [], 0, False
    while k < len(pattern):
        c, size = pattern[k], 1
        plain = c.isalnum() and not (folded and c.lower() in _ALSO)
        new = f"[{c}{also(c.lower())}]" if c.lower() in _ALSO and folded else c
        if c == "\\":
            kind, size = pattern[k + 1], 2
            rest = pattern[k + 2 :]
            after = re.match(r"[0-9A-Za-z](?![?*{])|", rest)[0]
            opening = "|" not in pattern and re.match(r"\(*(?:[0-9A-Za-z]|\\w|\[[\w-]+\])(?![?*{])", rest)
            if kind == "b":
                # beside a letter of ASCII only one side is open
                alone = after and not (folded and after.lower() in _ALSO)
                new, plain = _AFTER if letter else _BEFORE if alone else _OPENING if opening else _EDGE, False
            elif kind in _ASCII_CLASSES:
                new, plain = f"[{_ASCII_CLASSES[kind]}{also('sk') if kind == 'w' else ''}]", kind == "d" or kind == "w" and not folded
            elif kind in "WSDB":
                raise ValueError(f"{pattern!r}: no class of the other characters")
            else:
                new, plain = pattern[k : k + 2], False
        elif c == "[":
            size = pattern.index("]", k + 2) + 1 - k
            body = re.sub(r"\\([wsd])", lambda m: _ASCII_CLASSES[m[1]], pattern[k : k + size])
            holds = lambda x, body=body: bool(re.fullmatch(body, x, re.I)) != body.startswith("[^")
            new, plain = body[:-1] + also([x for x in _ALSO if holds(x)]) + "]", False
        elif pattern.startswith("(?", k):
            size = re.match(r"\(\?(?:[a-z]+\)|[:=!]|<[=!])", pattern[k:]).end()
            new, plain = pattern[k : k + size], False
        elif c == "{":
            size = pattern.index("}", k) + 1 - k
            new, plain = pattern[k : k + size], False
        out.append(new)
        letter, k = plain, k + size
    return ("(?id)" if folded else "(?d)") + "".join(out)


def apply_category(text: Column, category: str) -> Column:
    """The category's rules in order, each replacing all its matches."""
    return reduce(lambda t, rule: F.regexp_replace(t, F.lit(rule[0]), F.lit(rule[1])), _java(category), text)


RULE = "array<struct<p:string,r:string,w:array<string>>>"


def _rows(category: str, since: tuple[str, ...] = (), ascii_only: bool = False) -> Column:
    """The rules of a category as one constant array: pattern, replacement, and the words of which a text must hold one."""
    rows = [{"p": p, "r": r, "w": list(g) or None} for (p, r), g in zip(_java(category, ascii_only), gates(category, since))]
    return F.from_json(F.lit(json.dumps(rows)), RULE)


def apply_folded(text: Column, category: str) -> Column:
    """As ``apply_category``, folded over an array of the rules: for chains of categories too long for one generated method."""
    return F.aggregate(_rows(category), text, lambda acc, rule: F.regexp_replace(acc, rule["p"], rule["r"]))


def apply_counted(text: Column, category: str) -> Column:
    """``struct(text, hits)``: as ``apply_category``, with the number of rules that matched.

    The rules are an array that the text is folded over, so any number of them stays one flat expression.
    """
    start = F.struct(text.alias("text"), F.lit(0).alias("hits"))
    return F.aggregate(_rows(category), start, lambda acc, rule: F.struct(F.regexp_replace(acc["text"], rule["p"], rule["r"]).alias("text"), (acc["hits"] + F.rlike(acc["text"], rule["p"]).cast("int")).alias("hits")))


_WORD = re.compile(r"(?:\\b|\\s\+)([a-z]+)(s\?)?(?=\\b|\\s\+)", re.I)
_ALTERNATIVE = re.compile(r"([a-z]+)(s\?)?(?=$|\\s\+)", re.I)


def required_words(pattern: str) -> list[list[str]]:
    """Lists of words of which a text must hold one, whole and in any case, for ``pattern`` to match.

    Words count that stand between ``\\b`` and ``\\s+`` outside of groups, and the first words of a group's alternatives.
    """
    flat, depth, groups, k = "", 0, [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            flat += "" if depth else pattern[k : k + 2]
            k += 2
            continue
        if c == "[":
            flat += "" if depth else "\0"
            k = pattern.index("]", k + 2) + 1
            continue
        if c == "(":
            begin = k if not depth else begin
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                groups.append((len(flat), pattern[begin + 1 : k]))
                flat += "\1"
        elif not depth:
            flat += c
        k += 1
    if "|" in flat:
        return []
    forms = lambda m: [m[1].lower() + x for x in (("", "s") if m[2] else ("",))]
    at, out = 0, []
    while m := _WORD.search(flat, at):
        out.append(forms(m))
        at = m.end()
    for at, group in groups:
        # a group with groups of its own, or an optional one, says nothing
        if flat[:at].endswith(("\\b", "\\s+")) and flat[at + 1 :].startswith(("\\b", "\\s+")) and group.startswith("?:") and "(" not in group[2:]:
            firsts = [_ALTERNATIVE.match(x) for x in group[2:].split("|")]
            if all(firsts):
                out.append([w for m in firsts for w in forms(m)])
    return out


@cache
def gates(category: str, since: tuple[str, ...] = ()) -> tuple[tuple[str, ...], ...]:
    """For each rule of a category, words of which a text must hold one; none where the rule is always tried.

    The text is looked at before the categories ``since``: a word that one of their rules, or an earlier one of this category,
    can bring counts with all that lets that rule match.
    """
    brought: dict[str, list[tuple[str, ...]]] = {}
    bring = lambda gate, to: [brought.setdefault(w, []).append(gate) for w in re.findall(r"[a-z]+", to.lower())]
    for k, c in enumerate(since):
        for gate, (_, to) in zip(gates(c, since[:k]), rules(c)):
            bring(gate, to)
    out = []
    for pattern, to in rules(category):
        found = []
        for words in required_words(pattern) if category in FOLDED else []:
            causes = [g for w in words for g in brought.get(w, [])]
            if all(causes):
                found.append(tuple(sorted({*words, *(w for g in causes for w in g)})))
        gate = max(found, key=lambda ws: (min(map(len, ws)), -len(ws)), default=())
        out.append(gate)
        bring(gate, to)
    return tuple(out)


def words_held(text: Column, needed: set[str], ascii_only: bool = False) -> Column:
    """Which of the words ``needed`` are in the text, in any case; where words are of ASCII only and a text holds a letter outside of
    it that counts as one of ASCII, all are."""
    if needed and ascii_only:
        low, all_ = F.lower(F.translate(text, "\u0130", " ")), F.array(*map(F.lit, sorted(needed)))
        found = F.array_intersect(all_, F.split(low, r"\W+"))
        return F.when(F.rlike(text, F.lit(f"[{''.join(_ALSO.values())}]")), all_).otherwise(found)
    # the letters that ignoring case treats as these
    low = F.lower(F.translate(text, "\u017f\u0130\u0131\u212a", "siik"))
    return F.array_intersect(F.array(*map(F.lit, sorted(needed))), F.split(low, r"(?U)\W+")) if needed else F.array().cast("array<string>")


def held(text: Column, *chain: str, ascii_only: bool = False) -> Column:
    """Which of the words that the rules of a chain of categories need are in the text: one reading instead of one for each rule.

    It stays true while these rules change the text, as they leave words whole.
    """
    return words_held(text, {w for k, c in enumerate(chain) for g in gates(c, chain[:k]) for w in g}, ascii_only)


def held_as_is(text: Column, *categories: str) -> Column:
    """As ``held``, for rules that are all tried on the text as it stands."""
    return words_held(text, {w for c in categories for g in gates(c) for w in g})


def apply_gated(text: Column, category: str, words: Column, since: tuple[str, ...] = (), ascii_only: bool = False) -> Column:
    """As ``apply_category``, but only those rules are tried whose words the text held before the categories ``since``.

    ``words`` are worked out once for each row.  With ``ascii_only``, here and in ``words``, the rules are read as ``ascii_pattern`` says.
    """
    tried = lambda w: F.filter(_rows(category, since, ascii_only), lambda rule: rule["w"].isNull() | F.arrays_overlap(rule["w"], w))
    return let(words, lambda w: F.when(w.isNotNull(), F.aggregate(tried(w), text, lambda acc, rule: F.regexp_replace(acc, rule["p"], rule["r"]))))


def matching_rules(text: Column, category: str, words: Column) -> Column:
    """Ids (``category.number``) of the rules of a category that match ``text`` as it stands; ``words``: what is ``held_as_is``."""
    name = lambda i: F.concat(F.lit(f"{category}."), F.lpad(i.cast("string"), 3, "0"))
    tried = let(words, lambda w: F.transform(_rows(category), lambda rule, i: F.when((rule["w"].isNull() | F.arrays_overlap(rule["w"], w)) & F.rlike(text, rule["p"]), name(i))))
    return F.filter(tried, lambda x: x.isNotNull())


def match_counts(text: Column, words: Column, categories: tuple[str, ...] = CATEGORIES) -> Column:
    """``array<struct<category, hits>>``: for each category the number of its rules that match ``text`` as it stands; ``words``: what
    is ``held_as_is``."""
    hit = lambda c, w: F.size(F.filter(_rows(c), lambda rule: (rule["w"].isNull() | F.arrays_overlap(rule["w"], w)) & F.rlike(text, rule["p"])))
    return let(words, lambda w: F.array(*[F.struct(F.lit(c).alias("category"), F.when(text.isNull(), 0).otherwise(hit(c, w)).alias("hits")) for c in categories]))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalize_whitespace(text: Column) -> Column:
    for pattern, to in ((r"\n{3,}", "\n\n"), (r" {2,}", " "), (r" +\n", "\n"), (r" +([.,;:!?])", "$1"), (r"\n +\n", "\n\n")):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return strip(text)


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{2,}", "\n")


def compress_dates(text: Column) -> Column:
    """``January 14th, 2025`` and ``14 January 2025`` to ``2025-01-14``."""
    out = text
    for n, month in enumerate(MONTHS, 1):
        for before, after in ((rf"(?i)\b{month}\s+", r"(?:st|nd|rd|th)?\s*,?\s*(\d{4})\b"), (r"(?i)\b", rf"(?:st|nd|rd|th)?\s+{month}\s*,?\s*(\d{{4}})\b")):
            out = F.regexp_replace(out, F.lit(before + r"(\d)" + after), F.lit(f"$2-{n:02d}-0$1"))
            out = F.regexp_replace(out, F.lit(before + r"(\d{2})" + after), F.lit(f"$2-{n:02d}-$1"))
    low = F.lower(text)
    named = reduce(lambda a, b: a | b, [low.contains(m.lower()) for m in MONTHS])
    return F.when(named, out).otherwise(text)  # 48 passes only where a month is named


def sentences(text: Column) -> Column:
    """Sentences: cut at white space between ``.!?`` and a capital, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z])"), strip), lambda s: s != "")


def text_tokens(text: Column) -> Column:
    """Estimated tokens: bytes / 3.5, or / 3 inside closed code fences; at least 1 of a text that isn't empty."""
    code = F.aggregate(F.regexp_extract_all(text, F.lit(r"(?s)```.*?```"), 0), F.lit(0), lambda n, s: n + F.octet_length(s))
    size = F.octet_length(text)
    return F.when(F.coalesce(size, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.round((size - code) / 3.5 + code / 3.0).cast("int"))).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def paired_counts(a: Column, b: Column) -> Column:
    """``array<struct<x, y>>``: how often each different string of two arrays stands in the first and in the second.

    The second's get a space behind them, which sorts before all that words are made of, so a word's counts stand side by side.
    """
    def count(s: Column, i: Column) -> Column:
        at, n = lambda k: F.get(s, F.get(i, k)), lambda k: (F.get(i, k + 1) - F.get(i, k)).cast("long")
        first, none = lambda k: ~at(k).endswith(" "), F.lit(0).cast("long")
        pair = lambda k: F.struct(F.when(first(k), n(k)).otherwise(none).alias("x"), F.when(~first(k), n(k)).when(at(k + 1) == F.concat(at(k), F.lit(" ")), n(k + 1)).otherwise(none).alias("y"))
        new = lambda k: first(k) | (k == 0) | (F.concat(at(k - 1), F.lit(" ")) != at(k))
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(i) - 2, F.lit(0))), lambda k: (F.size(s) > 0) & new(k)), pair)

    both = F.sort_array(F.concat(a, F.transform(b, lambda w: F.concat(w, F.lit(" ")))))
    edges = lambda s: F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
    return let(both, lambda s: let(edges(s), lambda i: count(s, i)))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared share of the lower-case words of two texts; 1 if both have none, 0 if one has."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)(\w+)"), 1))
    x, y = words(a), words(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.octet_length(a), F.octet_length(b)
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y))
