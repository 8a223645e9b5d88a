"""Rule programs: an ordered chain of rewrite rules that is folded over a text by one expression.

A program is a constant array of steps.  ``aggregate()`` carries the text through it, with the words that it holds, whether the last test of it
came out true, and the categories of the rules that matched.  A rule is tried where the row's level reaches its category's threshold for the row's profile,
where the text holds one of the words without which its pattern can't match, and where it holds one of the literals that every match has.
However many rules a program has, it is one small expression, so it is planned in no time and its rules never overflow a generated method.

Which words and literals a pattern needs is worked out from the pattern, so rules that users bring are gated as the built-in ones are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import partial, reduce
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.functions.names import let
from tersely.functions.normalize import code_or_json
from tersely.functions.rules import FOLDED, THRESHOLDS, rules
from tersely.functions.text import MONTHS, required_words, words_held

#: Profiles in the order of a step's thresholds; a profile that is none of these counts as the last.
PROFILES = ("aggressive", "conservative", "balanced")
#: The flags that rules run with: Unicode classes, line ends of ``\n`` only, and case folding where the category asks for it.
FLAGS = {True: "(?iuUd)", False: "(?Ud)"}
#: Most rules of a user's rule table, which is read whole.
MOST_RULES = 5000
#: Most literals that stand for each other in a test before a rule is tried.
MOST_LITERALS = 32
#: What trying a rule costs, in tests of one literal, and the share of texts that hold a literal still for each character more.
TRIED, RARER = 25, 0.7
#: What Java reads otherwise than the parser that looks for literals: nested classes, intersections, and some escapes.
OTHERWISE = re.compile(r"&&|\[\^?\]?[^\]]*\[|\\[v0-9NbB]\{|\\[v0NRXhHGQE]")
STEP = "array<struct<k:string,c:int,p:string,r:string,g:int,l:array<string>,f:array<string>,tested:boolean,t:array<double>>>"


@dataclass(frozen=True)
class Step:
    """One rewrite; ``category`` is None where its matches are not counted.  ``at`` has a threshold for each profile.

    With ``reads`` it is no rewrite: ``words`` has the text's words read, ``nothing`` has what was read forgotten, as rules before may have
    changed it, ``code`` and ``months`` test whether the text is code or names a month, which rules with ``tested`` need.
    """

    pattern: str = ""
    replacement: str = ""
    category: str | None = None
    ignore_case: bool = False
    at: dict[str, float] | None = None
    tested: bool = False
    reads: str | None = None


@dataclass(frozen=True)
class Program:
    categories: tuple[str, ...]
    steps: list[dict] = field(repr=False)
    #: for each word the gates that it opens
    opens: dict[str, list[int]] = field(repr=False, default_factory=dict)


def literal(pattern: str, ignore_case: bool) -> str | None:
    """The longest run of characters that every match of ``pattern`` holds; None if there is none.

    Only characters outside of groups and classes count; where case is ignored, no letters do.
    """
    runs, run, depth, k = [], "", 0, 0
    folded = ignore_case or re.match(r"\(\?[a-z]*i", pattern) is not None

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while k < len(pattern):
        c, size = pattern[k], 1
        if c == "\\":
            size, one = 2, pattern[k + 1 : k + 2]
            char = "\n" if one == "n" else one if one and not one.isalnum() else ""
            if one in "xuQpPk" or one.isdigit():
                return None
        elif c == "[":
            stop = pattern.find("]", k + 2)
            if stop < 0:
                return None
            size, char = stop + 1 - k, ""
        else:
            char = "" if c in "().^$|*+?{}" else c
        if c == "(":
            depth += 1
            if not depth - 1:
                end()
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            return None
        elif not depth and c not in "*+?{":
            more = re.match(r"[*?]|\{(\d*)[^}]*\}", pattern[k + size :])
            least = 0 if more and more[0][0] in "*?" else int(more[1] or 0) if more else 1
            if not char or char.isalpha() and folded:
                end()
            elif more or pattern[k + size : k + size + 1] == "+":
                run += char * least
                end()
            else:
                run += char
        elif not depth and c == "{":
            size = pattern.index("}", k) + 1 - k
        k += size
    end()
    return max(runs, key=len) or None


def literals(pattern: str, ignore_case: bool) -> tuple[bool, list[str]] | None:
    """Whether case is ignored, and strings of which every match of ``pattern`` holds one; None if there are none.

    Where case is ignored they are those of ``lowered`` texts: in lower case, with one space for any white space.
    """
    if OTHERWISE.search(pattern):
        return None
    try:
        tree = parser.parse(pattern.replace(r"\z", r"\Z"))
    except (re.error, OverflowError, RecursionError):
        return None
    folded = ignore_case or bool(tree.state.flags & re.I)
    space = (parser.IN, [(parser.CATEGORY, parser.CATEGORY_SPACE)])

    def short(found: set[str]) -> set[str]:
        found = {re.sub(" +", " ", x) for x in found} if folded else found
        return {x for x in found if not any(y != x and y in x for y in found)}

    def best(runs: list[set[str]]) -> set[str] | None:
        runs = [short(x) for x in runs]
        return min((x for x in runs if x and "" not in x and len(x) <= MOST_LITERALS), key=lambda x: len(x) + TRIED * RARER ** (min(map(len, x)) - 1), default=None)

    def char(code: int) -> set[str] | None:
        c = chr(code).lower() if folded else chr(code)
        return None if folded and code > 127 else {" " if folded and c.isspace() else c}

    def one(op, av) -> tuple[set[str] | None, list[set[str]]]:
        """All strings that an item matches, None if they can't be told, and sets of which each match of it holds one."""
        if op is parser.LITERAL:
            return char(av), []
        if op in (parser.AT, parser.ASSERT, parser.ASSERT_NOT):
            return {""}, []
        if op is parser.IN:
            each = [{" "} if x == space[1][0] and folded else char(x[1]) if x[0] is parser.LITERAL else None for x in av]
            return (set().union(*each) if all(each) and len(each) <= 8 else None), []
        if op is parser.SUBPATTERN:
            return (None, []) if av[1] or av[2] else row(av[3])
        if op is parser.BRANCH:
            parts = [row(x) for x in av[1]]
            if all(x is not None for x, _ in parts):
                return set().union(*(x for x, _ in parts)), []
            found = [best([*runs, *([x] if x else [])]) for x, runs in parts]
            return None, [set().union(*found)] if all(found) else []
        if op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
            least, most, items = av
            if folded and list(items) == [space]:
                return ({" "} if least else {"", " "}), []
            exact, runs = row(items)
            if exact is not None and most == 1:
                return exact | (set() if least else {""}), []
            return None, ([exact] if exact else runs) if least else []
        return None, []

    def row(items) -> tuple[set[str] | None, list[set[str]]]:
        runs, now, whole = [], {""}, True
        for op, av in items:
            exact, inner = one(op, av)
            if exact is not None and len(now) * len(exact) <= MOST_LITERALS:
                runs += [now] if len(exact) > 1 else []
                now = {a + b for a in now for b in exact}
                continue
            whole = False
            # what is repeated stands behind what is before it and before what follows
            again = inner[0] if exact is None and len(inner) == 1 and op in (parser.MAX_REPEAT, parser.POSSESSIVE_REPEAT) and row(av[2])[0] else {""}
            ahead = {a + b for a in now for b in again} if len(now) * len(again) <= MOST_LITERALS else now
            runs += [ahead, *inner, *([exact] if exact else [])]
            now = again
        return (now if whole else None), runs + [now]

    exact, runs = row(tree)
    found = best(runs)
    return (folded, sorted(found)) if found else None


def lowered(text: Column) -> Column:
    """``text`` in lower case, letters that ignoring case treats as those of ASCII as these, with one space for any white space."""
    rare = "\u017f\u0130\u0131\u212a"
    plain = F.when(F.rlike(text, F.lit(f"[{rare}]")), F.translate(text, rare, "siik")).otherwise(text)
    # single spaces, which are nearly all white space, stay as they are
    return F.regexp_replace(F.lower(plain), r"(?U)\s{2,}|[^\S ]", " ")


def compiled(steps: Iterable[Step], categories: tuple[str, ...]) -> Program:
    """A program of steps; rules before the text's words are read are tried whatever words it has."""
    out, gates, brought = [], {}, {}
    for step in steps:
        at = [step.at.get(p, step.at["balanced"]) for p in PROFILES] if step.at else None
        if step.reads:
            out.append({"k": step.reads, "t": at})
            brought = {} if step.reads == "words" else brought
            continue
        found = []
        for words in required_words(step.pattern):
            # a word that an earlier replacement brings counts with all that lets that rule match
            causes = [g for w in words for g in brought.get(w, [])]
            if all(causes):
                found.append(tuple(sorted({*words, *(w for g in causes for w in g)})))
        gate = max(found, key=lambda ws: (min(map(len, ws)), -len(ws)), default=())
        for w in re.findall(r"[a-z]+", step.replacement.lower()):
            brought.setdefault(w, []).append(gate)
        number = gates.setdefault(gate, len(gates)) if gate else None
        folded, found = literals(step.pattern, step.ignore_case) or (False, None)
        alone = literal(step.pattern, step.ignore_case)
        if alone and len(alone) > (min(map(len, found)) if found else 0):
            folded, found = False, [alone]
        out.append({"c": categories.index(step.category) if step.category else -1, "p": FLAGS[step.ignore_case] + step.pattern, "r": step.replacement, "g": number, "l": None if folded else found, "f": found if folded else None, "tested": step.tested, "t": at})
    opens: dict[str, list[int]] = {}
    for gate, number in gates.items():
        for w in gate:
            opens.setdefault(w, []).append(number)
    return Program(categories, out, opens)


def names_month(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(m.lower()) for m in MONTHS])


def run(program: Program, text: Column, level: Column, profile: Column) -> Column:
    """``struct(text, hits)`` of a text after a program, with the numbers of the categories of all rules that matched, in order.

    A null text gives null; a null level or one of 0 and less gives the text with no hits.
    """
    number = F.coalesce(F.array_position(F.array(*map(F.lit, PROFILES)), profile).cast("int"), F.lit(0))
    place = F.when(number == 0, len(PROFILES) - 1).otherwise(number - 1)
    folds = any(step.get("f") for step in program.steps)
    low = lambda text: lowered(text) if folds else F.lit("")
    state = lambda text, on, hits, low: F.struct(text.alias("text"), on.alias("on"), hits.alias("hits"), low.alias("low"))
    unread = F.lit(None).cast("array<int>")
    opens = F.from_json(F.lit(json.dumps(program.opens)), "map<string,array<int>>")
    read = lambda text: F.flatten(F.transform(words_held(text, set(program.opens)), lambda w: F.try_element_at(opens, w)))
    holds = lambda found, text: found.isNull() | F.exists(found, lambda y: F.contains(text, y))

    def step(x: Column, s: Column) -> Column:
        tried = s["k"].isNull() & holds(s["f"], x["low"]) & holds(s["l"], x["text"]) & (~s["tested"] | x["on"])
        new = let(F.regexp_replace(x["text"], s["p"], s["r"]), lambda t: state(t, x["on"], F.when(s["c"] >= 0, F.concat(x["hits"], F.array(s["c"]))).otherwise(x["hits"]), low(t)))
        found = F.when(tried & F.rlike(x["text"], s["p"]), new)
        for name, test in (("code", code_or_json), ("months", names_month)):
            if any(step.get("k") == name for step in program.steps):
                found = found.when(s["k"] == name, state(x["text"], F.coalesce(test(x["text"]), F.lit(False)), x["hits"], x["low"]))
        return found.otherwise(x)

    def part(steps: list[dict], both: Column) -> Column:
        """``struct(state, open)`` after the steps from one reading of words to the next; only those are carried through whose gate is open."""
        gates = both["open"]
        if steps and steps[0].get("k") in ("words", "nothing"):
            first, *steps = steps
            now = read(both["state"]["text"]) if first["k"] == "words" and program.opens else unread
            reached = level >= F.get(F.array(*map(F.lit, first["t"])), place) if first["t"] else F.lit(True)
            gates = F.when(reached, now).otherwise(gates)
        constant = F.from_json(F.lit(json.dumps(steps)), STEP)
        fires = lambda s, g: (s["t"].isNull() | (level >= F.get(s["t"], place))) & (s["g"].isNull() | g.isNull() | F.array_contains(g, s["g"]))
        return let(gates, lambda g: F.struct(F.aggregate(F.filter(constant, lambda s: fires(s, g)), both["state"], step).alias("state"), g.alias("open")))

    parts: list[list[dict]] = [[]]
    for x in program.steps:
        if x.get("k") in ("words", "nothing"):
            parts.append([])
        parts[-1].append(x)
    start = let(text, lambda t: state(t, F.lit(False), F.array().cast("array<int>"), low(t)))
    done = F.struct(start.alias("state"), unread.alias("open"))
    for steps in filter(None, parts):
        done = let(done, partial(part, steps))
    bare = F.struct(text.alias("text"), F.array().cast("array<int>").alias("hits"))
    return F.when(text.isNotNull(), F.when(level > 0, let(done["state"], lambda x: F.struct(x["text"].alias("text"), x["hits"].alias("hits")))).otherwise(bare))


def tallied(hits: Column, categories: tuple[str, ...]) -> Column:
    """``array<struct<category, hits>>`` of the categories in their order, from the numbers of those that matched."""
    count = lambda h, k: F.size(F.filter(h, lambda x: x == k)).cast("bigint")
    return let(hits, lambda h: F.array(*[F.struct(F.lit(c).alias("category"), count(h, k).alias("hits")) for k, c in enumerate(categories)]))


# Categories in the order in which a request passes them, which is also the order of their counts.
ORDER = (
    "filler_phrases", "verbose_phrases", "imperative_conversions", "clause_collapse", "developer_boilerplate", "semantic_formatting", "credential_strip", "whitespace_cleanup",
    "conversational_strip", "ai_output_noise", "markdown_minification", "source_code_compression", "context_deduplication", "anti_noise", "disclaimer_collapse",
    "adjective_collapse", "clause_simplify", "adverb_strip",
)
DECLARED = ("agent_metadata", *ORDER)
#: White space put in order.
WHITE_SPACE = [(r"\n{3,}", "\n\n"), (r" {2,}", " "), (r" +\n", "\n"), (r" +([.,;:!?])", "$1"), (r"\n +\n", "\n\n"), (r"\A\s+|\s+\z", "")]
NEWLINES = (r"\n{2,}", "\n")


def dates() -> list[tuple[str, str]]:
    """Rules that write ``January 14th, 2025`` and ``14 January 2025`` as ``2025-01-14``."""
    out = []
    for n, month in enumerate(MONTHS, 1):
        for before, after in ((rf"\b{month}\s+", r"(?:st|nd|rd|th)?\s*,?\s*(\d{4})\b"), (r"\b", rf"(?:st|nd|rd|th)?\s+{month}\s*,?\s*(\d{{4}})\b")):
            out += [(before + r"(\d)" + after, f"$2-{n:02d}-0$1"), (before + r"(\d{2})" + after, f"$2-{n:02d}-$1")]
    return out


def _steps(category: str, at: dict[str, float] | None, **also) -> list[Step]:
    return [Step(p, r, category, category in FOLDED, at, **also) for p, r in rules(category)]


def request_steps() -> list[Step]:
    """The chain of a request's text, up to the steps on code, JSON and sentences."""
    steps = _steps("agent_metadata", None)
    for category in ORDER:
        at = {p: t[category] for p, t in THRESHOLDS.items()}
        plain = lambda pairs, at=at, **also: [Step(p, r, at=at, **also) for p, r in pairs]
        # metadata goes, and later marks inside of words: what was read before no longer holds
        before = {"filler_phrases": ["words"], "semantic_formatting": ["months"], "source_code_compression": ["code"], "markdown_minification": ["nothing"], "disclaimer_collapse": ["words"]}
        steps += [Step(reads=x, at=at) for x in before.get(category, [])]
        if category == "filler_phrases":
            steps += plain(WHITE_SPACE)
        if category == "semantic_formatting":
            steps += plain(dates(), ignore_case=True, tested=True)
        steps += _steps(category, at, tested=category == "source_code_compression")
        if category == "whitespace_cleanup":
            steps += plain([NEWLINES])
        if category == "adverb_strip":
            steps += _steps("whitespace_cleanup", at)
    return steps


def request_program() -> Program:
    return compiled(request_steps(), DECLARED)


def _everywhere(level: float) -> dict[str, float]:
    return dict.fromkeys(PROFILES, level)


def response_programs() -> tuple[Program, Program, Program]:
    """The chains of an old answer: before JSON is compacted, before code and sentences, and after them."""
    half, high = _everywhere(0.5), _everywhere(0.8)
    plain = lambda pairs, at: [Step(p, r, at=at) for p, r in pairs]
    first = [Step(reads="words")] + _steps("ai_output_noise", None) + plain(WHITE_SPACE, None) + _steps("markdown_minification", half) + _steps("whitespace_cleanup", half)
    second = plain([NEWLINES], half) + [Step(reads="words", at=high)] + [s for c in ("filler_phrases", "verbose_phrases", "adverb_strip", "conversational_strip") for s in _steps(c, high)]
    return tuple(compiled(x, DECLARED) for x in (first, second, _steps("whitespace_cleanup", high) + plain([NEWLINES], high)))


def _checked(spark: SparkSession, name: str, pattern: str | None, replacement: str | None) -> None:
    """An error that names the rule if its pattern does not compile, or its replacement has a group that the pattern lacks."""
    if not pattern:
        raise ValueError(f"rule {name}: no pattern")
    try:
        groups = spark._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except Exception as e:
        reason = str(getattr(e, "java_exception", e)).splitlines()[0]
        raise ValueError(f"rule {name}: {pattern!r} is no pattern: {reason}") from None
    bare = re.sub(r"\\.", "", replacement or "")
    for n in re.findall(r"\$(.?)", bare):
        if not n.isdigit() or int(n) > groups:
            raise ValueError(f"rule {name}: {replacement!r} has no group ${n} to take from {pattern!r}")


def user_program(rule_table: DataFrame, thresholds: DataFrame) -> Program:
    """A program from a user's rules and thresholds.

    ``rule_table``: ``category, rule_idx, pattern, replacement, ignore_case``, at most ``MOST_RULES`` rows; rules go by category, in the order
    of their names, then by ``rule_idx``; a null replacement deletes, a null ``ignore_case`` is false.
    ``thresholds``: ``category, profile, threshold``; a profile without one takes the balanced one, a category without any always fires.
    A rule that can't run is an error that names it as ``category.rule_idx``, before any text is read.
    """
    rows = rule_table.select("category", "rule_idx", "pattern", "replacement", "ignore_case").orderBy("category", "rule_idx", "pattern").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    at: dict[str, dict[str, float]] = {}
    for r in thresholds.select("category", "profile", "threshold").where("threshold is not null").distinct().limit(MOST_RULES + 1).collect():
        at.setdefault(r["category"], {})[r["profile"]] = float(r["threshold"])
    for category, values in at.items():
        if "balanced" not in values:
            raise ValueError(f"category {category}: no threshold for the balanced profile")
    steps = []
    for r in rows:
        _checked(rule_table.sparkSession, f"{r['category']}.{r['rule_idx']}", r["pattern"], r["replacement"])
        steps.append(Step(r["pattern"], r["replacement"] or "", r["category"], bool(r["ignore_case"]), at.get(r["category"])))
    return compiled([Step(reads="words"), *steps], tuple(dict.fromkeys(r["category"] for r in rows)))
