"""robots.txt: groups for an agent, and the verdict of the longest pattern."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.urlspec import UrlError, parse


@dataclass(frozen=True)
class Rule:
    pattern: str
    allowed: bool

    @staticmethod
    def of(directive: str, pattern: str) -> Rule:
        """An empty Disallow allows everything."""
        return Rule(pattern, directive == "allow" or pattern == "")


def product_token(agent: str) -> str:
    return agent.split("/", 1)[0].strip().lower()


def groups(text: str) -> list[tuple[list[str], list[Rule]]]:
    """(agents, rules) of a robots.txt, in order."""
    out: list[tuple[list[str], list[Rule]]] = []
    open_ = False
    for line in text.splitlines():
        key, mark, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not mark:
            continue
        if key == "user-agent":
            if not open_:
                out.append(([], []))
            out[-1][0].append(product_token(value))
            open_ = True
        elif key in ("allow", "disallow") and out:
            out[-1][1].append(Rule.of(key, value))
            open_ = False
    return out


def rules_for(found: list[tuple[list[str], list[Rule]]], agent: str) -> list[Rule]:
    """All groups that name the agent, even if they have no rule; else all for any agent."""
    token = product_token(agent)
    named = [g for g in found if token in g[0]]
    return [r for g in named or [g for g in found if "*" in g[0]] for r in g[1]]


def pattern_regex(pattern: str) -> str:
    """A pattern as a regular expression: a star is any run, a last dollar the end, all else itself."""
    end = pattern.endswith("$")
    body = re.sub(r"\*+", "*", pattern[:-1] if end else pattern)
    return r"\A" + ".*".join(re.escape(p) for p in body.split("*")) + (r"\z" if end else "")


def matches(pattern: str, target: str) -> bool:
    end = pattern.endswith("$")
    parts = (pattern[:-1] if end else pattern).split("*")
    if not target.startswith(parts[0]):
        return False
    at = len(parts[0])
    if len(parts) == 1:
        return not end or at == len(target)
    for part in parts[1:-1]:
        found = target.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    if end:
        return len(target) - len(parts[-1]) >= at and target.endswith(parts[-1])
    return target.find(parts[-1], at) >= 0


def target_of(url: str) -> str | None:
    try:
        parsed = parse(url)
    except UrlError:
        return None
    return parsed.path + ("" if parsed.query is None else "?" + parsed.query)


def allows(rules: list[Rule], url: str) -> bool:
    """The longest pattern that matches decides; allowing wins ties, and where nothing matches."""
    target = target_of(url)
    if target is None:
        return True
    longest = {True: -1, False: -1}
    for rule in rules:
        if matches(rule.pattern, target):
            longest[rule.allowed] = max(longest[rule.allowed], len(rule.pattern.encode()))
    return longest[True] >= longest[False]


def verdict(target: Column, rules: Column) -> Column:
    """The same for a path with query, and array<struct<pattern, allowed>>; the engine's regular expressions do the matching."""
    # literal runs quoted, joined by any run
    runs = lambda p: F.transform(F.split(F.regexp_replace(p, r"\$\z", ""), r"\*+"), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E")))
    quoted = lambda p: F.concat(F.lit("^"), F.array_join(runs(p), ".*"), F.when(p.endswith("$"), "$").otherwise(""))
    longest = lambda yes: F.aggregate(F.filter(rules, lambda r: (r["allowed"] == yes) & F.rlike(target, quoted(r["pattern"]))), F.lit(-1), lambda a, r: F.greatest(a, F.octet_length(r["pattern"])))
    return longest(True) >= longest(False)
