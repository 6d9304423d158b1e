"""URL filters: host-and-path rules first, then association rules mined by FP-growth from the URLs that those rules label.

A URL is a set of tokens: host suffixes, its first host label, path segments by
place, query keys. FP-growth mines token combinations that go along
with the class of blocked URLs; rules with enough confidence, support and lift
are kept, without those that a shorter one implies. They are matched through an
inverted index from token to rules, inside the scan: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains, for paths that start with its path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query applies.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


@dataclass(frozen=True)
class Mined:
    tokens: tuple[str, ...]
    confidence: float
    support: float


#: Least share of the labelled URLs that a mined rule covers, least share of those that are blocked, least gain over the labelled URLs' own share;
#: most tokens of a rule. Support bounds the number of rules, and so the index.
SUPPORT, CONFIDENCE, LIFT, TOKENS = 0.002, 0.9, 1.2, 3
#: How much a longer rule's confidence has to gain on that of a part of it.
GAIN = 0.02
#: Longest word of a path segment or query key that is a token as it is; a longer one is named by its hash.
LONGEST = 40
BLOCKED = "class=block"


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty without one."""
    before = F.substring_index(url, "://", 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, url.substr(F.length(before) + 4, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(after_scheme(url), r"\A[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tail_of(url: Column) -> Column:
    """What follows the host; empty without "://"."""
    return F.regexp_replace(after_scheme(url), r"\A[^/?#]*", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(tail_of(url), r"\A[^?#]*", 0)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def first_fit(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """value(rule) of the longest rule that fits, else null; of two with one text the first listed."""
    out = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The URL's distinct tokens."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    named = lambda s: F.when(F.length(s) <= LONGEST, s).otherwise(F.concat(F.lit("sha256:"), F.sha2(s, 256)))
    word = lambda s: named(F.regexp_replace(s, r"[0-9]+", "#"))
    query = F.split(F.regexp_extract(tail_of(url), r"\?([^#]*)", 1), "&")
    return F.array_distinct(
        F.concat(
            F.when(n > 0, suffixes).otherwise(F.array().cast("array<string>")),
            F.transform(F.slice(labels, 1, 1), lambda x: F.concat(F.lit("first="), x)),
            F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), word(s))),
            F.transform(F.filter(F.transform(query, lambda p: F.substring_index(p, "=", 1)), lambda k: k != ""), lambda k: F.concat(F.lit("key="), named(k))),
        )
    )


def mine(labelled: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, tokens: int = TOKENS) -> list[Mined]:
    """Rules `tokens -> blocked` from `tokens` (array) and `blocked` (boolean) of labelled URLs; rows whose `blocked` is null have no label and don't count.

    A rule goes if a shorter part of it is kept whose confidence it doesn't exceed by more than GAIN. So tokens that are rules by themselves with
    a confidence of 1 - GAIN leave before FP-growth, as no set with them can stay, and so do tokens too rare to be in a rule; what
    remains of long URLs are the tokens that only together tell something.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where("blocked is not null").select(F.array_distinct("tokens").alias("tokens"), "blocked")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")).first()
    if not counts.blocked:
        return []
    fewest, base = support * counts.n, counts.blocked / counts.n
    singles = rows.select(F.explode("tokens").alias("token"), "blocked").groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("hits"))
    # a URL's tokens over the support, at most
    frequent = singles.where(F.col("hits") >= fewest).collect()
    strong = {r.token: Mined((r.token,), r.hits / r.n, r.hits / counts.n) for r in frequent if r.hits >= max(confidence, 1 - GAIN) * r.n and r.hits >= lift * base * r.n}
    # a token of all URLs changes no cover
    open_ = sorted(r.token for r in frequent if r.token not in strong and r.n < counts.n)
    kept: dict[tuple[str, ...], Mined] = {m.tokens: m for m in strong.values()}
    if open_:
        items = rows.select(F.array_intersect("tokens", F.lit(open_)).alias("tokens"), "blocked").select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
        found = model.associationRules.where(F.col("consequent")[0] == BLOCKED).where((F.size("antecedent") <= tokens) & (F.col("lift") >= lift))
        # support bounds the frequent sets: they are at most 1 / support times the sets of a URL's tokens
        mined = found.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support").collect()
        for row in sorted(mined, key=lambda r: (len(r.antecedent), -r.confidence, -r.support, r.antecedent)):
            own = tuple(row.antecedent)
            shorter = (kept.get(part) for n in range(1, len(own)) for part in combinations(own, n))
            if not any(m is not None and m.confidence >= row.confidence - GAIN for m in shorter):
                kept[own] = Mined(own, row.confidence, row.support)
    return sorted(kept.values(), key=lambda m: (-m.confidence, -m.support, m.tokens))


def matched(tokens: Column, rules: Sequence[Mined]) -> Column:
    """The number of the first rule all of whose tokens are there, through an inverted index; null if none is."""
    if not rules:
        return F.lit(None).cast("int")
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for t in rule.tokens:
            index.setdefault(t, []).append(i)
    posts = F.create_map(*(F.lit(x) for pair in index.items() for x in pair))
    need = F.lit([len(r.tokens) for r in rules])
    hits = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(posts, t), F.array().cast("array<int>"))))
    return F.array_min(F.filter(F.array_distinct(hits), lambda r: F.size(F.filter(hits, lambda x: x == r)) == F.element_at(need, r + 1)))


def url_filter(pages: DataFrame, *, rules: Sequence[Rule] = RULES, mined: Sequence[Mined] | None = None) -> DataFrame:
    """Judges every URL.

    Takes `page_id` and `url`, ignores other columns. Returns page_id, host, path, rule (the text of the longest rule that fits,
    else null), verdict (its, else block if a mined rule matches, else allow) and mined (that mined rule's tokens, else null).
    Defined for odd inputs: a null url, or one without "://", has an empty host and path and is allowed unless a mined rule
    matches; repeated rows are judged one by one; page_id may be null. Only URLs that a rule fits are mined; where none or all of them are blocked, nothing is. An empty table gives an empty one.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url")
    host, path = F.col("host"), F.col("path")
    rows = rows.select("page_id", "host", "path", first_fit(rules, host, path, lambda r: r.text).alias("rule"), first_fit(rules, host, path, lambda r: r.verdict).alias("given"), F.coalesce(tokens_of(F.col("url"), host, path), F.array().cast("array<string>")).alias("tokens"))
    if mined is None:
        mined = mine(rows.select("tokens", (F.col("given") == "block").alias("blocked")))
    number = matched(F.col("tokens"), mined)
    names = F.lit([" ".join(m.tokens) for m in mined]) if mined else None
    rows = rows.withColumn("number", number)
    return rows.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("given", F.when(F.col("number").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        (F.when(F.col("number").isNotNull(), F.element_at(names, F.col("number") + 1)) if names is not None else F.lit(None).cast("string")).alias("mined"),
    )
