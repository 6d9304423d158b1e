"""Grammar inference: probabilistic automata by state merging on a prefix tree.

Strings are read character by character, so that literals of a format stay what
they are. The prefix tree of a labelled sample counts how often each state is
passed, left and ended in. States that are kept (red) are surrounded by
successors that aren't yet (blue); a blue state is folded into the first red one
whose future a Hoeffding bound can't tell from its own, or is kept. Folding may
hang new successors on red states, which are blue again, so no transition is
lost. What remains is a deterministic automaton. A character that a state hasn't
seen shares in the probability of its class there, and goes where its class goes.
Random characters make all states of a stretch alike, so merging can't learn
its length; each automaton keeps the lengths of its sample beside.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from webstrata.llm.license_texts import TEMPLATES

#: Classes that unseen characters share in: hex letters apart from others, so that hexadecimal shows; each mark is its own.
CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "L")}
MEMBERS = {k: sum(v == k for v in CLASSES.values()) for k in set(CLASSES.values())}
#: Probability of a character of a class that no example took: strict for a format, mild for harmless text, which is any mixture.
UNSEEN, MIXED = 1e-8, 0.01
#: How many examples a state's classes count as beside its characters; for harmless text, whose words no sample exhausts, more.
PRIOR, MIXED_PRIOR = 8.0, 60.0


@dataclass
class State:
    passed: int = 0
    ended: int = 0
    next: dict[str, State] = field(default_factory=dict)
    n: dict[str, int] = field(default_factory=dict)


def prefix_tree(sample: Sequence[str]) -> State:
    root = State()
    for text in sample:
        at = root
        at.passed += 1
        for c in text:
            at.n[c] = at.n.get(c, 0) + 1
            at = at.next.setdefault(c, State())
            at.passed += 1
        at.ended += 1
    return root


def differ(a: int, m: int, b: int, n: int, alpha: float) -> bool:
    """Whether the shares a/m and b/n differ by more than the Hoeffding bound allows chance."""
    return abs(a / m - b / n) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(m) + 1 / math.sqrt(n))


def compatible(a: State, b: State, alpha: float) -> bool:
    """Whether two states' futures can't be told apart; walks both subtrees."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x is y or not x.passed or not y.passed:
            continue
        if differ(x.ended, x.passed, y.ended, y.passed, alpha):
            return False
        for c in x.n.keys() | y.n.keys():
            if differ(x.n.get(c, 0), x.passed, y.n.get(c, 0), y.passed, alpha):
                return False
            if c in x.next and c in y.next:
                todo.append((x.next[c], y.next[c]))
    return True


def fold(into: State, tree: State) -> None:
    """Adds a subtree of the prefix tree to a state, and what follows to what follows."""
    todo = [(into, tree)]
    while todo:
        x, y = todo.pop()
        x.passed += y.passed
        x.ended += y.ended
        for c, n in y.n.items():
            x.n[c] = x.n.get(c, 0) + n
            if c not in y.next:
                continue
            if c in x.next:
                todo.append((x.next[c], y.next[c]))
            else:
                x.next[c] = y.next[c]


def infer(sample: Sequence[str], alpha: float = 0.05, unseen: float = UNSEEN, prior: float = PRIOR, lengths: tuple[int, int] | None = None) -> Automaton:
    """The automaton of a labelled sample."""
    red = [prefix_tree(sample)]
    known = {id(red[0])}
    while blue := next(((s, c) for s in red for c in sorted(s.next) if id(s.next[c]) not in known), None):
        state, c = blue
        new = state.next[c]
        for old in red:
            if compatible(old, new, alpha):
                state.next[c] = old
                fold(old, new)
                break
        else:
            red.append(new)
            known.add(id(new))
    number = {id(s): i for i, s in enumerate(red)}
    return Automaton([_Read.of(s, number, unseen, prior) for s in red], lengths or (min(map(len, sample)), max(map(len, sample))))


@dataclass
class _Read:
    """A state of an automaton: logs and successors by character, then by class."""

    logs: dict[str, float]
    goes: dict[str, int]
    class_logs: dict[str, float]
    class_goes: dict[str, int]

    @staticmethod
    def of(state: State, number: dict[int, int], unseen: float, prior: float) -> _Read:
        total, classes, to = sum(state.n.values()), {}, {}
        for c, n in state.n.items():
            k = CLASSES.get(c, c)
            classes[k] = classes.get(k, 0) + n
            to.setdefault(k, []).append((n, c))
        share = {k: prior * n / max(total, 1) / MEMBERS.get(k, 1) for k, n in classes.items()}
        logs = {c: math.log((n + share[CLASSES.get(c, c)]) / (total + prior)) for c, n in state.n.items()}
        low = math.log(unseen)
        class_logs = {k: max(low, math.log(x / (total + prior))) for k, x in share.items()}
        return _Read(logs, {c: number[id(t)] for c, t in state.next.items()}, class_logs, {k: number[id(state.next[max(v)[1]])] for k, v in to.items()})


@dataclass(frozen=True)
class Automaton:
    states: list[_Read]
    lengths: tuple[int, int]

    def log_likelihood(self, text: str, unseen: float = UNSEEN) -> float:
        """Of the text's characters, an unseen one staying in its state at a small probability, and of each character too few or too many."""
        at, total, low = 0, 0.0, math.log(unseen)
        for c in text:
            state = self.states[at]
            p = state.logs.get(c)
            if p is not None:
                total += p
                at = state.goes[c]
                continue
            k = CLASSES.get(c, c)
            p = state.class_logs.get(k)
            if p is None:
                total += low
            else:
                total += p
                at = state.class_goes[k]
        return total + low * max(0, self.lengths[0] - len(text), len(text) - self.lengths[1])


UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Public credential formats, as a sum of parts: a literal, or (alphabet, fewest, most).
FORMATS: dict[str, Sequence[str | tuple[str, int, int]]] = {
    "access_key": ("AKIA", (UPPER + DIGITS, 16, 16)),
    "hex": (("0123456789abcdef", 18, 64),),
    "upper_hex": (("0123456789ABCDEF", 24, 64),),
    "base64": ((UPPER + LOWER + DIGITS + "+/", 30, 64), ("=", 0, 2)),
    "prefixed_token": ("ghp_", (UPPER + LOWER + DIGITS, 36, 36)),
    "live_key": ("sk_live_", (UPPER + LOWER + DIGITS, 24, 24)),
    "bot_token": ("xoxb-", (DIGITS, 11, 12), "-", (DIGITS, 11, 12), "-", (UPPER + LOWER + DIGITS, 24, 24)),
    "api_key": ("AIza", (UPPER + LOWER + DIGITS + "_-", 35, 35)),
    "web_token": ("eyJ", (UPPER + LOWER + DIGITS + "_-", 17, 40), ".eyJ", (UPPER + LOWER + DIGITS + "_-", 30, 60), ".", (UPPER + LOWER + DIGITS + "_-", 43, 43)),
}


def credential(kind: str, rng: random.Random) -> str:
    return "".join(p if isinstance(p, str) else "".join(rng.choice(p[0]) for _ in range(rng.randint(p[1], p[2]))) for p in FORMATS[kind])


#: Words of public wording, so that harmless strings are made of language.
WORDS = sorted({w.lower() for texts in TEMPLATES.values() for t in texts for w in re.findall("[A-Za-z]{2,}", t)})


def harmless(rng: random.Random) -> str:
    """What also is a long run of such characters: words, names, addresses, paths, numbers, dates, versions, identifiers of things."""
    some = lambda a, b: rng.randint(a, b)
    word = lambda: rng.choice(WORDS) if rng.random() < 0.8 else "".join(rng.choice(LOWER) for _ in range(some(2, 12)))
    words = lambda a, b: [word() for _ in range(some(a, b))]
    number = lambda n: "".join(rng.choice(DIGITS) for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    date = lambda mark: mark.join((f"20{number(2)}", f"{some(1, 12):02d}", f"{some(1, 28):02d}"))
    maybe = lambda share, text: text if rng.random() < share else ""
    host = lambda: rng.choice(("www.", "cdn.", "api.", "")) + ".".join(words(1, 2)) + rng.choice((".com", ".org", ".net", ".de"))
    shapes = (
        lambda: "".join(words(2, 5)),
        lambda: rng.choice("-_").join(words(2, 7)) + maybe(0.4, rng.choice("-_") + number(some(1, 7))),
        lambda: host() + "/" + "/".join(word() + maybe(0.4, number(some(1, 6))) for _ in range(some(1, 4))) + rng.choice(("", ".html", "/", ".php")),
        lambda: number(some(10, 24)),
        lambda: "".join(w.capitalize() for w in words(2, 5)) + rng.choice(("", ".", number(2), "." + word())),
        lambda: "_".join(words(2, 4)).upper() + rng.choice(("", ".", "_" + number(2), "=" + word(), "=" + number(some(1, 6)))),
        lambda: date("-") + "T" + number(2) + rng.choice(("", "." + number(3), number(4) + "Z")),
        lambda: rng.choice("+-=_./*") * some(16, 60),
        lambda: word() + "." + ".".join(number(some(1, 3)) for _ in range(3)) + "-" + word(),
        lambda: "/".join(words(2, 6)) + "." + word()[:4] + maybe(0.3, "=" + number(some(1, 6))),
        lambda: "-".join(number(some(2, 5)) for _ in range(some(3, 5))),
        lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12)),
        lambda: "/" + date("/") + "/" + "-".join(words(2, 7)) + maybe(0.5, "-" + number(some(3, 8))),
        lambda: "/v" + number(1) + "".join(f"/{word()}/{number(some(1, 8))}" for _ in range(some(1, 3))) + maybe(0.4, "/" + word()),
        lambda: "_".join((rng.choice(("IMG", "DSC", "VID", "SCAN", "PXL", "Screenshot")) + maybe(0.4, number(5)), rng.choice(("IMG", date(""), word())), date(""), number(some(4, 9)))) + maybe(0.4, rng.choice((".jpg", ".png", ".mp4"))),
        lambda: "/".join(words(1, 4)) + "/" + word() + "." + hexes(some(6, 10)) + rng.choice((".js", ".min.js", ".css", ".map")),
        lambda: "".join(rng.choice(UPPER) for _ in range(some(2, 4))) + "-" + number(some(3, 6)) + "-" + rng.choice("-_").join(words(1, 3)),
        lambda: rng.choice(("com.", "org.")) + ".".join(words(2, 4)) + "." + "".join(w.capitalize() for w in words(1, 3)),
    )
    return rng.choice(shapes)()


def labelled(each: int, seed: int) -> list[tuple[str, str]]:
    """(kind, string) examples: `each` of every credential format, as many times 12 of kind "harmless"."""
    rng = random.Random(seed)
    return [(k, credential(k, rng)) for k in FORMATS for _ in range(each)] + [("harmless", harmless(rng)) for _ in range(12 * each)]


@dataclass(frozen=True)
class Scorer:
    """Automata by kind, and the least score of a credential, in nats a character over the harmless automaton."""

    automata: dict[str, Automaton]
    least: float

    @property
    def shortest(self) -> int:
        """Characters of the shortest example of any format: what is shorter can't be as likely as one."""
        return min(a.lengths[0] for k, a in self.automata.items() if k != "harmless")

    def score(self, text: str) -> tuple[float, str]:
        """The best format's log-likelihood over harmless text's, per character, and that format."""
        base = self.automata["harmless"].log_likelihood(text, MIXED)
        best = max((a.log_likelihood(text), k) for k, a in self.automata.items() if k != "harmless")
        return (best[0] - base) / max(len(text), 1), best[1]


def fit(examples: Sequence[tuple[str, str]], check: Sequence[tuple[str, str]], most_false: float = 0.001, parts: Callable[[str], Sequence[str]] = lambda text: [text]) -> Scorer:
    """Automata from labelled examples; the threshold lets at most that share of the second set's harmless strings pass, with any of their parts."""
    kinds: dict[str, list[str]] = {}
    for kind, text in examples:
        kinds.setdefault(kind, []).append(text)
    # harmless text may have any length
    scorer = Scorer({k: infer(v, unseen=MIXED, prior=MIXED_PRIOR, lengths=(0, 1 << 62)) if k == "harmless" else infer(v) for k, v in kinds.items()}, 0.0)
    scores = sorted(max((scorer.score(x)[0] for x in parts(t) if len(x) >= scorer.shortest), default=-math.inf) for k, t in check if k == "harmless")
    return Scorer(scorer.automata, max(0.05, scores[min(len(scores) - 1, math.ceil(len(scores) * (1 - most_false)))] + 0.02))
