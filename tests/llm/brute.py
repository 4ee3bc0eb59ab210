"""Plain Python forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)


def word_shingles(text: str | None, size: int = 5) -> Counter:
    words = WORD.findall(text or "")
    if 0 < len(words) < size:
        return Counter([tuple(words)])
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def char_shingles(line: str, size: int) -> Counter:
    return Counter({line[i:i + size]: 1 for i in range(max(1, len(line) - size + 1))})


def alike(a: Counter, b: Counter, threshold: float) -> bool:
    both = len(a.keys() & b.keys())
    if both >= threshold * (len(a) + len(b) - both):
        return True
    more = (a & b).total()
    return more >= threshold * (a.total() + b.total() - more)


def classes(sets: list[Counter], threshold: float = 0.8) -> list[int]:
    """The class of each set; empty sets are alone."""
    union, holders = Union(len(sets)), defaultdict(list)
    for i, items in enumerate(sets):
        near = {j for x in items for j in holders[x]}
        for j in near:
            if union.find(i) != union.find(j) and alike(items, sets[j], threshold):
                union.join(i, j)
        for x in items:
            holders[x].append(i)
    return [union.find(i) for i in range(len(sets))]


def lines(text: str | None, least: int) -> list[tuple[int, str]]:
    return [(i, x) for i, x in enumerate((text or "").split("\n")) if len(WORD.findall(x)) >= least]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal_spans(text: str) -> list[tuple[str, int, int]]:
    def digits(x):
        return re.sub("[^0-9]", "", x)

    out = [("email", m.start(), m.end()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(digits(m[0])) <= 15]
    return out


def base_counts(text: str) -> dict[str, int]:
    words = WORD.findall(text)
    kept = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(kept) - len(set(kept)),
            "n_repeat_words": len(covered)}


def weak_votes(text: str) -> str:
    """Votes of the eight labellers on one text: g, b or -."""
    data = text.encode()
    words = [w.encode() for w in WORD.findall(text)]
    n = max(len(words), 1)
    upper, lower = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
    capitals, symbols = upper / max(upper + lower, 1), sum(c in b"#*$%&|<>" for c in data) / n
    shouts = sum(w.endswith(b"!!") for w in words) / n
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    stops, size = sum(w.endswith(b".") for w in words) / n, sum(map(len, words)) / n
    fragments = sum(len(w) == 1 and not w.isalpha() for w in words) / n
    some, long = len(words) > 0, len(words) >= 30

    def vote(bad, good):
        return "b" if bad else "g" if good else "-"

    return "".join([
        vote(capitals > 0.5, some and capitals < 0.25), vote(symbols > 0.2, some and symbols < 0.05),
        vote(shouts > 0.1, some and shouts < 0.02), vote(repeats > 0.2, long and repeats < 0.05),
        vote(len(words) < 3, len(words) >= 20), vote(long and stops == 0, long and 0.01 < stops < 0.3),
        vote(some and (size < 2 or size > 15), some and 3 <= size <= 9),
        vote(fragments > 0.15, some and fragments < 0.05)])


def weak_posteriors(voted: list[str], rounds: int = 300) -> dict[str, float]:
    """Posterior of being good per vote pattern: good, or bad in the way of one labeller."""
    counts, m = Counter(voted), len(voted[0])
    member = {v: [0.1 if "b" in v else 1.0, *[float(c == "b") for c in v]] for v in counts}
    member = {v: [x / sum(w) for x in w] for v, w in member.items()}
    for _ in range(rounds):
        share = [(sum(member[v][k] * n for v, n in counts.items()) + 1) / (len(voted) + m + 1) for k in range(m + 1)]
        table = [[{c: 1.0 + sum(member[v][k] * n for v, n in counts.items() if v[j] == c) for c in "bg"}
                  for j in range(m)] for k in range(m + 1)]
        new = {}
        for v in counts:
            worth = []
            for k in range(m + 1):
                p = share[k]
                for j, c in enumerate(v):
                    if c != "-":
                        p *= table[k][j][c] / sum(table[k][j].values())
                worth.append(p)
            new[v] = [x / sum(worth) for x in worth]
        moved = max(abs(a - b) for v in counts for a, b in zip(new[v], member[v]))
        if moved < 1e-9:
            break
        member = new
    return {v: w[0] for v, w in member.items()}


def weak_scores(texts: list[str], targets: list[float], epochs: int = 150, rate: float = 0.5, shrink: float = 1e-5) -> list[float]:
    """Logistic scores of texts fitted to soft labels by Adagrad, features told apart by name, not by hash."""
    rows = []
    for text in texts:
        words = [w.encode() for w in WORD.findall(text)]
        found = Counter()
        for i, w in enumerate(words):
            found[w] += 1
            found["end", w[-1], w[-2] if len(w) > 1 else 0] += 1
            found["head", 65 <= w[0] <= 90, len(w) > 1 and 65 <= w[1] <= 90] += 1
            found["again", i > 0 and w == words[i - 1]] += 1
        norm = sum(found.values()) ** 0.5
        rows.append({f: n ** 0.5 / norm for f, n in found.items()})
    good = sum(t > 0.5 for t in targets)
    balance = [0.5 / max(good, 1) if t > 0.5 else 0.5 / max(len(targets) - good, 1) for t in targets]
    weights, seen, bias, bias_seen = defaultdict(float), defaultdict(lambda: 1e-8), 0.0, 1e-8
    sigmoid = lambda x: 1 / (1 + math.exp(-min(max(x, -30), 30)))
    for _ in range(epochs):
        errors = [(sigmoid(sum(weights[f] * v for f, v in r.items()) + bias) - t) * b
                  for r, t, b in zip(rows, targets, balance)]
        slope = defaultdict(float)
        for r, e in zip(rows, errors):
            for f, v in r.items():
                slope[f] += e * v
        for f in list(slope):
            g = slope[f] + shrink * weights[f]
            seen[f] += g * g
            weights[f] -= rate * g / seen[f] ** 0.5
        bias_seen += sum(errors) ** 2
        bias -= rate * sum(errors) / bias_seen ** 0.5
    return [sigmoid(sum(weights[f] * v for f, v in r.items()) + bias) for r in rows]
