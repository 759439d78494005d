"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def shingles(text: str | None, width: int = 5) -> set:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """Smallest doc_id reachable over links of 75 hundredths, all pairs compared by way of shared shingles."""
    sets = {i: shingles(t) for i, t in docs}
    having: dict = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        common = Counter(j for x in s for j in having[x] if j > i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def base_scores(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, float]]:
    """n_tokens, n_known, train_tokens and base_score of each document."""
    end = object()
    tokens = {i: [*words(t), end] for i, t in docs}
    counts = Counter(x for i, own in tokens.items() if fold(i, 10) for x in own)
    n, v = sum(counts.values()), len(counts)
    score = lambda x: math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1)))
    return {i: (len(own), sum(counts[x] > 0 for x in own), n, sum(map(score, own))) for i, own in tokens.items()}


def interpolated_scores(docs: list[tuple[int, str | None]]) -> dict[int, float]:
    """log10 probability of each text by deleted interpolation: counts of folds 2 to 9, mixture by EM on fold 1, then counts of folds 1 to 9."""
    end, begin = "\nend", "\nbegin"
    tokens = {i: [*words(t), end] for i, t in docs}
    level = lambda n: min(15, n.bit_length())

    def model(folds: range):
        one, two = Counter(), Counter()
        for i, own in tokens.items():
            if min(fold(i, 10), 2) in folds:
                one.update(own)
                two.update(zip([begin, *own], own, strict=False))
        n, types = sum(one.values()), len(one)
        context = lambda x: one[end if x == begin else x]
        parts = lambda x, y: (1 / (types + 1), one[y] / max(n, 1), two[x, y] / context(x) if context(x) else 0.0)
        return lambda own: [(level(context(x)), parts(x, y)) for x, y in zip([begin, *own], own, strict=False)]

    cells = defaultdict(list)
    kept = model(range(2, 3))
    for i, own in tokens.items():
        if fold(i, 10) == 1:
            for at, p in kept(own):
                cells[at].append(p)
    weights = {at: [1 / 3] * 3 for at in range(16)}
    for at, held in cells.items():
        for _ in range(100):
            gained = [0.01] * 3
            for p in held:
                total = sum(w * x for w, x in zip(weights[at], p, strict=True))
                for k in range(3):
                    gained[k] += weights[at][k] * p[k] / total
            weights[at] = [g / sum(gained) for g in gained]
    final = model(range(1, 3))
    return {i: sum(math.log10(sum(w * x for w, x in zip(weights[at], p, strict=True))) for at, p in final(own)) for i, own in tokens.items()}


def without_lines(docs: list[tuple[int, str | None]], least: int = 10) -> dict[int, tuple[int, int, str]]:
    """n_lines, n_dropped and the kept text of each document."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    lines = {i: (t or "").split("\n") for i, t in docs}
    n = Counter(k for own in lines.values() for k in {key(x) for x in own})
    out = {}
    for i, own in lines.items():
        kept = [x for x in own if not (key(x) and n[key(x)] >= least)]
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}'’]*|\p{N}+(?:[.,]\p{N}+)*")


def templates(text: str | None, units: set) -> tuple[list, list, list]:
    """Lower-cased values, plain template and template with names of a text."""
    raw = TOKEN.findall(text or "")
    number = [bool(regex.match(r"\p{N}", x)) for x in raw]
    plain = ["#" if n else "%" if i and number[i - 1] and x.lower() in units else x.lower() for i, (x, n) in enumerate(zip(raw, number, strict=True))]
    named = ["@" if regex.match(r"\p{Lu}", x) and p != "%" else p for x, p in zip(raw, plain, strict=True)]
    return [x.lower() for x in raw], plain, named


def leaks(docs: list, items: list, units: set, window: int = 8, least: int = 4, coverage: float = 0.5) -> dict:
    """Kind of every pair of a document and an item, all windows of all pairs compared."""
    found: dict = {}
    for doc_id, text in docs:
        doc = templates(text, units)
        for item_id, item_text in items:
            item = templates(item_text, units)
            width = min(window, len(item[0]))
            for form in (1, 2) if width else ():
                need = min(least, max(1, width // 2))
                first: dict = {}
                starts = set()
                for i in range(len(item[0]) - width + 1):
                    w = tuple(item[form][i : i + width])
                    if sum(x not in "#%@" for x in w) < need:
                        starts.add(i)
                    elif w not in first:
                        first[w] = i
                        starts.add(i)
                cover = lambda at: len({i + j for i in at for j in range(width)})
                shifts = defaultdict(set)
                for i in range(len(doc[0]) - width + 1):
                    at = first.get(tuple(doc[form][i : i + width]))
                    if at is not None:
                        shifts[i - at].add(at)
                good, same = set(), set()
                for shift, at in shifts.items():
                    places = {i + j for i in at for j in range(width)}
                    slots = {(item[0][i], doc[0][i + shift]) for i in places if item[2][i] in ("#", "%", "@")}
                    if len({a for a, _ in slots}) == len(slots):
                        good |= at
                        same |= at if all(a == b for a, b in slots) else set()
                if good and cover(good) >= coverage * cover(starts):
                    kind = "exact" if cover(same) >= coverage * cover(starts) else "reparameterised"
                    found[doc_id, item_id] = min(kind, found.get((doc_id, item_id), kind))
    return found


def language_scores(texts: list, labelled: list, bits: int, alpha: float = 0.5) -> list[dict]:
    """Posterior of each language for each text, by counting n-grams one by one."""

    def grams(text: str) -> list[int]:
        low, kept = text.lower(), []
        for i, c in enumerate(low):
            if c.isalpha():
                kept.append(ord(c))
            elif i and low[i - 1].isalpha():
                kept.append(32)
        signs = [32] * 3 + kept + [32] * 3
        out = []
        for n in (1, 2, 3):
            for i in range(len(signs) - 3):
                g = 0
                for j in range(n):
                    g = (g * 0x01000193 + signs[i + j] + j + 1) & 0xFFFFFFFF
                g = ((g ^ (g >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                out.append((((g ^ (g >> 12)) * 0x297A2D39) & 0xFFFFFFFF) >> (32 - bits))
        return out

    counts: dict = {}
    n_docs = Counter(lang for lang, _ in labelled)
    for lang, text in labelled:
        counts.setdefault(lang, Counter()).update(grams(text))
    out = []
    for text in texts:
        logs = {}
        for lang, own in counts.items():
            total = sum(own.values()) + alpha * (1 << bits)
            logs[lang] = math.log(n_docs[lang] / len(labelled)) + sum(math.log((own[g] + alpha) / total) for g in grams(text))
        top = max(logs.values())
        whole = sum(math.exp(v - top) for v in logs.values())
        out.append({k: math.exp(v - top) / whole for k, v in logs.items()})
    return out
