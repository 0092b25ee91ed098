"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^ \t-\r]+")
SPACE = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def exact(rows):
    """[(doc_id, keep_id, group_size, kept, sha)] from (doc_id, text)."""
    groups = defaultdict(list)
    for d, t in rows:
        t = t or ""
        groups["".join(c for c in t if c not in SPACE)].append((-len(t), math.inf if d is None else d))
    out = []
    for d, t in rows:
        key = "".join(c for c in t or "" if c not in SPACE)
        size, keep = min(groups[key])
        keep = None if keep == math.inf else keep
        out.append((d, keep, len(groups[key]), d == keep and len(t or "") == -size, sha(key.encode())))
    return out


def shingles(t, n):
    w = WORD.findall(lower(t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def jaccard(rows, n, num, den):
    """[(doc_id, n_shingles, component_id, n_links)]."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), d if not sets[i] else min(least[find(i)], default=None), links[i]) for i, (d, _) in enumerate(rows)]


def lines(rows, min_docs, min_chars):
    """[(doc_id, n_lines, n_dropped, sha of what stays)]."""
    key = lambda x: lower(x.strip(SPACE))
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= min_chars and n[key(x)] >= min_docs)]
        out.append((d, len(own), len(own) - len(kept), sha("\n".join(kept).encode())))
    return out


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    own = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own), len(own) - len(set(own)), len(covered)


def quality(rows, rules, error, min_group, min_positive=20):
    """[(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)] from (doc_id, text, lang, source)."""
    stats = [counts(t) for _, t, *_ in rows]
    failed = [s[0] < 10 or 100 * s[5] > 20 * s[0] for s in stats]
    value = [{"symbols_per_word": (s[2] + 1) / (s[0] + 20), "chars_per_word": s[1] / max(1, s[0]), "repeated_lines": s[4] / max(1, s[3])} for s in stats]
    gamma = math.log((1 + error) / (1 - error))

    def quantile(xs, percent):
        if not xs:
            return None
        x = sorted(xs)[-(-percent * len(xs) // 100) - 1]
        return 2 * math.exp(math.ceil(math.log(x) / gamma) * gamma) / (math.exp(gamma) + 1) if x > 0 else 0.0

    def limits(members):
        out = {}
        for m, (kind, lower, upper, reach, floor, _) in rules.items():
            xs = [value[i][m] for i in members]
            if kind == "range":
                a, b = quantile(xs, lower), quantile(xs, upper)
                room = max(reach * (b - a), floor)
                out[m] = (a - room, b + room)
            else:
                xs = [x for x in xs if x > 0] if kind == "positive" else xs
                known = xs and (kind != "positive" or len(xs) >= min_positive)
                out[m] = (-math.inf, max(reach * quantile(xs, upper), floor) if known else None)
        return out

    def within(members, outer):
        if len(members) < min_group:
            return outer
        out = {}
        for m, (low, high) in limits(members).items():
            o_low, o_high = outer[m]
            if high is None:
                out[m] = outer[m]
            else:
                cap = rules[m][5]
                out[m] = (max(low, o_low / cap) if rules[m][0] == "range" else low, high if o_high is None else min(high, o_high * cap))
        return out

    good = [i for i in range(len(rows)) if not failed[i]]
    out, known_limits = [], {}
    for i, (d, _, lang, source) in enumerate(rows):
        kept = not failed[i]
        if kept:
            key = (lang, source)
            if key not in known_limits:
                by_lang = within([j for j in good if rows[j][2] == lang], limits(good))
                known_limits[key] = within([j for j in good if rows[j][2:4] == key], by_lang)
            kept = all(lo <= value[i][m] and (hi is None or value[i][m] <= hi) for m, (lo, hi) in known_limits[key].items())
        s = stats[i]
        out.append((d, s[0], s[1], s[2], s[4], s[5], failed[i], kept))
    return out


def mix_targets(sizes, cap=3):
    """{source: target} by sharing the excess again and again; sources in order, None last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


def crc(t):
    return zlib.crc32((t or "").encode())
