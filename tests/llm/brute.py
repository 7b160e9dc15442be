"""Plain, slow versions of the operators, for comparison."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similar(a, b, percent=75):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= percent * (len(a) + len(b) - both)


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def jaccard(rows):
    """doc_id -> (n_shingles, component); rows without id left out."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    pairs = {(min(a, b), max(a, b)) for ids in by.values() for a in ids for b in ids if a < b}
    found = components([p for p in pairs if similar(sets[p[0]], sets[p[1]])], sets)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def edited(rows):
    """(doc_id, n_chars, edited text, next text) by ascending id, null ids first, ties by text."""
    order = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in rows), key=lambda x: x[:2])
    out = []
    for k, (_, t, i) in enumerate(order):
        u = order[(k + 1) % len(order)][1]
        out.append((i, len(t), t[: len(t) - len(t) // 2] + u[: len(t) // 2], u))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    n = Counter(x[3] for x in found)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest(), joined


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def gone_lines(rows, lines=3, least=50):
    """doc_id -> sorted deleted lines."""
    first, later = {}, defaultdict(set)
    seen = []
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        x = t.split("\n")
        for p in range(len(x)):
            for size in range(1, lines + 1):
                part = tuple(x[p : p + size])
                n = sum(len(words(y)) for y in part)
                if len(part) == size and n >= (1 if size == lines else least):
                    seen.append((i, p, size, part))
    for i, p, size, part in sorted(seen):
        if part in first and first[part] < (i, p):
            later[i].update(range(p, p + size))
        first.setdefault(part, (i, p))
    return {i: sorted(x) for i, x in later.items()}


def mixed(rows, plan, domain_of):
    """Counter of (doc_id, domain, lang, source, n_tokens, epoch); rows: (doc_id, text, lang, source)."""
    leaves = defaultdict(list)
    for i, t, lang, source in rows:
        leaves[(domain_of(source), lang or "unknown", source or "unknown")].append((i, len(words(t))))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}

    def share(budget, prefix, depth):
        """Budgets of the leaves below prefix."""
        if depth == 3:
            return {prefix: budget}
        children = sorted({k[: depth + 1] for k in leaves if k[:depth] == prefix})
        cap = {c: float(sum(s for k, s in supply.items() if k[: depth + 1] == c) * plan.epochs) for c in children}
        w = {c: float(plan.weights.get(("domain", "lang", "source")[depth], {}).get(c[-1], 1)) for c in children}
        given, open_, left = {}, set(children), budget
        while open_:
            rate = left / sum(w[c] for c in open_)
            full = {c for c in open_ if cap[c] <= w[c] * rate}
            if not full:
                given |= {c: w[c] * rate for c in open_}
                break
            for c in full:
                given[c] = cap[c]
                left -= cap[c]
            open_ -= full
        return {k: b for c in children for k, b in share(given[c], c, depth + 1).items()}

    total = sum(supply.values())
    budget = share(min(float(int(total * plan.fraction)), float(total * plan.epochs)), (), 0) if leaves else {}
    out = Counter()
    for k, items in leaves.items():
        left, epoch = int(budget[k] + 1e-6), 1
        while epoch <= plan.epochs:
            key = lambda x, e=epoch: (hashlib.sha256(f"{plan.seed}:{e}:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, x[1])
            fits = True
            for i, n in sorted(items, key=key):
                if n > left:
                    fits = False
                    break
                left -= n
                out[(i, *k, n, epoch)] += 1
            if not fits or supply[k] == 0:
                break
            epoch += 1
    return out


def one_edit(word, letters):
    """All strings that differ from word by one inserted, deleted or replaced letter."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for c in letters for k in (0, 1) if i + k <= len(word)}
    return out - {word}


def variants(rows):
    """Rows (word, form, root, n, n_near, form_n); rows: (doc_id, text)."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = {c for w in n for c in w}
    form, near = {}, {}
    for w, k in n.items():
        others = [x for x in one_edit(w, letters) if x in n]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * k:
            form[w] = best
    out = set()
    for w in n:
        r = w
        while r in form:
            r = form[r]
        out.add((w, form.get(w), r, n[w], near[w], n[form[w]] if w in form else None))
    return out


def trie(rows):
    """Rows of the trie of rebuilt conversations; rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = (own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        saved[p] += (len(members[p]) - 1) * len(words(p[-1][1])) if p else 0
        leaves[p] += not children[p]
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return {(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha([c for c in m if len(full[c]) == len(p)])) for p, m in members.items()}
