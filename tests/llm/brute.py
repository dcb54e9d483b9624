"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def near_duplicates(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t))
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        sets[i] = s
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i in sorted(sets):
        shared = Counter()
        for g in sets[i]:
            for j in index.get(g, ()):
                shared[j] += 1
            index.setdefault(g, []).append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def repeats(docs, length=50):
    items = [(i if i is not None else -(2**63), (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in items:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if i < first.get(w, 2**63):
                first[w] = i
    out = []
    for i, b in items:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((None if i == -(2**63) else i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def best_fit(lengths, window):
    """Free room of each window after best-fit decreasing, by search through all windows."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


def pitman_yor(docs, n):
    """Scores of a two-level Pitman-Yor model by dictionaries; only the draws of tables are shared."""
    import math
    import zlib

    import numpy as np
    import pyarrow as pa

    from textloom.llm import common, pitmanyor, seating

    texts = {i: [*WORD.findall(lower(t)), None] for i, t in docs}
    vocabulary = sorted({w for x in texts.values() for w in x if w is not None})
    code = dict(zip(vocabulary, common.hash_array(pa.array(vocabulary, pa.string())).tolist(), strict=True)) | {None: int(pitmanyor.END), "": int(pitmanyor.START)}
    train = [x for i, x in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    pairs = Counter(p for x in train for p in zip(["", *x[:-1]], x, strict=True))
    seen = pairs.keys() | {p for x in texts.values() for p in zip(["", *x[:-1]], x, strict=True)}
    words, customers = Counter(w for x in train for w in x), Counter()
    for (u, _), c in pairs.items():
        customers[u] += c

    def place(h):
        return ((h >> 32) * n) >> 32

    listed = list(seen)
    hashes = pitmanyor.pair_hash(*(np.array([code[p[k]] for p in listed], np.uint64) for k in (0, 1)))
    hashed = dict(zip(listed, hashes.tolist(), strict=True)).__getitem__

    def numbered(items):
        """Key of each (hash, item): bucket and number in it."""
        out, used = {}, Counter()
        for h, item in sorted(items):
            out[item] = (place(h) << 40) + used[place(h)]
            used[place(h)] += 1
        return out

    word_keys = numbered([(h, w) for w, h in code.items()])
    many = sorted((p for p in seen if pairs[p] > 1), key=hashed)
    pair_keys = numbered([(hashed(p), p) for p in many])
    once, twice = sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values())
    d = pitmanyor.discount_of(once, twice)
    model = pitmanyor.Model(sum(words.values()), len(words), d)
    tables, states, strength = dict.fromkeys(pairs, 1), [], 8.0

    def add_up(sweep):
        context, dish = Counter(), Counter()
        for (u, w), t in tables.items():
            context[u] += t
            dish[w] += t
        parent = dict.fromkeys(dish, 1)
        if sweep:
            _, all_tables, s0, _ = model.at[-1]
            lead, slope = (s0 + model.base_discount * (all_tables - 1)) * model.base, model.base_discount * model.base
            key = common.mix(np.array([word_keys[w] for w in dish], np.uint64) + pitmanyor.SILVER)
            drawn = seating.seat(np.array(list(dish.values())), np.full(len(dish), lead), np.full(len(dish), slope), model.base_discount, key, sweep)
            parent = dict(zip(dish, drawn.tolist(), strict=True))
        else:
            model.base_discount = pitmanyor.discount_of(sum(x == 1 for x in dish.values()), sum(x == 2 for x in dish.values()))
        total, all_tables = sum(dish.values()), sum(parent.values())
        s0 = model.draw_strength(model.parent_likelihoods(total, all_tables), 2 * sweep)
        model.at.append((total, all_tables, s0, strength))
        states.append((context, dish, parent))

    def chance(w, state, away=0):
        """Of a word in the parent; ``away`` of its customers have left."""
        _, dish, parent = states[state]
        total, all_tables, s0, _ = model.at[state]
        left = dish[w] - away
        return (max(left - model.base_discount * min(parent.get(w, 0), left), 0) + (s0 + model.base_discount * all_tables) / (len(words) + 1)) / (s0 + total - away)

    add_up(0)
    for sweep in range(pitmanyor.SWEEPS):
        context = states[-1][0]
        likely = pitmanyor.strength_likelihoods(np.array([context[u] for u in customers]), np.array(list(customers.values())), d)
        own, q = [tables[p] for p in many], [chance(p[1], sweep, tables[p] - 1) for p in many]
        lead = [(strength + d * (context[p[0]] - t)) * x for p, t, x in zip(many, own, q, strict=True)]
        key = common.mix(np.array([pair_keys[p] for p in many], np.uint64))
        drawn = seating.seat(np.array([pairs[p] for p in many]), np.array(lead), d * np.array(q), d, key, sweep + 1, np.array(own) if sweep else None)
        before, tables = tables, tables | dict(zip(many, drawn.tolist(), strict=True))
        strength = model.draw_strength(likely, 2 * sweep + 1)
        add_up(sweep + 1)
    out = {}
    for i, x in texts.items():
        total = 0.0
        for u, w in zip(["", *x[:-1]], x, strict=True):
            p = 0.0
            for k, held in enumerate((before, tables)):
                at = pitmanyor.SWEEPS - 1 + k
                s, c = model.at[at][3], pairs[(u, w)]
                p += (max(c - d * held.get((u, w), 0), 0) + (s + d * states[at][0][u]) * chance(w, at)) / (s + customers[u]) / 2
            total += math.log10(p)
        out[i] = total
    return out
