"""Plain, slow versions of the operators, for comparison."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


@lru_cache(2)
def tokenizer(name: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def bpe(doc_id, text):
    t = tokenizer("byte_bpe_50k.json")
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def id_file(rows):
    t, out, start = tokenizer("word_bpe_49k.json"), [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def site(url):
    """(host, path, rule, verdict) by the site rules alone."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = rest[:k].translate(A_TO_Z), rest[k:]
        path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def words(text):
    return WORD.findall(text or "")


def base_scores(rows):
    """{row number: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [[w.translate(A_TO_Z) for w in words(t)] + [None] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, _), ws in zip(rows, tokens, strict=True)]


def shingles(text, n=5):
    ws = [w.translate(A_TO_Z) for w in words(text)]
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1)))


def components(links, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def near_duplicates(rows, percent=85):
    """{doc_id: (set size, component)} over rows with a doc_id."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    has = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            has[x].append(i)
    links = set()
    for i, s in sets.items():
        common = Counter(j for x in s for j in has[x] if j > i)
        links |= {(i, j) for j, c in common.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)}
    part = components(links, sets)
    return {i: (len(s), part[i]) for i, s in sets.items()}


def quality(doc_id, text):
    ws = words(text)
    lines, seen, dup = [x for x in (text or "").split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    count = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    repeat = {i + k for i, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if count[g] > 1 for k in range(3)}
    failed = len(ws) < 50 or 100 * len(repeat) > 50 * len(ws)
    return doc_id, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat), failed


def alnum_tokens(text):
    return [x.translate(A_TO_Z) for x in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text or "")]


def tiling(doc, item, n):
    """Greedy string tiles by the definition: again and again the longest unmarked match, of equal ones the first in the text, then in the item."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (n - 1, 0, 0)
        run = [0] * (len(item) + 1)
        for i in range(len(doc) - 1, -1, -1):
            now = [0] * (len(item) + 1)
            for j in range(len(item) - 1, -1, -1):
                if free_doc[i] and free_item[j] and doc[i] == item[j]:
                    now[j] = run[j + 1] + 1
                    if (now[j], -i, -j) > (best[0], -best[1], -best[2]) and now[j] >= n:
                        best = (now[j], i, j)
            run = now
        if best[0] < n:
            return out
        out.append((best[1], best[2], best[0]))
        for k in range(best[0]):
            free_doc[best[1] + k] = free_item[best[2] + k] = False


def phrase_count(symbols, sample, segment):
    """Greedy longest matches: how many phrases of `sample` the string needs, in segments; a symbol that isn't in it is a phrase."""
    n = 0
    for k in range(0, len(symbols), segment):
        piece, at = symbols[k : k + segment], 0
        while at < len(piece):
            end = at + 1
            while end < len(piece) and piece[at : end + 1] in sample and piece[at:end] in sample:
                end += 1
            n, at = n + 1, end
    return n


def letters(text, known=None):
    """Lower-cased letters, and one space for each run of anything else; letters outside `known` become \0."""
    out = []
    for c in text:
        if c.isalpha():
            low = c.lower()
            low = low if known is None or low in known else low[0]
            out.append(low if known is None or low in known else "\0")
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def language(text, sample, segment):
    """(language, score, rate) by cross-parsing, from (language, text) rows of the sample."""
    if not any(c.isalpha() for c in text or "") or not sample:
        return "und", 0.0, 1.0
    known = {c for _, t in sample for c in t.lower() if c.isalpha()}
    symbols = letters(text, known)
    rates = {name: phrase_count(symbols, letters(" ".join(t for n, t in sample if n == name), known), segment) / len(symbols) for name in sorted({n for n, _ in sample})}
    best = min(rates, key=lambda k: (rates[k], k))
    rest = [v for k, v in rates.items() if k != best]
    return best, 1 - rates[best] / (rates[best] + min(rest)) if rest else 1.0, rates[best]


def bands(raw, press, limit, chunk, chunk_band, share, gains):
    """Whether the compression bands reject a text of bytes."""
    ratio = lambda x: len(press(x)) / len(x)
    outside = lambda x, band: not band[0] <= ratio(x) <= band[1]
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)] if len(raw) > chunk else []
    bad = sum(len(p) for p in parts if outside(p, chunk_band if len(p) == chunk else limit(len(p))))
    plain = b"".join(bytes([b]) for b in raw if chr(b) not in "#*$%&|<>")
    below, above = max(g for g in gains if g[0] <= max(1, len(raw))), min((g for g in gains if g[0] > max(1, len(raw))), default=None)
    highest = below[1]
    if above:
        highest += (above[1] - below[1]) * math.log2(max(1, len(raw)) / below[0]) / math.log2(above[0] / below[0])
    padded = 0 < len(plain) < len(raw) and ratio(plain) - ratio(raw) > highest
    return bool(raw) and (outside(raw, limit(len(raw))) or bad >= share * len(raw) or padded)


def clauses(text, ends=".!?;:\n"):
    """Clauses of alnum_tokens()."""
    out, now = [], ""
    for c in text or "":
        if c in ends:
            out.append(alnum_tokens(now))
            now = ""
        else:
            now += c
    return [c for c in [*out, alnum_tokens(now)] if c]


def clause_weight(tokens, insult, words):
    """The grammar by its meaning: {word: insult weight}, {kind: set of words}."""
    total, weight = 0.0, [insult.get(w, 0.0) for w in tokens]
    is_ = lambda k, kind: 0 <= k < len(tokens) and weight[k] == 0 and tokens[k] in words[kind]
    for k in range(len(tokens)):
        negated = any(is_(k - d, "negation") for d in (1, 2))
        aimed = any(is_(k + d, "target") for d in (-3, -2, -1, 1, 2, 3))
        if weight[k]:
            total += weight[k] * (0.6 if negated else 1) * (0.7 if any(is_(k - d, "reported") for d in range(1, 13)) else 1) * (1.25 if aimed else 1)
        elif is_(k, "threat") and aimed:
            total += (0.5 if negated else 1) * (2.5 if any(is_(k - d, "modal") for d in (1, 2, 3)) else 1.5)
    return total


def text_weight(parts, rate, run):
    """Of (tokens, weight) of all clauses: the whole less what chance gives, or the best run of weighty clauses less the price of choosing it."""
    ends = []
    for n, w in parts:
        ends.append((ends[-1][1] if ends else 0, (ends[-1][1] if ends else 0) + n, w))
    hot, size = [e for e in ends if e[2]], ends[-1][1] if ends else 0
    best = max([0.0, *(sum(e[2] for e in hot[i : j + 1]) - rate * (hot[j][1] - hot[i][0]) for i in range(len(hot)) for j in range(i, len(hot)))])
    return max(sum(w for _, w in parts) - rate * size, best - math.log1p(size / run))


def lexicon(rows, stems, evidence, least, most, contexts, word_hash, place):
    """({feature: weight}, insults per token more in toxic texts) from (text, toxic) rows; a feature is a word or (beginning, length)."""
    n, bad, times, bad_times, seen = Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    size = [0, 0]
    for text, toxic in rows:
        ws = [w.encode() for w in alnum_tokens(text)]
        size[toxic] += len(ws)
        own = set()
        for k, w in enumerate(ws):
            for f in [w, *((w[:s], s) for s in stems if len(w) > s)]:
                own.add(f)
                times[f] += 1
                bad_times[f] += toxic
                if toxic:
                    seen[f].add(place(ws[k - 1] if k else None, ws[k + 1] if k + 1 < len(ws) else None) if f == w else word_hash(w) & 63)
        n.update(own)
        if toxic:
            bad.update(own)
    all_, toxic = len(rows), sum(t for _, t in rows)
    if not 0 < toxic < all_:
        return {}, 0.0
    out, base = {}, toxic / all_
    for f in n:
        b, k = bad[f], n[f]
        if b < 2 or b / k <= base:
            continue
        ratio = 2 * (b * math.log(b / (k * base)) + ((k - b) * math.log((k - b) / (k * (1 - base))) if k > b else 0))
        odds = math.log((bad_times[f] + 0.5) / (size[1] + 1)) - math.log((times[f] - bad_times[f] + 0.5) / (size[0] + 1))
        if ratio >= evidence and odds >= least and len(seen[f]) >= contexts * min(b, 20):
            out[f] = min(odds, most)
    hits = [0, 0]
    for text, t in rows:
        hits[t] += sum(insult(w.encode(), out, stems) > 0 for w in alnum_tokens(text))
    return out, max(0.0, hits[1] / max(1, size[1]) - hits[0] / max(1, size[0]))


def insult(word, features, stems):
    return max(features.get(word, 0.0), *(features.get((word[:s], s), 0.0) for s in stems if len(word) > s), 0.0)
