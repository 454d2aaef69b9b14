"""Plain Python versions of the operators, straight from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def mix_targets(sizes, weights):
    """Sizes by source in order; the plain rounds of the contract."""
    total, out, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped and sizes[i] > 0]
        left = total - sum(3 * sizes[i] for i in capped)
        for i in free:
            out[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if out[i] > 3 * sizes[i]]
        if not over:
            return out
        for i in over:
            out[i] = 3.0 * sizes[i]
        capped |= set(over)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def private_base(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text)
                  if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words))
          if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in at})))


def removed_bytes(texts, size=200):
    """(n_bytes, n_removed, n_spans, kept digest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, shingle=3):
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0
    rolled = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in rolled]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=3):
    """Index of the first member of each one's component."""
    points = np.array(prints, dtype=np.uint64)
    label = list(range(len(points)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= bits):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def nearest(rows, is_query, k=20):
    """(query, rank, id, score) of rows (id, vector), each an entry: sums in
    order of the components, shorter vectors filled with zeros."""
    fine = [(i, v) for i, v in rows if i is not None and v is not None and len(v) and all(
        x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    matrix = np.zeros((len(fine), max((len(v) for _, v in fine), default=0)))
    for at, (_, v) in enumerate(fine):
        matrix[at, :len(v)] = v
    out = []
    for at, (q, _) in enumerate(fine):
        if not is_query(q):
            continue
        score = np.zeros(len(fine))
        for c in range(matrix.shape[1]):
            score += matrix[:, c] * matrix[at, c]
        order = sorted((j for j in range(len(fine)) if fine[j][0] != q), key=lambda j: (-score[j], fine[j][0]))[:k]
        out += [(q, r + 1, fine[j][0], score[j]) for r, j in enumerate(order)]
    return out


def url_parts(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return lower_ascii(host), path


def group(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def line_dedup(docs, bound=lambda size: 2 if size >= 8 else 3, depth=3, similarity=0.8):
    """{(id, text): kept text}; equal rows are one document.  In a leaf each
    kind of lines, most frequent first, joins the first leader it agrees with
    or leads."""
    docs = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))

    def tokens(line):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in WORD.findall(line))

    count, split = Counter(), {d: (d[1] or "").split("\n") for d in docs}
    for d in docs:
        count.update(tokens(x) for x in split[d] if WORD.search(x))
    digest = {t: hashlib.md5(" ".join(t).encode()).digest() for t in count}
    leaves = group(count, lambda t: (len(t), t[:depth]))
    template = {}
    for kinds in leaves.values():
        leaders = []
        for t in sorted(kinds, key=lambda t: (-count[t], digest[t])):
            agree = (x for x in leaders if sum(a == b for a, b in zip(t, x)) >= similarity * len(t))
            template[t] = next(agree, t)
            if template[t] is t:
                leaders.append(t)
    places = defaultdict(list)
    for d in docs:
        for i, x in enumerate(split[d]):
            if WORD.search(x):
                places[template[tokens(x)]].append((d, i))
    gone = {p for t, at in places.items() if len({d for d, _ in at}) >= bound(len(t)) for p in at[1:]}
    return {d: d[1] if not any((d, i) in gone for i in range(len(split[d]))) else
            "\n".join(x for i, x in enumerate(split[d]) if (d, i) not in gone) for d in docs}


def hard_negatives(rows, positives=5, negatives=5, low=80, high=100, scale=256, every=100):
    """Rows (id, vector, label); shorter vectors are filled with zeros."""
    fine = [(i, [int(np.floor(scale * float(x))) for x in v], c) for i, v, c in rows if i is not None and v is not None
            and c is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, c in fine:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, d) for j, w, d in fine if j != i)
        for p, j, _ in [s for s in scored if s[2] == c][:positives]:
            inside = [s for s in scored if s[2] != c and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k, _) in enumerate(inside)]
    return sorted(out)


def collocations(docs, longest=3, min_count=10, share=50, top=2000):
    """Rows (lang, text)."""
    counts = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts[lang or "und"].update(tuple(words[i:i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = defaultdict(int)
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        kept = []
        for p, a in often.items():
            if 100 * inside[p] >= share * a and inside[p]:
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, l, e, total, -s) for r, (s, a, p, l, e) in enumerate(sorted(kept)[:top])]
    return sorted(out)
