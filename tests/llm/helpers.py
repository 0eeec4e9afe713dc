"""Edge rows that every operator on documents must take, and brute-force versions."""
import hashlib
import random
import string

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: The same columns, further ones with names that operators use inside, and a nested one.
WIDE = SCHEMA + ", n_lines long, text_2 string, row struct<doc_id:long,text:string>, c0 string, key_id int, score double, starts int"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def passage(rng, n, words=None):
    words = words or ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def edge_rows(seed=1):
    """Null, empty and blank texts, a null id, copies, near copies, shared lines and passages, a very long text."""
    rng = random.Random(seed)
    base = passage(rng, 120)
    near = base.split()
    near[3] = "changed"
    shared = passage(rng, 70)
    line = "A line that Many documents share, word for word."
    texts = [None, "", "   \n\t ", "a", "one two", base, base, base.upper(), " ".join(near), base + "\n" + shared,
             passage(rng, 30) + "\n" + shared + "\n" + passage(rng, 40), shared, line, " " + line.lower() + "\t\n" + line,
             passage(rng, 50) + "\n" + line + "\nend", "é" * 300, "ab" * 400, passage(rng, 30_000) + "\n" + shared,
             "\x00\x01   x y <|endoftext|> 日本 \U0001f600", "Released under the MIT License.\nCC-BY-NC 4.0, cc by nc"]
    rows = [(k + 1, t, "en", "s", None) for k, t in enumerate(texts)]
    rows.append((None, base, None, None, 3))
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)


def wide(spark):
    return spark.createDataFrame([(*r, 7, "t", (1, "x"), "c", 5, 0.5, 9) for r in edge_rows()], WIDE)


def key(i):
    return -(2 ** 63) if i is None else i


def as_bytes(text):
    return (text or "").encode()


def line_dedup(rows, least=20, documents=3):
    def line_key(x):
        k = x.strip(b" \t\n\x0b\x0c\r").translate(LOWER)
        return k if len(k.decode()) >= least else None
    holders = {}
    for i, t in rows:
        for k in {line_key(x) for x in as_bytes(t).split(b"\n")} - {None}:
            holders.setdefault(k, []).append(key(i))
    out = []
    for i, t in rows:
        lines = as_bytes(t).split(b"\n")
        keys = [line_key(x) for x in lines]
        stay = [x for x, k in zip(lines, keys) if k is None or len(holders[k]) < documents or max(holders[k]) == key(i)]
        out.append((i, len(lines), len(lines) - len(stay), b"\n".join(stay).decode()))
    return out


def suffix_dedup(rows, depth=100):
    first, out = {}, []
    data = [(key(i), as_bytes(t)) for i, t in rows]
    for i, t in sorted(data):
        for s in range(len(t) - depth + 1):
            w = t[s:s + depth]
            first[w] = min(first.get(w, (i, s)), (i, s))
    for i, t in data:
        gone = bytearray(len(t))
        for s in range(len(t) - depth + 1):
            if first[t[s:s + depth]] < (i, s):
                gone[s:s + depth] = b"\1" * depth
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g)))
    return [(None if i == key(None) else i, *rest) for i, *rest in out]


def near_dedup(rows, percent, words=5):
    """(doc_id, n, component, kept) by comparing all pairs of rows."""
    sets = []
    for _, t in rows:
        w = as_bytes(t).translate(LOWER).split()
        sets.append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), key(i)), key(i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[find(k)]
        out.append((i, len(sets[k]), None if c == key(None) else c, key(i) == c))
    return out


def ordered(rows):
    return sorted(rows, key=repr)
