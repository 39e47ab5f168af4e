"""Integer Lloyd operators and the secret scan against plain versions, and their awkward rows."""

import base64
import gzip
import hashlib
import math
import random
import re
import urllib.parse
import zlib

import numpy as np
import plain
import pytest

from armwise.llm import annulus, lloyd, secrets, vector_codes

ODD = [None, [], [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [math.nan], [1.0] * 63 + [math.inf]]


def ints(v) -> tuple[int, ...] | None:
    if v is None or len(v) != 64 or any(x is None or not math.isfinite(x) for x in v):
        return None
    return tuple(math.floor(1024 * float(x)) for x in v)


def nearest(x, centres) -> tuple[int, int]:
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centres))


def means(groups, centres):
    return [tuple(sum(col) // len(g) for col in zip(*g, strict=True)) if (g := groups.get(i)) else c for i, c in enumerate(centres)]


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, x) for i, v in rows if (x := ints(v))]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))
    centres = [x for _, x in order[:k]]
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x, centres)[1], []).append(x)
        centres = means(groups, centres)
    placed = [(i, *reversed(nearest(x, centres))) for i, x in kept]
    sums = {}
    for _, c, d in placed:
        sums[c] = sums.get(c, 0) + d
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in placed), key=repr)


def plain_codes(rows, entries=256, rounds=4):
    kept = [(i, lab, x) for i, lab, v in rows if (x := ints(v))]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], np.int32).tobytes()))
    books = [[x[16 * p : 16 * p + 16] for _, _, x in order[:entries]] for p in range(4)]
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, _, x in kept:
                y = x[16 * p : 16 * p + 16]
                groups.setdefault(nearest(y, books[p])[1], []).append(y)
            books[p] = means(groups, books[p])
    out, sums = [], {}
    for i, lab, x in kept:
        near = [nearest(x[16 * p : 16 * p + 16], books[p]) for p in range(4)]
        out.append((i, lab, "".join(f"{c:02x}" for _, c in near), sum(d for d, _ in near)))
        sums[lab] = sums.get(lab, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, code, e, sums[lab], digest) for i, lab, code, e in out), key=repr)


def tied(rng, n):
    """Vectors on a coarse grid, many of them equal or equally far from two centres."""
    return [[rng.choice([-0.5, 0.0, 0.5]) if rng.random() < 0.1 else 0.0 for _ in range(64)] for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", "x") for i, lab, v in rows], "vec_id long, embedding array<float>, label int, cluster string, x string")


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_and_codes_match_plain_versions_with_ties_and_odd_rows(spark, seed):
    rng = random.Random(seed)
    vectors = tied(rng, 60) + [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(40)] + ODD
    vectors = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    rows = [(i if i % 31 else None, rng.choice([None, 0, 1]), v) for i, v in enumerate(vectors)]
    rows += rows[:20]
    df = table(spark, rows)
    got = sorted((tuple(r) for r in annulus.cluster(df).collect()), key=repr)
    assert got == plain_clusters([(i, v) for i, _, v in rows])
    got = sorted((tuple(r) for r in vector_codes.encode(df, entries=16).collect()), key=repr)
    assert got == plain_codes(rows, entries=16)


def test_fewer_vectors_than_centres_and_none(spark):
    rows = [(1, None, [0.5] * 64), (2, 1, [0.25] * 64), (3, 1, [0.25] * 64)]
    assert sorted((tuple(r) for r in annulus.cluster(table(spark, rows)).collect()), key=repr) == plain_clusters([(i, v) for i, _, v in rows])
    assert sorted((tuple(r) for r in vector_codes.encode(table(spark, rows)).collect()), key=repr) == plain_codes(rows)
    none = table(spark, rows).where("false")
    assert annulus.cluster(none).count() == vector_codes.encode(none).count() == 0
    assert annulus.cluster(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="range of exact distances"):
        annulus.cluster(table(spark, [(1, 1, [1e30] * 64)])).collect()


def test_annulus_leaves_centroids_out_and_keeps_ties():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-3, 4, (200, 8)) * rng.integers(1, 300, (200, 1))
    centroids[50:60] = centroids[10:20]
    x = np.concatenate([centroids[rng.integers(0, 200, 300)] + rng.integers(-5, 6, (300, 8)), (centroids[:100] + centroids[100:]) // 2])
    rings = annulus.Rings.of(centroids)
    first, last = rings.candidates(x)
    assert (last - first).mean() < 120
    d = lloyd.squared(x, centroids)
    label, best = rings.nearest(x)
    assert (label == d.argmin(1)).all() and (best == d.min(1)).all()


def test_elkan_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(7)
    x = (rng.integers(0, 12, (2000, 1)) * 400 + rng.integers(-40, 41, (2000, 16))).astype(np.int64)
    entries = x[:64].copy()
    book = vector_codes.Codebook.of(entries)
    bounds = book.first(x)
    for _ in range(5):
        after = np.array([x[bounds.entry == c].sum(0) // max(1, (bounds.entry == c).sum()) if (bounds.entry == c).any() else e for c, e in enumerate(entries)])
        lower, step = vector_codes._small(bounds.lower)
        assert (lower * step.astype(float)[:, None] <= bounds.lower).all()
        bounds.lower = lower * step.astype(float)[:, None]
        book = vector_codes.Codebook.of(after, entries)
        bounds, compared = book.again(x, bounds)
        d = lloyd.squared(x, after)
        assert (bounds.entry == d.argmin(1)).all() and (bounds.error == d.min(1)).all()
        assert (bounds.lower**2 <= d).all() and (bounds.upper**2 >= d.min(1)).all()
        assert compared < 0.5 * x.shape[0] * len(entries)
        entries = after


def test_decoded_codes_are_as_far_as_their_error(spark):
    rows = [(i, 0, [((i * 37 + j * 11) % 50) / 25 for j in range(64)]) for i in range(30)]
    codes = vector_codes.encode(table(spark, rows), entries=4)
    kept = {i: ints(np.float32(v).tolist()) for i, _, v in rows}
    plain_books = [[kept[i][16 * p : 16 * p + 16] for i in range(4)] for p in range(4)]
    for _ in range(4):
        for p in range(4):
            groups = {}
            for x in kept.values():
                groups.setdefault(nearest(x[16 * p : 16 * p + 16], plain_books[p])[1], []).append(x[16 * p : 16 * p + 16])
            plain_books[p] = means(groups, plain_books[p])
    books = [np.array(b) for b in plain_books]
    errors = {r.vec_id: r.error for r in codes.collect()}
    for r in vector_codes.decode(codes, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.vector, kept[r.vec_id], strict=True)) == errors[r.vec_id]


KEY, TOKEN = "AKIA" + "Q7" * 8, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def plain_base(text):
    out = []
    word = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def listed(found):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_secrets_of_whole_tables_and_awkward_rows(spark):
    for docs in (spark.read.parquet(f"{plain.SF_LARGER}/documents.parquet"), plain.awkward(spark)):
        want = sorted((r.doc_id or -1, *[sum(x[1] == k for x in plain_base(r.text or "")) for k in range(3)], hashlib.sha256(listed(plain_base(r.text or "")).encode()).hexdigest()) for r in docs.collect())
        rows = secrets.summary(docs).collect()
        assert sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want
        assert secrets.summary(plain.empty(docs)).count() == 0


def test_base_patterns_at_their_bounds():
    kelvin = "toKen = abcdef12 Token:abcde pasſword=abcdef"
    texts = ["token=abcde", "token=abcdef", "API_KEY' : \"a.b/c=", "apikey:secret=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIA" + "B" * 30, "0" * 23, "0" * 24 + "g" + "a" * 25, "token  =\n abcdefg", kelvin, "\U0001f600 passwd=éabcdefg PASSWD=abcdefg"]
    for t in texts:
        assert sorted((a, ("assign", "access", "hex").index(k), b) for k, a, b in secrets.found(t)) == plain_base(t)


def b64(x: bytes | str) -> str:
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


@pytest.mark.parametrize(
    ("hidden", "path"),
    [
        (lambda s: b64(s), "base64"),
        (lambda s: b64("long " * 3 + s + " tail"), "base64"),
        (lambda s: base64.urlsafe_b64encode(("ÿþ?>" + s).encode()).decode(), "base64"),
        (lambda s: base64.encodebytes((b"some words before " * 6) + s.encode()).decode(), "base64"),
        (lambda s: b64(b64(s)), "base64>base64"),
        (lambda s: "".join(f"%{ord(c):02X}" for c in s), "url"),
        (lambda s: "".join(f"%25{ord(c):02x}" for c in s), "url"),
        (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "unicode"),
        (lambda s: "".join(f"\\x{ord(c):02x}" for c in s), "unicode"),
        (lambda s: "".join(f"&#x{ord(c):x};" for c in s), "unicode"),
        (lambda s: "".join(f"%5Cu{ord(c):04x}" for c in s), "url>unicode"),
        (lambda s: b64(gzip.compress(s.encode())), "base64>compressed"),
        (lambda s: b64(zlib.compress(s.encode(), 9)), "base64>compressed"),
        (lambda s: urllib.parse.quote(zlib.compress(s.encode())), "url>compressed"),
        (lambda s: b64(zlib.compress(b64(gzip.compress(s.encode())).encode())), "base64>compressed>base64>compressed"),
        (lambda s: urllib.parse.quote(b64(zlib.compress(s.encode())), safe=""), None),
    ],
)
def test_nested_secrets_are_found_where_they_lie(hidden, path):
    for s, kind in ((KEY, "access"), (TOKEN, "assign"), ("9f" * 16, "hex")):
        inner = hidden(s)
        text = "café \U0001f600 before: " + inner + " after"
        got = [(a, b, p) for (a, k, b), (base, p) in secrets.spans(text).items() if k == kind and not base]
        place = text.index(inner)
        assert got, (s, inner)
        assert all(place <= a < b <= place + len(inner) for a, b, _ in got)
        if path:
            assert path in {p for *_, p in got}


def test_spans_of_plain_escapes_are_exact():
    for start, end in ((0, 1), (3, 9), (0, len(KEY))):
        coded = KEY[:start] + "".join(f"%{ord(c):02x}" for c in KEY[start:end]) + KEY[end:]
        text = "é%C3%A9%FF " + coded + "."
        at = text.index(coded)
        assert (at, "access", at + len(coded)) in secrets.spans(text)
    inner = b64("a" + KEY)
    assert (5 + 1, "access", 5 + len(inner)) in secrets.spans("text " + inner)


def test_layers_end_and_clean_texts_have_no_spans(spark):
    deep = KEY
    for _ in range(12):
        deep = "".join(f"%{ord(c):02x}" if i % 7 == 0 else c for i, c in enumerate(deep))
    assert any(k == "access" for _, k, _ in secrets.spans("x " + deep))
    mixed = "%5Cu0025" + "5Cu0025" * 400 + "41" + KEY[1:]
    assert any(k == "access" for _, k, _ in secrets.spans(mixed))
    for text in ("%" + "25" * 5000, "\\u005c" * 300, "%zz \\u12 &#99999999; &#; \\U99999999 %", "H4sI" + "A" * 4000, "eJw" + "q" * 4000, "internationalisation " * 500, b64(bytes(range(256)) * 20)):
        assert not [k for k in secrets.spans(text) if k[1] != "hex"]


def test_a_large_compressed_layer_is_read_whole():
    words = ("lorem ipsum " * 500_000).encode()
    text = "x " + b64(zlib.compress(words + TOKEN.encode() + words))
    assert {(a, k) for a, k, _ in secrets.spans(text)} >= {(2, "assign"), (2, "hex")}


def test_redaction_leaves_nothing_but_what_it_should(spark):
    rows = [(1, f"keep {KEY} and {TOKEN} end"), (2, None), (3, "nothing here"), (4, "q " + b64("zz " + KEY) + " r")]
    out = {r.doc_id: r.text for r in secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == "keep [secret] and [secret]\" end" and out[2] is None and out[3] == "nothing here"
    assert KEY not in base64.b64decode(out[4].split()[1].replace("[secret]", "") + "===").decode("latin-1")
