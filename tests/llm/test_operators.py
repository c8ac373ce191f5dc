"""Corpus operators against brute force on small tables with edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pulseline.llm import decontaminate as DC
from pulseline.llm import html_text as H
from pulseline.llm import importance as IM
from pulseline.llm import line_dedup as LD
from pulseline.llm import near_dedup as ND
from pulseline.llm import quality_rules as QR
from pulseline.llm import sentencepiece_codec as SP
from pulseline.llm import suffix_dedup as SD
from pulseline.llm import token_counts as TC
from pulseline.llm import toxicity as TX

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or ["ab", "cde", "fgh", "i", "jklm", "nop", "qr", "stu", "vwx", "yz"]
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    big = [f"{a}{b}{c}" for a in "abcdefgh" for b in "klmnopqr" for c in "stuvwxyz"]
    base = [prose(rng, 120, big) for _ in range(12)]
    passage = prose(rng, 90, big)
    out = []
    for k, t in enumerate(base):
        out.append(t)
        if k % 2:
            w = t.split()
            w[60] = "edited"
            out.append(" ".join(w))
        if k % 3 == 0:
            out.append(t)
        if k % 4 == 0:
            out.append(f"{prose(rng, 30, big)} {passage} {prose(rng, 30, big)}")
    out += [None, None, "", " \n\t ", "one", "ONE", "two words", "on " * 700, "x" * 2000, "é▁  ñ 日本\n" * 90, "a b c d e f g h i j " * 12, prose(rng, 4000, big)]
    return [(k, t, ["en", "de", None][k % 3], f"s{k % 2}", len(t or "")) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    plain = [(i, t, lang, s, n) for i, t, lang, s, n in rows]
    plain += [(None, rows[0][1], "en", "s0", 1), (None, None, None, None, None), plain[2], plain[2]]
    return spark.createDataFrame(plain, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("percent", [85, 40])
def test_near_dedup(docs, percent, monkeypatch):
    monkeypatch.setattr(ND, "BLOCK", 2)  # clusters of several blocks
    data = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingles(t) for _, t in data]
    root = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    want = []
    for k, (i, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if root[j] == root[k] and data[j][0] is not None]
        best = min(ids, default=None) if sets[k] else i
        want.append((i, len(sets[k]), best, i == best))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in ND.near_duplicates(docs, percent=percent, leaf=3).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("share", [0.85, 0.8])
def test_near_dedup_estimate_loses_little(share):
    n = ND.TREES * ND.DEPTH
    lost = sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1) if k < (share - ND.SLACK) * n)
    assert lost < 1e-5


def test_near_dedup_empty(empty):
    assert ND.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 1024])
def test_suffix_dedup(docs, hot):
    span = 60
    data = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(t[k : k + span] for _, t in data for k in range(len(t) - span + 1))
    want = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if seen[t[k : k + span]] > 1:
                gone[k : k + span] = b"\x01" * span
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    out = SD.repeated_substrings(docs, span=span, seed=20, batches=3, hot=hot).collect()
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out))) == sorted(map(str, want))
    assert all(sum(s.stop - s.start for s in r.removed or []) == r.n_removed for r in out)


def test_suffix_dedup_empty(empty):
    assert SD.repeated_substrings(empty).count() == 0


def test_suffix_levels(spark):
    family = SD.SuffixIndexFamily()
    for k in range(5):
        family.add(spark.range(10).selectExpr(f"id * {k + 1} prefix"))
    assert [size for size, _ in family.levels] == [4, 1]
    want = Counter(v * (k + 1) for k in range(5) for v in range(10))
    assert {r.prefix for r in family.repeated().collect()} == {v for v, n in want.items() if n > 1}


def by_lines(data, least):
    """Rows (doc_id, text) to (doc_id, left, removed spans), by the definition."""
    cut = lambda t: [m[0] for m in re.finditer(r"(?:[^\n.!?]|[.!?]+[^\s.!?])*[.!?]*\s*", t) if m[0]]
    name = lambda u: " ".join(u.lower().split())
    seen, out = set(), []
    for i, t in data:
        at, run, gone = 0, [], []
        for u in [*cut(t or ""), "\0"]:
            if name(u) in seen and u != "\0":
                run.append((at, at + len(u), len(u.split())))
            else:
                if sum(n for _, _, n in run) >= least:
                    gone.append((run[0][0], run[-1][1]))
                run = []
            seen.add(name(u) or None)
            at += len(u)
        seen.discard("\0")
        left = None if t is None else "".join(c for k, c in enumerate(t) if not any(x <= k < y for x, y in gone))
        out.append((i, left, ",".join(f"{x}-{y}" for x, y in gone)))
    return out


def test_line_dedup(spark, empty):
    rng = random.Random(12)
    stock = ["All rights reserved by them.", "Was it so?", "One two three four five six seven\n", "An end... ", "x.y is 3.5 of it! "]
    passage = " ".join(prose(rng, 9).capitalize().replace(".", "") + rng.choice([".", "!", "?\n", "...\n\n"]) for _ in range(8))
    texts = ["".join(rng.choice([*stock, prose(rng, 8) + ". "]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}" if k % 5 == 0 else t for k, t in enumerate(texts)]
    texts += [None, "", " \n ", "?!. \n", passage.upper(), passage.replace(" ", "  "), (prose(rng, 30) + ". ") * 3000, "word " * 30_000]
    data = list(enumerate(texts))
    docs = spark.createDataFrame([(k, t, f"keep{k}", k) for k, t in data], "doc_id long, text string, n_removed string, `N_Units` long").repartition(5)
    out = LD.dedup_lines(docs, least=15)
    assert out.columns == ["doc_id", "text", *LD.RESULTS, "n_removed_in", "N_Units_in"]
    out = out.collect()
    assert sorted((r.doc_id, r.text, r.removed_spans) for r in out if r.text is not None) == sorted(x for x in by_lines(data, 15) if x[1] is not None)
    assert all((r.n_removed_in, r.N_Units_in) == (f"keep{r.doc_id}", r.doc_id) for r in out)
    assert sum(r.n_removed > 0 for r in out) >= 14
    assert [r.text for r in out if r.doc_id == 60] == [None]


def test_line_dedup_odd_rows(spark, empty):
    long = " ".join(f"w{k}" for k in range(25))
    rows = [(6, "b " + long), (6, long), (6, long), (None, long), (None, None)]
    ways = set()
    for parts in (1, 3, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        ways.add(str(sorted(str((r.doc_id, r.text)) for r in LD.dedup_lines(docs).collect())))
    assert ways == {str(sorted(map(str, [(6, "b " + long), (6, long), (6, ""), (None, ""), (None, None)])))}
    assert LD.dedup_lines(empty).count() == 0
    assert {"lang", "n_chars"} <= set(LD.dedup_lines(empty).columns)
    odd = spark.createDataFrame([(1, long, 2, 3)], "doc_id long, text string, _u_row int, digest int")
    assert LD.dedup_lines(odd).select("_u_row", "digest").first() == (2, 3)


def test_line_dedup_hot_unit(spark, monkeypatch):
    monkeypatch.setattr(LD, "HOT", 2)  # a unit in over half of all is joined by broadcast
    line = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(k, line) for k in range(200)] + [(1000 + k, f"some other {k} " + line + f" {k // 2}") for k in range(60)], "doc_id long, text string")
    assert {r.doc_id for r in LD.dedup_lines(docs).filter("n_removed > 0").collect()} == set(range(1, 200))


def test_token_counts(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(TC.tokenizer_path("word_bpe_49k.json"))
    hard = ["<|endoftext|>Hi<|startoftext|>", "It's 42½ ΣΑΣ İı", "aaaa" * 500, "a b c\x85d\x1ce", "é ́x", "don'T 'RE hahahaha🙂🙂"]
    counter = TC.ChunkCounter(TC.tokenizer_path("word_bpe_49k.json"))
    assert counter.count(hard) == [len(e.ids) for e in library.encode_batch(hard, add_special_tokens=False)]
    for r in TC.token_counts(docs, limit=100).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 100)
    assert TC.token_counts(empty).count() == 0


def test_quality_counts(docs, empty):
    for r in QR.quality_rules(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)
    assert QR.quality_rules(docs).count() == docs.count()
    assert QR.quality_rules(empty).count() == 0


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_quality_outliers(spark, monkeypatch, broadcast):
    monkeypatch.setattr(QR, "BROADCAST", broadcast)
    rng = random.Random(1)
    good = [(k, prose(rng, rng.randint(60, 200), [f"w{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]), "en", "s", 0) for k in range(300)]
    junk = [(1000 + k, " ".join(f"{w}$$$" for w in prose(rng, 80, [f"w{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]).split()), "en", "s", 0) for k in range(60)]
    kept = {r.doc_id for r in QR.quality_rules(spark.createDataFrame(good + junk, DOCS)).filter("kept").collect()}
    assert not {k for k in kept if k >= 1000}
    assert len(kept) >= 295


def least_determinant(x):
    """Mean, covariance (with floors) and determinant of the share COVER of the rows of x whose covariance has the least determinant, by trying all."""
    from itertools import combinations

    import numpy as np

    floor = np.diag([QR.FLOOR[s] ** 2 for s in QR.STATISTICS])
    best = None
    for own in combinations(range(len(x)), math.ceil(QR.COVER * len(x))):
        part = x[list(own)]
        c = np.cov(part.T, bias=True)
        det = np.linalg.det(c + floor)
        if best is None or det < best[2]:
            best = part.mean(0), c * QR.CONSISTENT + floor, det
    return best


@pytest.mark.parametrize("few", [True, False])
def test_least_covariance_determinant(spark, few):
    import numpy as np

    rng = np.random.default_rng(5)
    units = {f"u{k}": rng.normal(size=(12, 5)) @ rng.normal(size=(5, 5)) + np.where(np.arange(12)[:, None] < 3, rng.normal(size=5) * 60, 0) for k in range(6)}
    units["same"] = np.ones((8, 5))
    rows = [(u, *map(float, v)) for u, x in units.items() for v in x]
    names = [f"{s} double" for s in QR.STATISTICS]
    vectors = spark.createDataFrame(rows, "unit string, " + ", ".join(names)).repartition(3)
    found = QR.robust_estimates(vectors, few)
    got = {r.unit: r for r in found.collect()}
    far = {(r.unit, round(r.capitals, 9)): r.d2 for r in QR._distances(vectors, found, few).collect()}
    assert set(got) == set(units)
    for u, x in units.items():
        mean, cov, _ = least_determinant(x)
        r = got[u]
        low = np.array([[r[QR._factor(i, j)] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose([r[QR._centre(i)] for i in range(5)], mean)
        assert np.allclose(low @ low.T, cov)
        for v in x:
            assert far[u, round(v[2], 9)] == pytest.approx((v - mean) @ np.linalg.solve(cov, v - mean), rel=1e-6, abs=1e-9)


def test_consistency_factor():
    import numpy as np

    rng = np.random.default_rng(0)
    d2 = (rng.normal(size=(400_000, 5)) ** 2).sum(1)
    assert pytest.approx(5 / d2[d2 <= np.quantile(d2, QR.COVER)].mean(), rel=0.01) == QR.CONSISTENT


def test_quality_verdict_is_the_distance(docs):
    out = QR.quality_rules(docs, cutoff=0.01).collect()
    assert any(not r.kept and not r.base_failed for r in out)
    assert all(r.kept == (not r.base_failed and r.distance <= 0.01) for r in out)


def test_decontamination(spark, docs, empty):
    item = "Anna has 12 apples and gives 5 kg of them to her friend Bob, how many apples does Anna have left after 12 days?"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    same = f"so they said {item} ok"
    other = same.replace("Anna", "Maria").replace("12", "30").replace("Bob", "Tom").replace("5 kg", "7 kg")
    texts = [same, other, other.replace("Maria have", "Zoe have").replace("30 days", "31 days"), same.upper(), None, "", "nothing here " * 20, same]
    rows = spark.createDataFrame([(k if k != 7 else 0, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in DC.decontaminate(rows, bench).collect()}
    assert got[(0, 1)] is True
    assert got[(1, 1)] is False
    assert (2, 1) not in got
    assert (0, 2) not in got
    assert DC.decontaminate(empty, bench).count() == 0
    assert DC.decontaminate(docs, bench.limit(0)).count() == 0
    plan = DC.decontaminate(rows, bench)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
    assert "PythonUDF" not in plan


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_decontamination_any_layout(spark, monkeypatch, broadcast):
    monkeypatch.setattr(DC, "BROADCAST", broadcast)
    item = "Alice has 5 apples and buys more. Bob has 3 apples less than she has now. How many apples do they have?"
    numbers = "Add 1 2 3 4 5 6 7 8 9 10 11 12"
    other = item.replace("Alice", "Maria").replace("5", "9").replace("Bob", "Tom").replace("3", "4")
    texts = [item, item.upper(), item.lower(), item.replace(" ", "\n"), item.replace(" Bob", "\n  Bob"), "So:\n" + other, other.replace(". ", ".\n\n"), other.replace("Tom has", "Maria has"), "They said " + numbers.lower()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, numbers)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in DC.decontaminate(rows, bench).collect()}
    assert {k for k, r in got.items() if r.verbatim} >= {(k, 1) for k in range(5)} | {(8, 2)}
    assert not got[(5, 1)].verbatim
    assert not got[(6, 1)].verbatim
    assert all(0 < r.matched <= r.n_windows for r in got.values())
    assert all(got[(k, 1)].matched == got[(0, 1)].matched for k in (3, 4))


def leaks_by_hand(docs, items, coverage):
    """{(doc_id, item_id): (matched, of, verbatim)} by the definition, pair by pair."""
    import regex

    def tokens(text):
        marked = regex.sub(r"(?<![\p{L}\p{M}\p{N}])\p{Lu}(?=\p{Ll})", "\x01\\g<0>", text or "")
        return regex.findall(r"[0-9]+(?:[.,:/][0-9]+)*|\x01?\p{L}[\p{L}\p{M}\p{N}]*", marked.lower())

    def kinds(t):
        number = lambda w: w[0] in "0123456789"
        return ["\x01" if w[0] == "\x01" else "\x02" if number(w) else "\x03" if w in DC.UNITS and i and number(t[i - 1]) else w for i, w in enumerate(t)]

    n, out = DC.WINDOW, {}
    for i, text in docs:
        d = tokens(text)
        dk, dp = kinds(d), [w.lstrip("\x01") for w in d]
        for j, item in items:
            t = tokens(item)
            tk, tp = kinds(t), [w.lstrip("\x01") for w in t]
            slots = lambda p: [q for q in range(p, p + n) if tk[q] < "\x04"]  # noqa: B023, E731
            starts = range(len(t) - n + 1)
            typed = [p for p in starts if n - len(slots(p)) >= DC.LITERALS]
            good = {}  # place of a window that counts: whether it is word by word the item's
            for diagonal in range(-len(t), len(d)):
                own = [p for p in starts if 0 <= p + diagonal <= len(d) - n]
                hit = [p for p in own if p in typed and tk[p : p + n] == dk[p + diagonal : p + diagonal + n]]
                pairs = {(t[q], d[q + diagonal]) for p in hit for q in slots(p)}
                odd = {x for x in pairs if any((x[0] == y[0]) != (x[1] == y[1]) for y in pairs)}
                for p in hit:
                    mine = [(t[q], d[q + diagonal]) for q in slots(p)]
                    if not odd & set(mine):
                        good[p] = good.get(p, False) or all(x == y for x, y in mine)
                plain = [p for p in own if tp[p : p + n] == dp[p + diagonal : p + diagonal + n]]
                good.update(dict.fromkeys(plain, True))
            same = all(good.values())
            by_type = [p for p in good if p in typed]
            if typed and len(by_type) >= coverage * len(typed):
                out[i, j] = (len(by_type), len(typed), same)
            elif good and len(good) >= coverage * len(starts):
                out[i, j] = (len(good), len(starts), same)
    return out


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_decontamination_by_hand(spark, monkeypatch, broadcast):
    monkeypatch.setattr(DC, "BROADCAST", broadcast)
    rng = random.Random(21)
    words = "has gives takes apples and then many does left of the to days".split()
    names, odd = ["Ann", "Bob", "Cem", "Dora"], ["kg", "m", "é1"]
    make = lambda k: " ".join(rng.choice([rng.choice(words)] * 5 + [rng.choice(names), str(rng.randint(1, 4)), f"{rng.randint(1, 4)} {rng.choice(odd)}"]) for _ in range(k))
    items = [(j, make(rng.randint(5, 30))) for j in range(8)]
    docs = []
    for i in range(60):
        item = rng.choice(items)[1].split()
        swap = {x: rng.choice([*names, "1", "2", "3", "4", x, x]) for x in set(item) if x[0].isdigit() or x[0].isupper()}
        body = [swap.get(x, x) if rng.random() < 0.98 else "7" if x[0].isdigit() else x for x in item]
        a, b = sorted(rng.sample(range(len(body) + 1), 2)) if i % 2 else (0, len(body))
        docs.append((i, f"{make(4)} {' '.join(body[a:b])} {make(3)}"))
    docs += [(100, None), (101, ""), (102, "A " * 5000), (103, items[0][1].upper()), (104, items[1][1].replace(" ", " \n"))]
    out = DC.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), coverage=0.1)
    got = {(r.doc_id, r.item_id): (r.matched, r.n_windows, r.verbatim) for r in out.collect()}
    want = leaks_by_hand(docs, items, 0.1)
    assert got == want
    assert len(want) > 20
    assert len({v[2] for v in want.values()}) == 2


def test_decontamination_slots_both_ways(spark):
    item = "anna gives the other people 12 apples and later on 5 pears to them so how many fruits are left over here"
    docs = [item.replace("12", "7").replace("5", "9"), item.replace("12", "7").replace("5", "7")]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.matched for r in DC.decontaminate(rows, spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.1).collect()}
    assert got[0] > got[1] > 0  # two values of the item in one of the document: their windows don't count, the others do


def test_shuffled_benchmark(spark, monkeypatch):
    monkeypatch.setattr(DC, "BROADCAST", 0)
    text = " ".join(f"word{chr(97 + k)}" for k in range(20))
    rows = spark.createDataFrame([(1, f"before it {text} after it"), (2, "else " * 30)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.verbatim) for r in DC.decontaminate(rows, spark.createDataFrame([(9, text)], "item_id long, text string")).collect()] == [(1, 9, True)]


def test_html(spark):
    held = [b for b in (H.leaf_blocks(p, labelled=True) for p in H.labelled_pages(80, 1234)) if b]
    field = H.trained()
    right = [x.label == y for b in held for x, y in zip(b, field.labels(b), strict=True)]
    assert sum(right) / len(right) > 0.99
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>On &amp; off</h1><p>First  one<br>here, it is long enough to read.<p><b>Second</b> one, that is also a sentence.<script>var x='</p>'</script></article><div class='comments'><p>Nice post!</p></div><footer>&copy; 2020</footer>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "u", ""), (4, "u", "<p"), (4, "u", "<!-- <p>x</p>")], "page_id long, url string, html string")
    out = {r.page_id: r for r in H.extract_text(pages).collect()}
    assert out[1].text == "On & off\n\nFirst one here, it is long enough to read.\n\nSecond one, that is also a sentence."
    assert out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[2].n_chars) == ("", 0)
    assert H.extract_text(pages.limit(0)).count() == 0


def test_html_marks_of_training_are_nothing_on_pages():
    field = H.trained()
    page = "<nav>{}<a href=/>Home</a></nav><article>{}<p>A sentence that is long enough to be read.</p></article>"
    plain = H.main_text(page.format("", ""), field)
    for mark in ('<div data-main="app">', "<div data-main>", '<div data-main="1">', "<div data-main='x' data-main=0>"):
        assert H.main_text(page.format(mark, mark), field) == H.main_text(page.format("<div>", "<div>"), field)
        assert all(b.label is None for b in H.leaf_blocks(mark + "x"))
    assert "long enough" in plain


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ('<div class="a">x' * 10_000, 10_000), ('<a href="' * 22_000, 0), ("<script " * 20_000, 0), ("<a href='x>" * 10_001 + "y", 1), ("<div>" * 20_000 + "</span>" * 20_000 + "x", 1),
        ("<b>" * 10_000 + "<div></div>" * 10_000 + "x", 1), ("<!--" * 20_000, 0), ("<" * 100_000, 1), ("<a \"><b '>" * 10_000 + "x", None), ("<p>y<svg/>" * 10_000, 10_000), ("</" * 50_000, 0), ("&amp" * 50_000, 1), ("<li><p>z" * 10_000, 10_000),
    ],
)
def test_html_of_any_shape_takes_linear_time(page, blocks):
    import time

    field, start = H.trained(), time.process_time()
    found = H.leaf_blocks(page)
    field.labels(found)
    assert time.process_time() - start < 3
    assert blocks is None or len(found) == blocks


def test_viterbi_is_the_best_path():
    from itertools import product

    field, rng = H.trained(), random.Random(2)
    for b in [x for x in map(H.leaf_blocks, H.labelled_pages(30, 7)) if 0 < len(x) < 10]:
        s = [v + rng.uniform(-3, 3) for v in field.scores(b)]
        field_like = H.Field()
        field_like.move = field.move
        field_like.scores = lambda _, s=s: s
        value = lambda path, s=s: sum(x for x, y in zip(s, path, strict=True) if y) + sum(field.move[a][c] for a, c in zip(path, path[1:], strict=False))
        assert value(field_like.labels(b)) == pytest.approx(max(map(value, product((0, 1), repeat=len(b)))))


def test_sentencepiece(docs, empty):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=SP.model_path("piece_bpe_32k.model"))
    plain = SP.encode(docs, rate=0.0).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in plain:
        assert r.pieces is None if r.text is None else "▁" in r.text or r.pieces == library.encode(r.text)
    out = SP.encode(docs, rate=0.3, check=True)
    assert out.filter("not lossless").count() == 0
    back = SP.decode(out).collect()
    assert sorted(str((r.doc_id, r.text, r.lang)) for r in back) == sorted(str((r.doc_id, r.text, r.lang)) for r in docs.collect())
    again = SP.encode(docs.repartition(5), rate=0.3, check=True)
    assert sorted(str((r.doc_id, r.pieces)) for r in again.collect()) == sorted(str((r.doc_id, r.pieces)) for r in out.collect())
    assert out.selectExpr("sum(n_pieces)").first()[0] > sum(len(r.pieces or ()) for r in plain)
    assert SP.encode(empty, check=True).count() == 0


def by_agenda(model, text, skip, base):
    """The pieces of a text by an agenda over the whole of it, as a list scanned for its best candidate each time."""
    tok = [int(model.char[ord(c)]) for c in " " + text]
    place, skipped = list(range(len(tok))), set()
    size = lambda i: (place[i + 1] if i + 1 < len(place) else len(text) + 1) - place[i]
    while True:
        found = []
        for i in range(len(tok) - 1):
            rank, into = model.pair.get((tok[i] << 20) | tok[i + 1], (None, None))
            if rank is not None and (place[i], size(i), size(i + 1)) not in skipped:
                found.append((rank, i, into))
        if not found:
            break
        _, i, into = min(found)
        if SP.drawn(base, place[i], size(i), size(i + 1)) < skip:
            skipped.add((place[i], size(i), size(i + 1)))
            continue
        tok[i] = into
        del tok[i + 1], place[i + 1]
    out = []
    for i, k in enumerate(tok):
        out += [k] if k < model.n else [int(model.byte[b]) for b in (" " + text)[place[i] : place[i] + 1].encode()]
    return out


@pytest.mark.parametrize("rate", [0.1, 0.4])
def test_sentencepiece_agendas_agree(rate):
    pytest.importorskip("sentencepiece")
    own, rng = SP.Encoder(SP.model_path("piece_bpe_32k.model"), rate, 17), random.Random(3)
    texts = ["".join(rng.choice("  theinratioxé\n▁,.'日") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += ["international " * 20, "", "understanding, of\nthe  international " * 3 + "x" * 100 + "internationalisation" * 5]
    flat, size = own.encode(texts)
    want = [by_agenda(own.model, t, own.skip, own.base(t)) if t else [] for t in texts]
    assert size.tolist() == [len(w) for w in want]
    assert flat.tolist() == [x for w in want for x in w]


def test_sentencepiece_every_occurrence_draws():
    pytest.importorskip("sentencepiece")
    own = SP.Encoder(SP.model_path("piece_bpe_32k.model"), 0.1, 17)
    word, n = " international", 3000
    flat, _ = own.encode([word[1:] + word * (n - 1)])
    bodies = [own.model.bytes[a : a + k].tobytes() for a, k in zip(own.model.start[flat], own.model.size[flat], strict=True)]
    ways = Counter(tuple(w.split(b"|")) for w in b"|".join(bodies).replace(b"| ", b"\n ").split(b"\n"))
    assert len(ways) > 10
    plain = SP.Encoder(SP.model_path("piece_bpe_32k.model"), 0.0, 17).encode([word[1:]])[0]
    merges = len(word) - len(plain)
    assert ways[tuple(own.model.bytes[a : a + k].tobytes() for a, k in zip(own.model.start[plain], own.model.size[plain], strict=True))] / n >= 0.9**merges - 0.05


def test_sentencepiece_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, True, "x")], "doc_id long, text string, pieces int, Lossless boolean, `odd, name` string")
    out = SP.encode(docs, check=True)
    assert out.columns == ["doc_id", "pieces_in", "Lossless_in", "odd, name", "pieces", "n_pieces", "lossless"]
    r = SP.decode(out.withColumnRenamed("doc_id", "Text")).first()
    assert (r.Text_in, r.pieces_in, r["odd, name"], r.text) == (1, 5, "x", "a b")


def test_importance(spark, empty):
    rng = random.Random(8)
    good = [(k, prose(rng, 80, ["river", "stone", "green", "walks", "over", "under"]), "en", "s", 0) for k in range(80)]
    junk = [(100 + k, prose(rng, 80, ["$$$", "buy", "zzz", "click", "now!!"]), "en", "s", 0) for k in range(20)]
    docs = spark.createDataFrame([*good, *junk, (None, None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(k, int(k < 100), 0) for k in [*range(0, 80, 2), *range(100, 110)]], "doc_id long, quality int, toxic int")
    out = IM.importance_sample(docs, labels, keep=0.8).collect()
    kept = [r.doc_id for r in out if r.kept]
    assert len(out) == 101
    assert len(kept) == round(0.8 * 101)
    assert sum(1 for k in kept if k is not None and k < 100) >= 79
    assert IM.importance_sample(empty, labels).count() == 0
    assert sum(r.kept for r in IM.importance_sample(docs, labels.limit(0), keep=0.5).collect()) == round(0.5 * 101)


def test_importance_weights_by_hand():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(40)] + [None, "", " \n", "word " * 50_000, "One two"]
    good = [k % 3 == 0 for k in range(len(texts))]
    bucket = lambda t: next(IM.ngram_buckets(pa.array([t])))[2].tolist()
    word = {}

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        for x in {*w, *zip(w, w[1:], strict=False)} - set(word):
            word[x] = bucket(x)[0] if isinstance(x, str) else bucket(" ".join(x))[2]
        return [word[x] for x in w] + [word[x] for x in zip(w, w[1:], strict=False)]

    own = [grams(t) for t in texts]
    raw, target = Counter(b for g in own for b in g), Counter(b for g, y in zip(own, good, strict=True) for b in (g if y else ()))
    batches = [pa.record_batch({"text": pa.array(texts[i : i + 11]), "target": pa.array(good[i : i + 11])}) for i in range(0, len(texts), 11)]
    counts = next(IM._counts(iter(batches)))
    assert {b: (n, m) for b, n, m in zip(*(counts.column(c).to_pylist() for c in ("bucket", "raw", "target")), strict=True) if n} == {b: (n, target[b]) for b, n in raw.items()}
    ratio = np.array([math.log((target[b] + 1) / (sum(target.values()) + IM.BUCKETS)) - math.log((raw[b] + 1) / (sum(raw.values()) + IM.BUCKETS)) for b in range(IM.BUCKETS)])
    out = list(IM._weights(ratio, 9)(iter([pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts), "draw": pa.array([7 * k for k in range(len(texts))])})])))
    assert [n for b in out for n in b.column("n_grams").to_pylist()] == [len(g) for g in own]
    assert [w for b in out for w in b.column("log_weight").to_pylist()] == pytest.approx([math.fsum(ratio[g]) if g else 0.0 for g in own], rel=1e-6, abs=1e-9)


def test_importance_counts_every_good_row(spark):
    n = 20_500  # "river" is good alone, in more rows than a sample of 20,000 holds
    docs = spark.range(2 * n).selectExpr("id doc_id", f"if(id < {n}, 'river', 'stone') text")
    labels = spark.range(n).selectExpr("id doc_id", "1 quality", "0 toxic")
    weight = {r.doc_id < n: r.log_weight for r in IM.importance_sample(docs, labels).collect()}
    total = lambda rows: rows + IM.BUCKETS
    assert weight[True] == pytest.approx(math.log((n + 1) / total(n)) - math.log((n + 1) / total(2 * n)), abs=1e-9)
    assert weight[False] == pytest.approx(math.log(1 / total(n)) - math.log((n + 1) / total(2 * n)), abs=1e-9)


def test_importance_shuffles_good_texts_alone(spark, monkeypatch):
    """Rows without a good label meet no join; ids of either integer type, null, repeated and without a label count once a row."""
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(2000)] + [(3, "again"), (None, "none")], "doc_id int, text string").repartition(3)
    labels = spark.createDataFrame([(k % 500, int(k % 100 < 3), 0) for k in range(1000)] + [(None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(IM, "marked", lambda rows, keys, name, f=IM.marked: seen.append(f(rows, keys, name)) or seen[-1])
    got = Counter((r.text, r.target) for r in IM.with_target(docs, labels).collect())
    assert got == Counter((r.text, r.doc_id is not None and r.doc_id < 500 and r.doc_id % 100 < 3) for r in docs.collect())
    assert seen[0].filter("_may").count() < 30


def test_kth_greatest(spark):
    rng = random.Random(0)
    values = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(500)] + [7] * 20 + [-(1 << 63), (1 << 63) - 1]
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 2, 250, len(values)):
        assert IM.kth_greatest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_kth_greatest_of_close_keys(spark):
    values = [1000 + 24 * k for k in range(200)]
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 2, 100, 200):
        assert IM.kth_greatest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_toxicity_features_by_hand():
    import pyarrow as pa

    lexicon = {"w:vorgax": 3.0, "s:blim": 2.0}
    text = "You VORGAX, not v0rgax! blimfer?! soooo f.i.n.e stone 'vorgax'"
    flags = [(w.strip("'!?,.").lower(), w) for w in text.split()]
    n = len(flags)
    words, stems, hidden = sum(c == "vorgax" for c, _ in flags), sum(c.startswith("blim") for c, _ in flags), 1
    want = {
        "n_words": math.log1p(n), "word_hits": words, "stem_hits": stems, "disguised_hits": hidden, "word_density": 100 * words / n, "stem_density": 100 * stems / n, "weight": 3.0 * 3 + 2.0,
        "weight_density": 100 * 11.0 / n, "distinct_hits": 4, "near_you": 3, "you_density": 100 / n, "capitals": 100 * sum(c.isupper() for c in text) / len(text), "exclaim": 100 * sum(c in "!?" for c in text) / len(text),
        "punctuation": 100 * sum(not c.isalnum() and c != " " for c in text) / len(text), "disguise_rate": 100 * 2 / n, "stretched_rate": 100 / n,
    }
    out = next(TX._features(lexicon, [])(iter([pa.record_batch({"text": pa.array([text, None, "", "vorgax " * 100_000])})])))
    assert {k: out.column(k)[0].as_py() for k in TX.FEATURES} == pytest.approx(want)
    assert all(out.column(k)[i].as_py() == 0 for k in TX.FEATURES for i in (1, 2))
    assert out.column("word_hits")[3].as_py() == 100_000


def test_toxicity(spark, empty):
    import zlib

    rng = random.Random(6)
    rude = ["vorgax", "blimfer", "zunkel"]
    rows, marks = [], []
    for k in range(1200):
        words = prose(rng, 60).split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(rude))
        rows.append((k, " ".join(words), "en", "s", 0))
        marks.append((k, 1, int(toxic)))
    rows += [(None, "vorgax vorgax", None, None, None), (5000, None, None, None, None), (5001, "", None, None, None)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in TX.toxicity(docs, labels).collect()}
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(1200))
    held = [k for k in range(1200) if out[k].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert sum(out[k].predicted == (k % 6 == 0) for k in held) / len(held) > 0.98
    assert out[5000].predicted == out[5001].predicted == 0
    assert TX.toxicity(empty, labels).count() == 0
    assert {r.score for r in TX.toxicity(docs.limit(5), labels.limit(0)).collect()} == {0.0}


def test_extra_columns_with_names_of_ours(spark):
    names = "tkey text_key unit rid pieces n_words score kept key window item start doc _k _rest _word _bits draw label prefix root comp place n plain distance held_out".split()
    rng = random.Random(3)
    rows = [(k, prose(rng, 40) if k else None, "en", "s", 5, *range(len(names))) for k in range(6)]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", {c} int" for c in names))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.createDataFrame([(1, rows[2][1], 1, 2)], "item_id long, text string, window int, tokens int")
    labels = spark.createDataFrame([(k, k % 2, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int, l_id int")
    calls = {
        "tokens": lambda d: TC.token_counts(d), "rules": lambda d: QR.quality_rules(d).drop("distance"), "leaks": lambda d: DC.decontaminate(d, bench), "near": lambda d: ND.near_duplicates(d).drop("comp"),
        "toxic": lambda d: TX.toxicity(d, labels), "sample": lambda d: IM.importance_sample(d, labels), "suffix": lambda d: SD.repeated_substrings(d), "rules whole": lambda d: QR.quality_rules(d, carry=True).select("doc.doc_id", "kept"),
    }
    for name, call in calls.items():
        assert sorted(map(str, call(docs).collect())) == sorted(map(str, call(plain).collect())), name


def by_stage(name, before, after):
    """What each stage must do to these rows, beside what its operator's own test shows."""
    texts = {r.doc_id: r.text for r in before}
    left = {r.doc_id: r.text for r in after}
    assert set(left) <= set(texts)
    if name == "line_dedup":
        want = {i: t for i, t, _ in by_lines(sorted(texts.items()), LD.LEAST)}
        assert left == want
        assert all(r.n_chars == len(r.text) for r in after)
    else:
        assert all(left[i] == texts[i] for i in left)
    if name == "near_dedup":
        sets = {i: shingles(t) for i, t in texts.items()}
        root = {i: i for i in sets}
        ids = sorted(sets)
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = {i: new if r == old else r for i, r in root.items()}
        assert set(left) == {i for i in ids if root[i] == i}


def test_pipeline_stages_by_hand(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        by_stage(name, before, docs.collect())
        if name == "quality_rules":
            verdict = {r.doc_id: r.kept for r in QR.quality_rules(spark.createDataFrame(before, docs.schema)).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, kept in verdict.items() if kept}
        if name == "decontamination":
            short = [(r.doc_id, r.text) for r in before if len(r.text) < 4000]
            leaks = {i for i, _ in leaks_by_hand(short[:12], bench[:15], DC.COVERAGE)}
            assert not leaks & {r.doc_id for r in docs.collect()}


def test_line_stage_carries_a_text_once(spark, monkeypatch):
    """The text of a row is not also among the columns that are carried beside it; these come back whole, in order."""
    import corpus_pipeline as P

    long = " ".join(f"word{k}" for k in range(30)) + ". "
    docs = spark.createDataFrame([(1, long + "own one", "en", "s", 9, 5), (2, long + "own two", None, "t", 9, 6), (None, None, "de", None, 0, 7)], DOCS + ", n_units int")
    seen = []
    monkeypatch.setattr(P, "dedup_lines", lambda d, f=P.dedup_lines: seen.append(d) or f(d))
    for known in (docs, docs.select("doc_id", "text", "n_chars")):
        out = P.drop_repeated_lines(spark, known, None)
        assert out.columns == known.columns and out.schema["n_chars"] == known.schema["n_chars"]
        want = {1: (1, long + "own one", "en", "s", len(long) + 7, 5), 2: (2, "own two", None, "t", 7, 6), None: (None, None, "de", None, None, 7)}
        assert {r.doc_id: tuple(r) for r in out.collect()} == {k: tuple(v[docs.columns.index(c)] for c in known.columns) for k, v in want.items()}
        assert str(seen[-1].schema).count("'text'") == 1


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "line_dedup", "decontamination", "sentencepiece"]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = documents.count()
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < n
    assert out.filter("not lossless").count() == 0
    extra = [f"{c} {t}" for c, t in documents.dtypes]
    odd = spark.createDataFrame([(1, None, None, None, None, 1, "x"), (1, None, None, None, None, 1, "x"), (None, "few words", "en", "s", 2, 1, "x")], ", ".join([*extra, "n_words long, digest string"]))
    nothing = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns
        assert stage(spark, nothing, sf_dir).count() == 0


def test_components(spark):
    from pulseline.llm.common import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (101, 103), (200, 200)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 104)} | {200: 200}


@pytest.mark.parametrize(("small", "pack", "most"), [(1 << 17, 1 << 16, 1), (0, 20, 3)])
def test_components_of_a_small_graph_take_few_tasks(spark, monkeypatch, small, pack, most):
    from pulseline.llm import common

    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (101, 103), (200, 200)]
    files, written = [], common.cut
    monkeypatch.setattr(common, "SMALL", small)
    monkeypatch.setattr(common, "PACK", pack)
    monkeypatch.setattr(common, "cut", lambda df, tag: (files.append(len((out := written(df, tag)).inputFiles())), out)[1])
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.v: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 104)} | {200: 200}
    assert max(files) <= most
