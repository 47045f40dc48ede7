"""Quality rules, near-duplicates, repeats, pages, languages and the language model, against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import common, jaccard, langid, pages, quality, suffix

from .conftest import CLASH

random.seed(4)
VOCAB = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


# -------------------------------------------------------------- quality


def slow_measure(text):
    words = [w for w in _split(text) if w]
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if any(_split(x))]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(lines)


def _split(text):
    import re

    return re.split(r"[\x20\x09-\x0D]+", text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t\x1c\xa0#|", max_size=120))
def test_measures(text):
    assert quality.measure(text) == slow_measure(text)


def test_hosts_are_shrunk_and_clean_documents_kept(make):
    rows = [(i, prose(60, i), "en", "good") for i in range(60)] + [(100 + i, "### $$$ " * 40, "en", "bad") for i in range(60)] + [(200 + i, prose(60, 500 + i), "en", "bad") for i in range(20)]
    rows += [(300, "&&& " * 30 + prose(20, 9), "en", "tiny"), (301, prose(40, 11) + " " + "# " * 2, "en", "good"), (302, prose(40, 12) + " " + "# " * 2, "en", "bad"), (303, None, "en", None), (304, "", "en", None), (None, prose(30, 1), None, None)]
    docs = make(rows, **CLASH)
    stats = quality.measured(docs, "source")
    v = {r.host: r for r in quality.host_verdicts(stats, "source").collect()}
    assert v["bad"].bad and not v["good"].bad and v["tiny"].failed == 1 and v["tiny"].rate < 1 and not v["good"].rate > 0.2
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert all(got[i].kept for i in range(60)) and all(got[200 + i].kept for i in range(20))
    assert not any(got[100 + i].kept for i in range(60))
    assert got[301].kept and not got[302].kept  # the limit of a bad host is stricter
    assert got[303].n_words == 0 and got[303].base_failed and not got[303].kept
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.quality(make([])).count() == 0


# -------------------------------------------------------------- near-duplicates


def slow_classes(rows):
    sets = [(i, frozenset(_grams(t))) for i, t in rows]
    root, links = {i: i for i, _ in sets}, collections.Counter()

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[sets[a][0]] += 1
                links[sets[b][0]] += 1
                p, q = find(sets[a][0]), find(sets[b][0])
                root[max(p, q)] = min(p, q)
    return sorted((i, find(i), links[i]) for i, _ in sets)


def _grams(t):
    w = (t or "").split()
    return [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []


def near_corpus():
    rows, r = [], random.Random(8)
    for g in range(12):
        words = prose(r.randint(30, 120), 1000 + g).split()
        for c in range(r.randint(1, 25)):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            rows.append((len(rows) * 3, " ".join(w if c % 4 else words)))
    line = prose(12, 77)
    rows += [(len(rows) * 3 + i, line + " " + prose(50, 2000 + i)) for i in range(60)]
    return rows + [(9001, None), (9002, ""), (9003, "one two"), (9004, "one two"), (9005, "x"), (9006, prose(9000, 5)), (9007, prose(9000, 5))]


@pytest.mark.parametrize("how", [{}, {"limit": 16, "small": 6, "block": 8}, {"block": 3}])
def test_links_and_classes(make, how):
    rows = near_corpus()
    got = sorted(map(tuple, jaccard.join(make(rows, **CLASH), **how).collect()))
    assert got == slow_classes(rows)


def test_runs_follow_the_recall():
    assert jaccard.runs_needed(0.8, 0.9999) > jaccard.runs_needed(0.9, 0.9999) > jaccard.runs_needed(0.9, 0.9)


def test_crowded_buckets_keep_pairs(spark):
    """Lone pairs at 0.8 in buckets that all exceed `small`: 7 runs that split alike lose 4 % of them."""
    r, pairs, small = np.random.default_rng(6), 400, 64
    one = r.integers(0, 65536, (pairs, 64)).astype("<u2")
    same = r.random((pairs, 64)) < 0.8
    other = np.where(same, one, r.integers(0, 65536, (pairs, 64))).astype("<u2")
    rows = []
    for run in range(7):
        for i in np.flatnonzero(same[:, run * 7 % 64]).tolist():
            rows += [(1000 + run, 2 * i, one[i].tobytes()), (1000 + run, 2 * i + 1, other[i].tobytes())]
    links = jaccard.proposed_links(spark.createDataFrame(rows, "bucket long, node long, sketch binary"), 38, small).collect()
    assert {(x.u, x.v) for x in links} >= {(2 * i + 1, 2 * i) for i in range(pairs)}


def test_runs_cover_the_deepest_level():
    few = jaccard.runs_needed(0.8, 0.9999, 0)
    assert few < jaccard.runs_needed(0.8, 0.9999, 4) < jaccard.runs_needed(0.8, 0.9999, jaccard.deepest_level(4096, 256))
    # by simulation of the coordinates, at a recall that few draws can tell
    r, runs = np.random.default_rng(1), jaccard.runs_needed(0.8, 0.99, 5)
    same = r.random((20_000, 64)) < 0.8
    met = np.zeros(len(same), bool)
    for run in range(runs):
        kept = same[:, run * 7 % 64]
        for _ in range(5):
            at = r.integers(0, 64, (2, len(same)))
            kept = kept & (same[np.arange(len(same)), at[0]] | same[np.arange(len(same)), at[1]])
        met |= kept
    assert 1 - met.mean() < 0.012


def test_one_document_of_each_class_stays(make):
    rows = near_corpus() + [(None, "a b c d e f"), (None, "a b c d e f"), (9006, prose(9000, 5))]
    docs = make(rows, **CLASH)
    left = jaccard.representatives(docs)
    assert left.columns == docs.columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    want = {c for _, c, _ in slow_classes([r for r in rows if r[0] is not None][:-1])}
    assert ids == sorted(want)
    assert jaccard.join(make([])).count() == 0


def test_one_id_with_several_texts(make):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(1, a), (1, b), (1, b), (2, a + " x"), (3, b + " y"), (4, prose(60, 3)), (4, prose(60, 4))]
    docs = make(rows, **CLASH)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 4, 0), (4, 4, 0)]
    left = sorted((r.doc_id, r.text) for r in jaccard.representatives(docs).collect())
    assert left == sorted([(1, a), (1, b), (4, prose(60, 3)), (4, prose(60, 4))])


@pytest.mark.parametrize("size", [600, 3000])
def test_recall_in_buckets_that_split(make, size):
    """Documents made mostly of one passage, in buckets far over `small`, hide pairs at 0.8 and more: all are found."""
    r = random.Random(size)
    shared = prose(40, 99).split()
    rows, pairs = [], []
    for k in range(size // 2):
        own = [f"w{r.randrange(10**6)}" for _ in range(60)]
        one, two = shared + own, shared + own
        for _ in range(r.randint(1, 2)):
            two = [*two]
            two[r.randrange(len(two))] = f"w{r.randrange(10**6)}"
        grams = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (one, two)]
        if 5 * len(grams[0] & grams[1]) >= 4 * len(grams[0] | grams[1]):
            pairs.append(2 * k)
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    got = {x.doc_id: x.class_id for x in jaccard.join(make(rows), limit=512, small=32).collect()}
    assert len(pairs) > size // 5
    assert sum(got[i + 1] != i for i in pairs) <= len(pairs) // 100


# -------------------------------------------------------------- repeats


def slow_removal(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            if k in seen:
                gone[p : p + length] = True
            seen.add(k)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 4))
def test_suffix_array(data, letters):
    text = np.frombuffer(data, np.uint8) % letters
    b = text.tobytes()
    sa = suffix.suffix_array(text, 256)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    lcp = suffix.common_prefixes(text, sa, 300)
    for k in range(1, len(sa)):
        x, y = b[sa[k - 1] :], b[sa[k] :]
        assert lcp[k] == next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def repeat_corpus():
    r = random.Random(3)
    parts = ["".join(r.choice("abcdé ") for _ in range(r.choice([60, 120, 180, 300]))) for _ in range(12)]
    rows = [(i * 2, "".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choice("abcdefé ") for _ in range(r.randint(1, 90))) for _ in range(r.randint(0, 6)))) for i in range(100)]
    return rows + [(501, "For " * 300), (502, None), (503, ""), (504, "x" * 5000), (505, "For " * 100), (506, rows[3][1]), (-5, rows[7][1]), (507, "y" * 99)]


@pytest.mark.parametrize("hot", [{"hot_from": 10**9}, {"hot_from": 2, "look": 1, "enough": 1}, {"hot_from": 6, "look": 2, "enough": 1}])
def test_removal(make, hot):
    rows = repeat_corpus()
    got = sorted(map(tuple, suffix.removal(make(rows, **CLASH), **hot).collect()))
    assert got == sorted(slow_removal(rows))


def test_hot_marks_do_not_meet(make):
    """A passage in 400 documents, each time amid other text: its marks are found, and no task gets their contexts."""
    r = random.Random(5)
    other = lambda: "".join(r.choice("abcdefgh ") for _ in range(150))
    line = other() + other()
    docs = make([(i, other() + line + other()) for i in range(400)] + [(1000 + i, other() * 2) for i in range(50)] * 3)
    narrow = docs.select("doc_id", "text")
    hot = suffix.hot_marks(narrow, 100, 16, hot_from=100, look=2)
    assert len(hot) and suffix.hot_marks(narrow, 100, 16, hot_from=100_000).size == 0
    keys = common.dealt_keys(16)
    blocks = narrow.mapInArrow(lambda b: suffix.mark_blocks(b, 100, keys, hot), suffix.BLOCK).collect()
    marks = [common.unpack(x.block) for x in blocks if x.kind == suffix.MARKS]
    a, passage = (np.concatenate([m[k] for m in marks]) for k in ("a", "p"))
    assert not np.isin(a[passage == 0], hot).any()
    inner = collections.Counter(a[passage == 1].tolist())
    assert max(inner.values()) <= docs.rdd.getNumPartitions()  # equal passages leave a task once
    got = {x.doc_id: x.n_removed for x in suffix.removal(docs, hot_from=100, look=2).collect()}
    assert got[0] == 0 and all(got[i] >= 300 for i in range(1, 400))


def test_repeated_rows_are_one_document(make):
    t = prose(60, 1)
    got = suffix.removal(make([(1, t), (1, t), (2, t), (None, prose(40, 2))])).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in got) == [(0, False), (1, False), (1, False), (2, True)]
    assert suffix.removal(make([])).count() == 0


def test_texts_without_repeats(make):
    rows = repeat_corpus()
    docs = make(rows, **CLASH)
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    for i, n, removed, _, sha in slow_removal(rows):
        if n and n == removed:
            assert i not in got
        elif removed == 0:
            assert hashlib.sha256((got[i].text or "").encode()).hexdigest() == sha
        if i in got and got[i].text:
            assert got[i].n_chars == len(got[i].text)


# -------------------------------------------------------------- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy</div>
<article><header><h1>Big &amp;  news</h1></header><p>First <b>bo</b>ld<br>line.<p>Second&nbsp;&lt;x&gt; &#233;
<div class="newsletter">Subscribe</div><form><input value="q"><label>Search</label></form></article>
<aside>Related</aside><section class="comments"><p>Nice!</p></section><div style="display: none">secret</div><footer>&copy; site</footer></body></html>"""


def test_article_text():
    assert pages.main_text(pages.lines(PAGE), []) == "Big & news First bold line. Second <x> é"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>x</title><body><article><p>Whole</p></article>", "Whole"),
        ("<head><meta charset=utf-8><title>x</title><script>1</script><article><p>Whole</p></article>", "Whole"),
        ("<head><title>x<body><article>Whole</article>", "Whole"),
        ("<head><title>x</title>Bare text", "Bare text"),
        ("<head><title>x</title><p>One</p><header>h</header></head>", "One"),
        ("<article><p>One</p><select><option>a<option>b<p>Two</p></article>", "One Two"),
        ("<article>One <select name='s'><option>a</option></select> Two <select><option>b</select></article>", "One Two"),
        ("<article><p>One</p><object data=x><param name=a>fallback</object><p>Two</p></article>", "One fallback Two"),
        ("<article><p>One</p><object data=x><p>Two</p></article>", "One Two"),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "So x=1 holds"),
        ("<article>One <iframe src=x> Two</article>", "One Two"),
        ("<article>One <svg><title>t</title><svg><text>u</text></svg>v</svg> Two <svg/> Three</article>", "One Two Three"),
        ("<body class='has-sidebar nav-left'><article class='no-comments banner-top'><p>Whole</p></article>", "Whole"),
        ("<main id='search'><div class='search-results'><p>Found</p></div><div class='search-box'>Go</div></main>", "Found"),
        ("<article>One <noscript><p>n</p></noscript><template><p>t</p></template> Two <script>never ends", "One Two"),
    ],
)
def test_left_out_end_tags_lose_nothing(html, text):
    assert pages.main_text(pages.lines(html), []) == text


def test_differences_to_the_neighbour(spark):
    page = lambda body: f"<body><div>Welcome to us</div><div>Menu of things</div>{body}<div>All rights</div></body>"
    rows = [(1, "http://h.org/a/1", page("<p>Own one</p><p>More</p>")), (2, "http://h.org/a/2?x=1", page("<p>Other</p>")), (3, "http://other.org/a/3", page("<p>Alone</p>")), (4, "https://www.h.org/a/3", page("<p>Third</p>")), (5, None, None), (6, "", "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in pages.extract(df.coalesce(1)).collect()}
    assert got[1].text == "Own one More" and got[2].text == "Other" and got[4].text == "Third"
    assert got[3].text == "Welcome to us Menu of things Alone All rights"
    assert got[5].text == "" and got[6].n_chars == 0 and got[1].n_chars == 12
    assert pages.extract(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=10), st.lists(st.sampled_from("abcd"), max_size=10))
def test_shared_is_a_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    for bits in (None, 6):
        s = sorted(pages.shared(a, b, bits))
        rest = iter(b)
        assert len(s) == t[-1][-1] and all(any(y == a[i] for y in rest) for i in s)


def test_very_long_pages_align_in_little_memory():
    r = random.Random(1)
    a = [f"line {r.randrange(50_000)}" for _ in range(100_000)]
    b = [x if r.random() < 0.9 else "new" for x in a]
    import tracemalloc

    tracemalloc.start()
    found = pages.shared(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) >= sum(x == y for x, y in zip(a, b, strict=True)) and peak < 200 << 20


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if t[i][j] == t[i - 1][j]:
            i -= 1
        elif t[i][j] == t[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(i)
    return out


def test_a_table_of_pages_against_brute_force(spark):
    """Lines are known from how the pages are made, so nothing of the operator's reading is used."""
    r = random.Random(8)
    made = []
    for k in range(160):
        host = r.choice(["a.org", "b.com", "c.net"])
        marked = r.random() < 0.5
        own = [f"own {k} {i}" for i in range(r.randint(1, 4))]
        if r.random() < 0.3:
            own.insert(r.randrange(len(own) + 1), "quoted passage")
        strip = [f"top of {host}", *own, f"end of {host}"] if r.random() < 0.8 else own
        page = "".join(f"<p>{x}</p>" for x in strip)
        html = f"<nav>menu</nav><article>{page}</article><div>beside {k}</div>" if marked else f"<body><div>{page}</div></body>"
        path = f"/{r.choice('xyz')}/{r.randrange(30)}"
        made.append((k, host, path, marked, strip, f"https://www.{host}{path}?s={k}", html))
    want = {}
    order = sorted(made, key=lambda m: (m[1], m[2], m[0]))
    for i, (k, host, _, marked, mine, _, _) in enumerate(order):
        near = [order[j][4] for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][1] == host]
        hits = [slow_lcs(mine, other) for other in near if other != mine]
        if marked:
            hits = [h for h in hits if 2 * len(h) <= len(mine)]
            both = hits[0] & hits[1] if len(hits) == 2 else set()
            keep = [j for j in range(len(mine)) if not (both.issuperset(range(j + 1)) or both.issuperset(range(j, len(mine))))]
        else:
            keep = [j for j in range(len(mine)) if not any(j in h for h in hits)]
        want[k] = " ".join(mine[j] for j in keep)
    df = spark.createDataFrame([(m[0], m[5], m[6]) for m in made], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df.repartition(7)).collect()}
    assert got == want
    plain = {m[0]: " ".join(m[4]) for m in made}
    assert sum(got[m[0]] != plain[m[0]] for m in made if m[3]) > 5 and sum(got[m[0]] != plain[m[0]] for m in made) > 60


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pbdiv \"'=a!-&;", max_size=80))
def test_any_markup_is_read(html):
    pages.main_text(pages.lines(html), [])


# -------------------------------------------------------------- languages


def slow_grams(text):
    c = collections.Counter()
    word = ""
    for ch in text.lower() + " ":
        if ch.isalpha():
            word += ch
        elif word:
            w = f"_{word}_"
            c.update(word)
            c.update(w[i : i + 2] for i in range(len(w) - 1))
            c.update(w[i : i + 3] for i in range(len(w) - 2))
            word = ""
    return c


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abÉ1 .\nß漢", max_size=25), min_size=1, max_size=4))
def test_gram_counts(texts):
    doc, gram, n = langid.counted(texts)
    got = [collections.Counter() for _ in texts]
    for d, g, k in zip(doc.tolist(), gram.tolist(), n.tolist(), strict=True):
        cs = [x for x in (g >> 42 & 0x1FFFFF, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if x]
        got[d]["".join("_" if x == langid.EDGE else chr(x) for x in cs)] += k
    assert got == [slow_grams(t) for t in texts]


def test_profiles_and_distances_against_brute_force(make):
    """Counts, ranks (ties by the code of the gram) and out-of-place distances, all anew."""
    r = random.Random(11)
    texts = [prose(5 + 3 * i, i) if i % 3 else "".join(r.choice("éßxyz Öaé.") for _ in range(40 + i)) for i in range(60)]
    rows = [(i, t, None if i % 10 == 9 else ("bb" if i % 3 else "aa")) for i, t in enumerate(texts)]
    code = lambda g: sum((langid.EDGE if c == "_" else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    top = lambda c, n: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:n]]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = {}
    for name in ("aa", "bb"):
        total = sum((slow_grams(t) for i, t, lang in rows if lang == name and not held(i)), collections.Counter())
        known[name] = {g: place for place, g in enumerate(top(total, 400))}
    got = {r.doc_id: r for r in langid.identify(make(rows)).collect()}
    for i, t, _ in rows:
        mine = top(slow_grams(t), 300)
        d = {n: sum(min(abs(p[g] - place), 400) if g in p else 400 for place, g in enumerate(mine)) for n, p in known.items()}
        best = min(sorted(d), key=d.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 - d[best] / (400 * len(mine))) and got[i].held_out == held(i)


def test_held_out_accuracy(documents):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_undetermined(make):
    rows = [(i, prose(20, i), None if i % 2 else "xx") for i in range(20)] + [(50, None), (51, "123 !"), (52, ""), (None, "abc")]
    got = {r.doc_id: r for r in langid.identify(make(rows, **CLASH)).collect()}
    assert [got[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and got[50].score == 0.0
    assert got[1].lang_pred in ("xx", "en")
    nothing = langid.identify(make([(1, "text", None)])).collect()
    assert nothing[0].lang_pred == "und" and langid.identify(make([])).count() == 0
