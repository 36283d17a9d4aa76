"""Small tables against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import common, decontaminate, html_text, near_dedup, packing, pii, quality, quality_rules, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, start string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in texts], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [words(rng, n) for n in (3, 4, 5, 6, 40, 80, 200)]
    near = [b.replace(" ", "  ", 2) + " tail" for b in base] + [base[5].upper(), " ".join(base[6].split()[:-3])]
    texts = base + base[3:] + near + [None, "", " \n\t ", "x" * 30000, "\n".join(["a repeated line here"] * 5), "é ü ñ " * 30]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + rows[:3]


def test_near_duplicates(spark, corpus):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, label = {d: shingles(t) for d, t in corpus}, {d: d for d, _ in corpus}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    got = near_dedup.dedup(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(d, len(s), label[d], label[d] == d) for d, s in sets.items()}
    empty = near_dedup.dedup(documents(spark, []))
    assert empty.collect() == []
    kept = near_dedup.keep(documents(spark, [*corpus, (None, "no id")]))
    assert kept.columns == documents(spark, []).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(d) for d in set(label) if label[d] == d] + ["None"])


def test_links_across_components_of_a_bucket(spark):
    """A group whose pivot is like none of the others: their links show only in the second search."""
    rng = random.Random(9)
    a = words(rng, 120).split()
    chain = [" ".join(a[i : i + 100]) for i in (0, 4, 8, 12, 16, 20)]
    got = near_dedup.dedup(documents(spark, list(enumerate(chain)))).collect()
    assert {r.component_id for r in got} == {0}


def test_large_group_of_near_copies(spark):
    """5,000 texts with one changed word each: their links, over positions that are close, make components."""
    rng = random.Random(31)
    base = [f"w{i}" for i in range(60)]
    at = [rng.randrange(60) for _ in range(5000)]
    texts = [" ".join(base[:p] + [f"own{i}"] + base[p + 1 :]) for i, p in enumerate(at)]

    def touched(p):
        return set(range(max(0, p - 4), min(55, p) + 1))

    label = {p: {p} for p in set(at)}
    for p in label:
        for q in label:
            both = 56 - len(touched(p) | touched(q))
            if 100 * both >= 75 * (112 - both) and label[p] is not label[q]:
                label[p] |= label[q]
                for r in label[q]:
                    label[r] = label[p]
    want = {}
    for i, p in enumerate(at):
        want.setdefault(id(label[p]) if any(100 * (56 - len(touched(p) | touched(q))) >= 75 * (56 + len(touched(p) | touched(q))) for q in label[p]) else -i - 1, i)
    got = near_dedup.dedup(documents(spark, list(enumerate(texts)))).collect()
    for r in got:
        p = at[r.doc_id]
        alone = -r.doc_id - 1
        assert r.component_id == want.get(alone, want.get(id(label[p])))


def test_groups_are_not_cut():
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 40, 900))
    batches = [b for b in pa.table({"k": key, "x": np.arange(900)}).to_batches(max_chunksize=7)]
    seen = []
    for t in common.whole_groups(iter(batches), 1, rows=50):
        assert not set(t.column("k").to_pylist()) & set(k for k, _ in seen)
        for a, b in common.group_ranges(t, 1):
            seen.append((t.column("k")[a].as_py(), b - a))
    assert seen == [(k, n) for k, n in sorted(Counter(key.tolist()).items())]


def test_signature_estimate_follows_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000, np.uint64)
    sets = [np.sort(pool[:2000]), np.sort(pool[300:2300]), np.sort(pool[2000:])]
    packed, _ = near_dedup.signatures(sets)
    planes = packed.view(np.uint64).reshape(3, near_dedup.BITS, -1)
    for i, want in ((1, 1700 / 2300), (2, 0.0)):
        assert abs(near_dedup.similarity(planes[0], planes[i]) - want) < 0.15


def test_repeated_passages(spark, corpus):
    rng = random.Random(2)
    passage = words(rng, 30)
    texts = [(100 + i, words(rng, 20) + passage[: 60 + i] + words(rng, rng.randint(0, 40))) for i in range(12)] + corpus + [(None, passage), (7, passage)]
    low = {}
    for d, t in texts:
        b, key = (t or "").encode(), 2**63 - 1 if d is None else d
        for i in range(len(b) - 49):
            low[b[i : i + 50]] = min(low.get(b[i : i + 50], key), key)
    want = Counter()
    for d, t in texts:
        b, key = (t or "").encode(), 2**63 - 1 if d is None else d
        mark = bytearray(len(b))
        for i in range(len(b) - 49):
            if low[b[i : i + 50]] < key:
                mark[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        want[d, len(b), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest()] += 1
    frame = documents(spark, texts)
    assert Counter(map(tuple, substring_dedup.remove_repeats(frame.repartition(3)).collect())) == want
    assert substring_dedup.remove_repeats(documents(spark, [])).collect() == []


@pytest.mark.parametrize("bits", [64, 3])
def test_index_family_answers_batches_before_it_adds_them(bits):
    """Few levels, and the smallest id of each entry so far; with keys of 3 bits all but eight entries collide and the check decides."""
    rng = np.random.default_rng(1)
    family, seen = substring_dedup.Family(), {}
    for i in range(64):
        check = rng.integers(0, 3000, 300).astype(np.uint64)
        keys = check * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
        ids = np.sort(rng.integers(i * 10, i * 10 + 10, 300))
        got = family.lowest(keys, check, ids)
        for c, d in zip(check.tolist(), ids.tolist(), strict=True):
            seen[c] = min(seen.get(c, d), d)
        assert got.tolist() == [seen[c] for c in check.tolist()]
    assert len(family.levels) <= 8 and sum(len(x[0]) for x in family.levels) == len(seen)
    k, c, first, many, place = substring_dedup.first_of(keys, check, ids)
    assert (c[place] == check).all() and (k[place] == keys).all()
    assert {int(x): int(y) for x, y in zip(c, first, strict=True)} == {x: min(ids[check == x]) for x in check.tolist()}
    low = substring_dedup.lowered(keys, check, ids, (k, c, np.full(len(k), -1)))
    assert (low == -1).all() and (substring_dedup.lowered(keys, check + np.uint64(5000), ids, (k, c, np.full(len(k), -1))) == ids).all()


def test_first_holder_hears_of_a_recurring_anchor_once():
    rng = np.random.default_rng(2)
    family, holders, told = substring_dedup.Family(), {}, Counter()
    for i in range(40):
        keys = np.unique(rng.integers(0, 2000, 60).astype(np.uint64))
        many, segs, earlier = family.recurring(keys, np.full(len(keys), i))
        for k in keys.tolist():
            holders.setdefault(k, []).append(i)
        told.update((i, k) for k in keys[many].tolist())
        told.update(zip(segs.tolist(), earlier.tolist(), strict=True))
    assert told == Counter((i, k) for k, at in holders.items() if len(at) > 1 for i in at)


def test_packing(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = [*corpus, (900, "a <|endoftext|> b"), (901, "naïve É ﬁ İ 12 don't"), (None, "no id")]
    want = Counter()
    for d, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            cut = np.array(ids[k : k + 64], "<u4").tobytes()
            want[d, k // 64, k, len(cut) // 4, zlib.crc32(cut)] += 1
    rows = packing.pack(documents(spark, texts), capacity=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(n for _, n in p) <= 64
    assert len(places) <= 1.1 * sum(r.length for r in rows) / 64 + 2
    assert packing.pack(documents(spark, []), capacity=64).collect() == []


def test_token_ids_over_all_of_unicode():
    """Words of every code point, and random texts, have the ids of texts encoded whole."""
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    t, own = tokenizers.Tokenizer.from_file(path), packing.Encoder(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and not (0x3400 <= c <= 0xD7A3 or 0x20000 <= c) or c % 97 == 0 and not 0xD800 <= c <= 0xDFFF]
    rng = random.Random(5)
    texts = ["".join(f"a{chr(c)}b {chr(c)}1" for c in points[i : i + 20]) for i in range(0, len(points), 20)]
    texts += ["".join(chr(rng.choice(points)) for _ in range(30)) for _ in range(2000)] + ["\u208f \u058b x"]
    for text, got in zip(texts, own.encode_all(texts), strict=True):
        assert got == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_rounds_over_many_ranges(spark):
    """Runs dealt over many tasks: every piece is placed once, no sequence overflows, and hardly more are opened than in one task."""
    rng = random.Random(12)
    runs = [(size, rng.randint(1, 9)) for size in range(1, 1001)]
    frame = spark.createDataFrame(runs, "size long, n long")
    opened = {}
    for a_task in (100, 10**6):
        rows = packing.plan(frame, 1000, a_task).collect()
        ranks, room = Counter(), Counter()
        for r in rows:
            for k in range(r.n):
                ranks[r.size, r.first + k] += 1
                room[r.seq + k // r.each] += r.size
        assert set(ranks.values()) == {1} and len(ranks) == sum(n for _, n in runs) and max(room.values()) <= 1000
        opened[a_task] = len(room)
    least = sum(s * n for s, n in runs) / 1000
    assert opened[10**6] <= 1.02 * least + 2 and opened[100] <= 1.05 * least + 2


def test_sweep_takes_the_smallest_gap_that_holds():
    left, gaps, placed = packing.sweep([(5, 0, 3), (9, 0, 1)], [(6, 10, 1), (11, 20, 2)])
    assert not left and {(p[0], p[3]) for p in placed} == {(9, 20), (5, 10), (5, 21)}
    assert sorted(gaps) == [(1, 10, 1), (1, 21, 1), (2, 20, 1)]


def test_personal_data(spark):
    texts = ["a@b.c_x@d.ee", "x" * 5000 + "@", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "iban DE89370400440532013000", "account DE89370400440532013001", "ssn 123-45-6789 and 123-45-6789.", "+1 (017) 555-7713 ++12",
             "card 4111 1111 1111 1111", "4111111111111112", None, "", "éé a@é.b ü a.b@c.de", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "a@b.cc " * 400]
    got = {r.doc_id: r for r in pii.report(documents(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        t, base = t or "", []
        base += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        base += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
            if 14 <= len(d) <= 19 and sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(d)) % 10 == 0:
                base.append((m.start(), 2, "card", m.end()))
        base += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        joined = ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(base))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t[:80]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(b[2] == k for b in base) for k in ("email", "ip", "card", "phone"))
    assert got[3].spans == "iban:5:27" and got[4].spans == "" and got[5].spans.startswith("ssn:4:15") and got[12].spans.startswith("secret:9:49") and got[13].spans == ""
    red = pii.redact(documents(spark, list(enumerate(texts))))
    text = {r.doc_id: r.text for r in red.collect()}
    assert red.columns == documents(spark, []).columns and text[7] == "card [CARD]" and text[9] is None and text[11] == "éé a@é.b ü [EMAIL]"
    assert pii.report(documents(spark, [])).collect() == []


def test_addresses_with_zero_octets_and_secrets_of_single_digits(spark):
    texts = ["10.0.0.1", "127.0.0.1", "0.0.0.0", "1.2.3.000", "010.0.0255.1", "10.0.0.256", "token = a1b2c3d4e5f6g7h8i9j0kx"]
    got = {r.doc_id: r for r in pii.report(documents(spark, list(enumerate(texts)))).collect()}
    assert [got[i].n_ip for i in range(6)] == [1, 1, 1, 1, 1, 0] and got[0].spans == "ip:0:8"
    assert got[6].spans == "secret:8:30"
    text = {r.doc_id: r.text for r in pii.redact(documents(spark, list(enumerate(texts)))).collect()}
    assert text[1] == "[IP]" and text[6] == "token = [SECRET]"


def test_quality_rules(spark, corpus):
    texts = [*corpus, (500, "One two three four five.\nOne two three four five.\nSix seven eight nine ten eleven."), (501, "a b c d e f g a b c d e f"), (502, "# $ % & | ### nav | home | about | contact | help | more words here"),
             (503, "Clean prose of a kind that any reader would keep.\nIt has two lines, and both of them end well.")]
    got = {r.doc_id: r for r in quality_rules.clean(documents(spark, texts)).collect()}
    for d, t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert got[503].kept and not got[502].kept and got[500].text.count("One two") == 1
    assert quality_rules.measure(documents(spark, [])).collect() == []


def test_pages(spark):
    frame = lambda i, body: (i, f"http://h.example/a/{i}?q", body)
    page = "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li>Home</ul></nav><div class='top-banner ad'>Buy</div>{}<footer>&copy; 2024</footer></body></html>"
    rows = [frame(i, page.format(f"<div>Welcome, reader</div><p>Story {i}\n is  told.<p>Its end {i} &amp; more<div>Read on</div>")) for i in range(6)]
    rows += [(10, "http://h.example/b", page.format("<article><header><h1>Title</h1></header><p>Kept &lt;b&gt; <b>bold</b><br>text<p><i>cut")), (11, None, None), (12, "x", ""), (13, "x", "a < b and <!-- never closed")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"Story {i} is told.\nIts end {i} & more" for i in range(6))
    assert got[10].text == "Title\nKept <b> bold text\ncut" and got[11].text == "" and got[12].n_chars == 0 and got[13].text == "a < b and"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_article_elements_do_not_hide_open_lines(spark):
    page = "<div>Menu of the site</div><p>Story {0} is told at some length here</p><article class='{1}'>Card {0} in words</article>"
    kept = "<div>Menu of the site</div><article class='post has-comments'>Story {0} is told at some length here</article>"
    rows = [(i, f"http://h.example/{i}", page.format(i, c)) for i, c in enumerate(("comment", "teaser-card", "card"))] + [(i, f"http://h.example/{i}", kept.format(i)) for i in (3, 4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = [f"Story {i} is told at some length here" for i in range(5)]
    assert [got[i] for i in range(5)] == [story[0], story[1], f"{story[2]}\nCard 2 in words", story[3], story[4]]


@pytest.mark.parametrize("a_task", [5, 4000])
def test_pages_against_brute_force(spark, monkeypatch, a_task):
    """Hosts of 1, 2 and 50 pages with shared open lines, a run of copies, a recrawl and a template; texts do not depend on ranges."""
    rng = random.Random(8)
    rows = []
    for host, n in (("one", 1), ("two", 2), ("fifty", 50), ("copies", 30)):
        for i in range(n):
            story = "".join(f"<p>{words(rng, 30)}</p>" for _ in range(3))
            if host == "copies" and i > 4:
                story = "<p>the same story in many places, told at some length and more than once</p>" * 3 + f"<p>{i}</p>"
            frame = f"<div>Home of {host}</div><div>Contact us</div>" if i % 3 else "<div>Contact us</div>"
            if i % 2:
                story = f"<article>{story}<p>Contact us</p></article>"
            rows.append((len(rows), f"http://{host}.example/p/{i}", f"<nav>menu</nav>{frame}{story}<div>Imprint of {host}</div>"))
    rows += [(900, rows[20][1], rows[20][2]), (901, None, None), (902, "http://empty.example/", ""), (903, rows[10][1] + "?again", rows[10][2])]

    told, classes = {}, {}
    for i, url, page in rows:
        lines, host, path, digest, _ = html_text._told(url, page)
        told[i] = digest
        if digest not in classes or path < classes[digest][1]:
            classes[digest] = (host, path, lines)
    order = sorted(classes, key=lambda d: (classes[d][0], classes[d][1], d))
    ids = {d: [html_text._line_id(t) for t, _ in classes[d][2]] for d in order}

    def shared(a, b):
        both = html_text.common(ids[a], ids[b])
        size = [len(t) if k != html_text.BOILERPLATE else 0 for t, k in classes[a][2]]
        return both, sum(x for x, s in zip(size, both, strict=True) if s) > html_text.COPY * sum(size)

    answer, offers, asks = {}, list(order), list(order)
    while asks:
        left, out = [], set()
        for d in sorted({*asks, *offers}, key=order.index):
            at = order.index(d)
            near = [[x for x in offers if order.index(x) < at][::-1][:3], [x for x in offers if order.index(x) > at][:3]]
            near = [[x for x in side if classes[x][0] == classes[d][0]] for side in near]
            if near[0] and shared(d, near[0][0])[1]:
                out.add(d)
            if d in asks:
                seen = [shared(d, side[k])[0] for k in range(3) for side in near if k < len(side) and not shared(d, side[k])[1]]
                answer[d] = seen[0] if seen else None
                if not seen and any(len(side) == 3 for side in near):
                    left.append(d)
        if not out & set(offers):
            break
        asks, offers = left, [x for x in offers if x not in out]
    monkeypatch.setattr(html_text, "PAGES_A_TASK", a_task)
    got = html_text.extract(spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, text int")).collect()
    assert len(got) == len(rows)
    for r in got:
        d = told[r.page_id]
        both = answer[d] if answer[d] is not None else [False] * len(ids[d])
        want = "\n".join(t for (t, k), s in zip(classes[d][2], both, strict=True) if k != html_text.BOILERPLATE and not (s and k == html_text.OPEN))
        assert (r.text, r.n_chars, r.n_shared) == (want, len(want), int(sum(both)))
    text = {r.page_id: r.text for r in got}
    assert text[20] == text[900] and "Contact us" in text[6] and "Imprint" not in text[6] and "Imprint of one" in text[0]


def test_class_names_of_layout_keep_their_article():
    for name in ("no-sidebar", "content with-sidebar", "has-header", "search-results", "post-tags", "related", "layout sidebar"):
        lines = html_text.parse(f'<nav>x</nav><div class="{name}"><article><p>Story</p></article></div><div class="site-footer">f</div><div id=ad-slot-2>a</div>')
        assert [t for t, k in lines if k != html_text.BOILERPLATE] == ["Story"], name
    lines = html_text.parse('<p title="hidden gem">a</p><p data-hidden-x="1">b</p><p hidden>c</p><p style="display: none">d</p><p>story of more words</p><div id="comments"><article>e</article></div><article class="comment">q</article><aside class="related"><article>t</article></aside>')
    assert [t for t, k in lines if k != html_text.BOILERPLATE] == ["a", "b", "story of more words"]


def test_common_lines_are_longest():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        chosen = [x for x, k in zip(a, html_text.common(a, b), strict=True) if k]
        rest = iter(b)
        assert len(chosen) == table[-1][-1] and all(x in rest for x in chosen)


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, words(rng, 30)) for i in range(20)]
    clean = [(100 + i, words(rng, 300)) for i in range(60)]
    exact = [(i, f"{words(rng, 100)} {t.upper()}, {words(rng, 70)}") for i, t in items[:10]]
    para = []
    for i, t in items[10:15]:
        w = t.split()
        w[3], w[11], w[17] = "zzz", "yyy", "xxx"
        para.append((i, f"{words(rng, 60)} {' '.join(w)} {words(rng, 60)}"))
    docs = documents(spark, clean + exact + para + [(1000, None), (1001, ""), exact[0]])
    bench = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [(i, i) for i in range(15)]
    assert sorted(r.doc_id for r in decontaminate.keep(docs, bench).collect()) == sorted([d for d, _ in clean] + [1000, 1001])
    assert decontaminate.leaks(documents(spark, []), bench).collect() == []


def test_leaks_of_more_items_than_the_basis_has_directions(spark):
    rng = random.Random(9)
    lexicon = [words(rng, 1) + words(rng, 1) for _ in range(6000)]
    of = lambda n: " ".join(rng.choices(lexicon, k=n))
    items = [(i, of(30)) for i in range(3000)]
    docs = [(i, f"{of(60)} {t} {of(60)}") for i, t in items[:400]] + [(10_000 + i, of(150)) for i in range(400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, docs), bench).collect()}
    assert found == {(i, i) for i in range(400)}


def test_benchmark_in_several_blocks(spark, monkeypatch):
    """A benchmark too large for one task, clashing ids and columns, repeated rows, a very long text."""
    rng = random.Random(77)
    items = [(i, words(rng, 30)) for i in range(60)] + [(3, words(rng, 30)), (5, None)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    texts = [(i, f"{words(rng, 40)} {items[i][1]} {words(rng, 40)}") for i in range(0, 60, 7)]
    texts += [texts[0], (500, " ".join(words(rng, 500) for _ in range(60)) + " " + items[11][1]), (501, words(rng, 80)), (502, None), (None, items[1][1])]
    want = {(i, i) for i in range(0, 60, 7)} | {(500, 11)}
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 2500)
    docs = documents(spark, texts)
    assert len(decontaminate.item_blocks(bench)) > 2
    found = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {r.doc_id for r in decontaminate.keep(docs, bench).collect()} == {501, 502}  # a leak without an id goes too


def test_stutters_of_long_texts():
    """A line fails by the share of words that repeat the one before them; long texts take no longer than their length."""
    lines = ["so so so so so so", "one two three four five six.", "a b", "go go"] * 3
    text = "\n".join(lines)
    row = quality_rules.judge([text.encode()])[0]
    assert b"so so" not in row["clean"] and b"one two three" in row["clean"]
    began = time.perf_counter()
    quality_rules.judge([b"\n".join(b"w w w w w%d" % i for i in range(200_000))])
    assert time.perf_counter() - began < 30


def test_basis_is_fitted_on_all_passages(spark):
    rng = random.Random(12)
    lexicon = [words(rng, 1) for _ in range(150)]
    texts = [" ".join(rng.choices(lexicon, k=rng.randint(1, 12))) for _ in range(22_000)]
    docs = spark.createDataFrame([(i if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(rng.choices(lexicon, k=20))) for i in range(8)], "item_id long, text string")
    total, seen = decontaminate.tree_sum, []
    decontaminate.tree_sum = lambda parts, tasks: seen.append(total(parts, tasks)) or seen[-1]
    try:
        r = decontaminate.retrieval(docs, bench)
    finally:
        decontaminate.tree_sum = total
    assert seen[1][-1] == 22_000
    p = decontaminate.Passages([t.encode() for t in texts])
    w = np.random.Generator(np.random.PCG64(3)).normal(0, 1, (len(r.vocabulary), min(decontaminate.RANK + decontaminate.OVERSAMPLE, len(r.vocabulary)))).astype(np.float32)
    want = np.zeros_like(w)
    r.gram(p, w, want)
    assert np.allclose(seen[1][:-1].reshape(w.shape), want, rtol=1e-3, atol=1e-3 * np.abs(want).max())


def test_classifiers_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        w = words(rng, rng.randint(20, 60)).split()
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["blasted", "cursed"])
        rows.append((i, " ".join(x + "###" for x in w) if bad else " ".join(w) + "."))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(5000, None), (5001, "")]
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, column in ((quality, 1), (toxicity, 2)):
        got = {r.doc_id: r for r in module.classify(docs, known).collect()}
        assert set(got) == {d for d, _ in rows} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
        held = [x for x in labels if got[x[0]].held_out]
        assert held and sum(got[x[0]].predicted == x[column] for x in held) >= 0.97 * len(held)
    none = toxicity.classify(docs, known.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert {r.score for r in quality.classify(docs, known.limit(0)).collect()} == {0.5}


def test_toxicity_of_a_pair_whose_parts_are_neutral(spark):
    rng = random.Random(23)
    rows, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([*words(rng, 15).split(), *["alpha"] * a, *["omega"] * b])))
        labels.append((i, int(a != b)))
    got = toxicity.classify(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 400 and sum(r.predicted == labels[r.doc_id][1] for r in held) > 0.95 * len(held)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_tables(spark, module, label):
    """Empty tables, repeated rows, repeated labels, null ids, clashing columns and a very long text."""
    known = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(3, 1, None), (None, 1, None)], f"doc_id long, {label} int, text string")
    assert module.classify(documents(spark, []), known).collect() == []
    rows = [(i, "cursed words here" if i % 2 else "plain words here.") for i in range(40)]
    rows += [(5, "cursed words here"), (None, "no id"), (100, "word " * 400_000), (101, None), (102, " ")]
    got = module.classify(documents(spark, rows), known).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert all(r.score is not None and 0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_toxic_scores_follow_the_rate_of_all_labels(spark, monkeypatch):
    rng = random.Random(14)
    labels = [(i, int(i % 9 == 0)) for i in range(3600)]
    docs = documents(spark, [(i, "cursed" if toxic and rng.random() < 0.5 else "plain") for i, toxic in labels])
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    plain = lambda: next(r.score for r in toxicity.classify(docs, known).collect() if r.doc_id == 1)
    whole = plain()
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 250)
    assert abs(plain() - whole) < 0.04


def test_isotonic_curve_rises():
    at, value = quality.pooled(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.5]))
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()


def test_pair_weighs_more_than_its_parts():
    rng = random.Random(1)
    lists, y = [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        lists.append(np.array([k for k, on in ((0, a), (1, b)) if on], np.int32))
        y.append(float(a and b))
    m = toxicity._fit(np.array([10, 20], np.int32), lists, np.array(y))
    one, other, both = (m.margin(np.zeros(len(x), np.int64), np.array(x), 1)[0] for x in ([0], [1], [0, 1]))
    assert both > 0 > max(one, other)
