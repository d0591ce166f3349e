"""Each operator against a brute-force version on a small fixture, and on the hard inputs: nulls, empty
and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, languages, media, mixing, pages, pii, sharding, simhash, substrings, toxicity
from tidemill.llm.components import components

WORDS = [a + b for a in "ka lo mi ne pu ra st vo".split() for b in "ber din gal hos".split()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    some = [" ".join(r.choices(WORDS, k=r.randint(1, 160))) for _ in range(60)]
    passage = " ".join(r.choices(WORDS, k=50))
    out = [*some, some[3], some[3], some[3], some[7].replace(" ", "\n\t", 3), some[9] + " x", passage + " " + some[1], some[2] + " " + passage + " é日本", "ha " * 90, "ha " * 36, "", None, "  \n", "Z", "W" * 30000, " ".join(r.choices(WORDS, k=9000))]
    return list(enumerate(out)) + [(None, "no id"), (5, some[5]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", i) for i, t in texts]
    # clashing names of what the operators add
    return spark.createDataFrame(rows, "doc_id long, text string, k string, fp string, shard long").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_substrings_match_brute_force(docs, none, texts):
    for width, together in ((35, 512), (5, 2)):
        n = collections.Counter(tuple(w[i : i + width]) for _, t in texts for w in [words(t)] for i in range(len(w) - width + 1))
        want = collections.Counter()
        for d, t in texts:
            w = words(t)
            gone = [False] * len(w)
            for i in range(len(w) - width + 1):
                if n[tuple(w[i : i + width])] > 1:
                    gone[i : i + width] = [True] * width
            want[d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
        got = substrings.repeated_passages(docs, width=width, gram=min(6, width - 1), together=together).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert substrings.repeated_passages(none).count() == 0


def fingerprint(text):
    w = words(lowered(text))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components_match_brute_force(docs, none, texts):
    rows = [(d, fingerprint(t)) for d, t in texts]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = collections.Counter((d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(rows))
    got = simhash.simhash_components(docs).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({root(i) for i in range(len(rows))})
    assert simhash.simhash_components(none).count() == 0


def test_links_in_large_buckets_are_whole(spark):
    r = random.Random(1)
    center = r.getrandbits(64)
    fps = {center ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 3))) for _ in range(400)}
    fps = np.array(sorted(fps), np.uint64)
    u, v = simhash.local_stars(fps, np.zeros(len(fps), np.uint64), 2)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    comp = components(simhash.links(df, tile=64))
    pairs = {(int(a), int(b)) for a, b in zip(*simhash.bit_sliced_pairs(fps, np.zeros(len(fps)), 2).__next__())}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    assert pairs <= want and (len(want) == len(pairs) or len(fps) > 400)
    assert comp.select("component").distinct().count() == len(set(fps.tolist()) & set(v.tolist()) - set(u.tolist()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}


def test_containment_matches_brute_force(spark, docs, none, texts):
    r = random.Random(2)
    long_ = words(texts[-4][1])
    items = [(i, " ".join(long_[s : s + n])) for i, (s, n) in enumerate([(10, 20), (500, 70), (8000, 200), (30, 6), (2000, 35)])]
    items += [(10, " ".join(long_[60:75] + ["new"] + long_[75:90])), (11, "Z"), (12, None), (13, ""), (14, " ".join(r.choices(WORDS, k=30))), (0, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = collections.Counter()
    for d, t in texts:
        for i, x in items:
            a = decontaminate.shingles(x or "", 5)
            b = decontaminate.shingles(t or "", min(5, max(1, len(words(x)))), False)
            if a and len(a & b) >= 0.8 * len(a):
                found[d, i, len(a & b)] += 1
    assert sum(found.values()) >= 8
    for block in (20_000, 2):
        got = decontaminate.containment_pairs(docs, bench, block=block).collect()
        assert collections.Counter((r["doc_id"], r["item_id"], r["n_shared"]) for r in got) == found
    hit = {d for d, _, _ in found}
    many = _short_items(spark)
    assert many[0] == many[1]
    assert {r["doc_id"] for r in decontaminate.without_items(docs, bench).collect()} >= {d for d, _ in texts} - hit
    assert decontaminate.containment_pairs(none, bench).count() == 0
    assert decontaminate.containment_pairs(docs, bench.limit(0)).count() == 0


def _short_items(spark):
    """Pairs of 1000 items of 1 to 12 words inside longer texts, found and by brute force."""
    r = random.Random(21)
    vocabulary = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    items = [r.choices(vocabulary, k=1 + i % 12) for i in range(1000)]
    rows = []
    for i, x in enumerate(items):
        w = r.choices(vocabulary, k=r.randint(100, 600))
        at = r.randint(0, len(w))
        rows.append((i, " ".join(w[:at] + x + w[at:])))
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(x["doc_id"], x["item_id"], x["n_shared"], x["n_item"]) for x in decontaminate.containment_pairs(docs, bench).collect()}
    runs = collections.defaultdict(set)
    for d, t in rows:
        w = t.split()
        for k in range(1, 6):
            for p in range(len(w) - k + 1):
                runs[tuple(w[p : p + k])].add(d)
    want = set()
    for i, x in enumerate(items):
        k = min(5, len(x))
        s = {tuple(x[p : p + k]) for p in range(len(x) - k + 1)}
        for d, n in collections.Counter(d for y in s for d in runs[y]).items():
            if n >= 0.8 * len(s):
                want.add((d, i, n, len(s)))
    assert {(i, i) for i in range(1000)} <= {(d, i) for d, i, _, _ in want}
    return got, want


def test_mixing_deals_shortages_to_siblings_first(spark, none):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["en", "de", None]), f"src{r.randint(0, 5)}") for i in range(400)] + [(None, "a b", "en", None), (1, "x", "en", "src1"), (2, None, "de", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, share=0.7, max_epochs=3).collect()
    total = sum(len(words(x[1])) for x in rows)
    taken = sum(r["_tokens"] * r["_copies"] for r in got)
    assert 0.6 * total < taken <= 0.7 * total and all(1 <= r["_copies"] <= 3 and r["_tokens"] > 0 for r in got)
    whole = mixing.mix(docs, share=5.0, max_epochs=2)
    assert all(r["_copies"] == 2 for r in whole.collect()) and whole.count() == sum(bool(words(x[1])) for x in rows)
    assert mixing.repeat_copies(whole).count() == 2 * whole.count() and mixing.repeat_copies(whole).columns == docs.columns
    assert mixing.mix(none).count() == 0
    # names of the operator's own columns in the input, ids that repeat or are null: same sums
    odd = spark.createDataFrame([(None if i % 3 else 7, t, a, b, "x", 1, 2, 3, 4, "y") for i, t, a, b in rows if i is not None], "doc_id long, text string, lang string, source string, _domain string, _tokens int, _copies int, _rest int, _bucket int, _id string")
    mixed = mixing.mix(odd, share=0.7, max_epochs=3)
    assert mixed.columns == [*odd.columns, "__domain", "__tokens", "__copies"] and mixing.repeat_copies(mixed).columns == odd.columns
    assert 0.6 * total < sum(r["__tokens"] * r["__copies"] for r in mixed.collect()) <= 0.7 * total
    long_ = mixing.mix(spark.createDataFrame([(1, "w " * 300000, "en", "s"), (2, "a b", "en", "s")], docs.schema), share=1.0, max_epochs=1)
    assert sorted((r["_tokens"], r["_copies"]) for r in long_.collect()) == [(2, 1), (300000, 1)]
    _same_prefixes(spark)
    table = spark.createDataFrame([("a", 1, 10, 100), ("b", 1, 1000, 100), ("c", 2, 1000, 100)], "name string, weight long, cap long, budget long")
    assert {x["name"]: x["given"] for x in mixing.spread(table, [], "name").collect()} == {"a": 10, "b": 30, "c": 60}


def _same_prefixes(spark):
    """The cut of one leaf against a sort of all its rows, for unique, repeated and null ids."""
    r = random.Random(17)
    for ids in (lambda i: i, lambda i: i % 5, lambda i: None):
        rows = [(ids(i), " ".join(r.choices(WORDS, k=r.randint(1, 9))), "en", "s1") for i in range(5000)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), share=0.3, max_epochs=1).collect()
        total = sum(len(x[1].split()) for x in rows) * 300 // 1000
        taken = sum(x["_tokens"] for x in got)
        assert total - 9 <= taken <= total
        if ids(7) == 7:
            want, room = [], total
            for x in sorted(rows, key=lambda x: hashlib.md5(f"42:1:{x[0]}".encode()).hexdigest()):
                room -= len(x[1].split())
                if room < 0:
                    break
                want.append(x[0])
            assert sorted(x["doc_id"] for x in got) == sorted(want)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 1000, 4097):
        p = sharding.feistel(np.arange(n), n, 42)
        assert sorted(p.tolist()) == list(range(n))
        assert (sharding.feistel(np.arange(n)[::-1], n, 42) == p[::-1]).all()


def test_shards_have_no_gaps(docs, none, texts):
    got = sharding.shard_rows(docs, 7).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(got) == len(texts)
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    again = sharding.shard_rows(docs.repartition(5), 7).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.shard_rows(none, 7).count() == 0


def test_page_text(spark):
    menu = "<nav><a href=/>Home</a> <a>News</a></nav><div class='sidebar'>Side</div><div>Every page says this</div>"
    page = lambda body: f"<html><head><title>T</title><style>p{{}}</style></head><body>{menu}<article><h1>Title &amp; more</h1>{body}<aside>Ad</aside></article><div id='comments'><p>me too</p></div><footer>&copy; x</footer></body></html>"
    plain = "<p>Every page says this</p><p>own words {}</p><script>var a='<p>no</p>';</script>"
    rows = [(1, "http://a.org/x/1", page("<p>One<br>two\n three<p>four &lt; five &#233;<ul><li>item</ul>")), (2, "http://a.org/x/2", page("<p>Other</p>")), (3, "http://b.org/1", plain.format(1)), (4, "http://b.org/2", plain.format(2)), (5, None, None), (6, "http://c.org/", "just text < 3 & more"), (6, "http://c.org/", "just text < 3 & more"), (7, "::", '<a title="x>broken<p>end')]
    got = collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect())
    texts = {k[0]: k[1] for k in got}
    assert texts[1] == "Title & more\n\nOne two three\n\nfour < five é\n\nitem"
    assert texts[2] == "Title & more\n\nOther"
    assert (texts[3], texts[4], texts[5]) == ("own words 1", "own words 2", "")
    assert sum(got.values()) == len(rows) and all(n == len(t) for _, t, n in got)
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_differencing_decides_pages_without_article_markup(spark):
    """Against a plain version over known lines; with differencing off the furniture would stay."""
    r = random.Random(12)
    sites = []
    for host in ("a.org", "b.org", "c.org"):
        menu, foot = [" ".join(r.choices(WORDS, k=2)) + f" {host} {i}" for i in range(r.randint(2, 6))], [f"about {host}", f"terms {host}"]
        for i in range(40):
            own = [" ".join(r.choices(WORDS, k=r.randint(3, 30))) + f" {host}{i}.{x}" for x in range(r.randint(0, 12))]
            some = [m for m in menu if r.random() < 0.9]
            sites.append((host, f"/{r.choice('xyz')}/{i:03d}", some + own + foot))
    sites += [("d.org", "/1", ["one", "two"]), ("d.org", "/2", ["one", "two"]), ("e.org", "/", ["alone"])]
    tags = ["div", "p", "li", "td", "section", "h2", "dd"]
    rows = [(n, f"http://{h}{p}?q=1", "<body>" + "".join(f"<{t}>{x}</{t}>" for x in lines for t in [r.choice(tags)]), "x") for n, (h, p, lines) in enumerate(sites)]
    got = {x["page_id"]: x["text"] for x in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, lines string").repartition(3)).collect()}

    def lcs(a, b):
        if not a or not b:
            return []
        table = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + [a[i]] if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j], key=len)
        return table[-1][-1]

    def alike(a, b):
        parts = zip(a.split("/"), b.split("/"))
        n = 0
        for x, y in parts:
            if x != y:
                return n + next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
            n += 1000
        return n

    changed = 0
    for n, (host, path, lines) in enumerate(sites):
        order = sorted((p, m) for m, (h, p, _) in enumerate(sites) if h == host)
        at = order.index((path, n))
        near = [sites[order[x][1]] for x in (at - 1, at + 1) if 0 <= x < len(order) and sites[order[x][1]][2] != lines]
        partner = max(near, key=lambda x: alike(path, x[1]), default=None)
        shared = lcs(lines, partner[2]) if partner else []
        assert got[n] == "\n\n".join(x for x in lines if x not in shared)
        changed += got[n] != "\n\n".join(lines)
    assert changed > 100


def test_parsing_is_linear_and_takes_odd_markup():
    began = time.perf_counter()
    for tag in ("div", "b", "li", "article"):
        assert [x.text for x in pages.lines_of(f"<{tag}>" * 8000 + "x")] == ["x"]
        pages.lines_of(f"<{tag}>" * 8000 + f"</{tag}>" * 8000 + "</p>" * 8000)
    assert time.perf_counter() - began < 2
    for html, want in (
        ("<svg/>a<math />b<svg><text>no</text></svg>c", ["a b c"]), ("a<script>x", ["a"]), ("<p>a<b>b</p>c</b>d", ["ab", "cd"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
        ("<!-- <p>no</p> -->y", ["y"]), ("<p hidden>n</p><p style='display: none'>n</p>s", ["s"]), ("a&nbsp;&amp;&#x41;&bogus;", ["a &A&bogus;"]), ("", []), ("<", ["<"]), ("<p", []),
    ):
        assert [x.text for x in pages.lines_of(html)] == want, html


def test_longest_common_subsequence():
    r = random.Random(4)
    for n in (0, 1, 6, 12):
        a, b = np.array([r.randint(0, 4) for _ in range(n)]), np.array([r.randint(0, 4) for _ in range(9)])
        best = [[0] * 10 for _ in range(n + 1)]
        for i in range(n):
            for j in range(9):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert pages.common(a, b).sum() == pages.common(a, b, cells=1).sum() == best[n][9]


def test_language_filters(spark, none):
    r = random.Random(6)
    sounds = {"aa": ["bak", "tem", "ool", "rik"], "bb": ["zjo", "quy", "wex", "fph"], "cc": ["ñaé", "óur", "lló", "tré"]}
    rows = []
    for i in range(600):
        lang = r.choice(list(sounds))
        rows.append((i, " ".join("".join(r.choices(sounds[lang], k=r.randint(1, 4))) for _ in range(30)), lang))
    rows += [(600, None, "aa"), (601, "123 ... !", "bb"), (602, "", None), (603, "a", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.identify(docs, languages.fit(docs, ~held)).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang in rows[:600]]) > 0.99
    assert got[600] == got[601] == got[602] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    empty = languages.fit(none, F.lit(True))
    assert [x["lang_pred"] for x in languages.identify(docs.limit(2), empty).collect()] == ["und", "und"]


def test_media_round_trip_and_damage(spark, docs, none, texts, tmp_path):
    media.store(docs, str(tmp_path / "m"))
    got = media.media_features(media.read_media(spark, str(tmp_path / "m"), split_bytes=2000)).collect()
    want = collections.Counter()
    for d, t in texts:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter((r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by_text = {r["payload_sha256"]: (r["media_sha256"], r["feature"]) for r in got}
    assert all(by_text[r["payload_sha256"]] == (r["media_sha256"], r["feature"]) for r in got)
    archive = max((tmp_path / "m").glob("*.zip"), key=lambda p: p.stat().st_size)
    data = bytearray(archive.read_bytes())
    data[60] ^= 255
    archive.write_bytes(data)
    hurt = media.media_features(media.read_media(spark, str(tmp_path / "m"), retries=2)).collect()
    assert len(hurt) == len(texts) and sum(r["error"] is not None for r in hurt) == 1
    archive.write_bytes(data[:-40])  # no directory any more
    gone = media.media_features(media.read_media(spark, str(tmp_path / "m"), retries=2)).collect()
    assert 0 < sum(r["id"] is None and r["payload_sha256"] is None and archive.name in r["error"] for r in gone) and len(gone) < len(texts)
    two = spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string").withColumn("media", F.lit(1))
    for mode, n in (("append", 2), ("append", 4), ("overwrite", 2)):
        media.store(two, str(tmp_path / "t"), mode=mode)
        back = media.media_features(media.read_media(spark, str(tmp_path / "t"), id_type="string")).collect()
        assert collections.Counter(r["id"] for r in back) == {"a": n // 2, None: n // 2} and all(r["error"] is None for r in back)
    media.store(none, str(tmp_path / "e"))
    assert media.read_media(spark, str(tmp_path / "e")).count() == 0


def test_toxicity_finds_planted_words(spark, none):
    r = random.Random(8)
    rows, marks = [], []
    for i in range(900):
        bad = r.random() < 0.2
        w = r.choices(WORDS, k=r.randint(5, 80))
        for _ in range(r.randint(1, 6) if bad else 0):
            w.insert(r.randint(0, len(w)), r.choice(["Grumf", "snorx!", "blargy"]))
        rows.append((i, " ".join(w)))
        if i % 2:
            marks.append((i, int(bad)))
        rows[-1] += (bad,)
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.theta) > 0).all()
    out = docs.select("doc_id", toxicity.severity_column(model, docs, F.col("text")).alias("x")).collect()
    score = {x["doc_id"]: x["x"] for x in out}
    assert np.mean([(score[i]["p_toxic"] >= toxicity.REJECT) == bad for i, _, bad in rows]) > 0.99
    assert all(0 <= x["severity"] <= 3 for x in score.values()) and len(out) == len(rows) + 2
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {None, 1000} <= {x["doc_id"] for x in kept.collect()}
    assert toxicity.keep_clean(docs, labels.limit(0)).count() == docs.count() and toxicity.keep_clean(none, labels).count() == 0


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def test_personal_data_base_spans(spark, none):
    parts = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "é日 1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "007.008.009.010", "4111 1111 1111 1111", "4111-1111-1111-1112", "123 4111111111111111", "+1 (234) 567-8901", "+12", "+1.2.3 ..", "+49 30 1234567890123456", "-", " ", "\n", "@@", "a@-.-", "9" * 40, "😀"]
    r = random.Random(9)
    rows = [(i, "".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(r.randint(0, 12)))) for i in range(300)] + [(None, None), (1, ""), (2, "1" * 50000 + "a" * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_t", F.lit("clash"))
    model = pii.train(docs)
    want = collections.Counter()
    for d, t in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, t or "") if ok(m[0])]
        want[d, hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    got = pii.digest(pii.find(docs, model)).collect()
    assert collections.Counter((x["doc_id"], x["base_sha256"]) for x in got) == want
    plan = pii.digest(pii.find(docs, model))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    text = "mail a.b@c.de now"
    one = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model)
    both = one.select(pii.redact(F.lit(text), F.col("base")).alias("x")).first()["x"]
    assert both == "mail [email] now"
    assert pii.digest(pii.find(none, pii.train(none))).count() == 0


def test_personal_data_in_dense_texts(spark):
    r = random.Random(11)
    parts = ["a.b@c.de", "x (at) y (dot) org", "10.2.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (234) 567-8901", "030 1234 5678", "tel", "card", "😀é", "word word", "7"]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(n))) for i, n in enumerate([0, 1, 31, 32, 33, 64, 65, 300, 3000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    for x in pii._prepared(docs.where("doc_id < 8"), "doc_id", "text").select("_id", "_c").collect():
        t, c = text[x["_id"]], x["_c"]
        assert [(y.s, y.e, y.kind) for y in c] == sorted({(y.s, y.e, y.kind) for y in c})
        base = {(m.start(), m.end(), i) for i, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, t) if ok(m[0])}
        assert {(y.s, y.e, y.kind) for y in c if not y.proposed} == base
        for y in c:
            assert y.touch == any(s < y.e and y.s < e for s, e, _ in base)
            assert y.cue == bool(re.search(pii.CUES[pii.KINDS[y.kind]], t[max(0, y.s - 24) : y.s]))
            for code, near in ((y.before, t[max(0, y.s - 1) : y.s]), (y.after, t[y.e : y.e + 1])):
                assert code == (0 if not near else 1 if near.isspace() else 2 if near.isalpha() else 3 if near in "0123456789" else 4)
    model = pii.train(docs)
    model.bars = (-99.0,) * 4  # every proposal is a rival
    found = pii.find(docs, model)
    shown = found.join(docs, "doc_id").select("doc_id", "base", "added", pii.redact(F.col("text"), F.col("added")).alias("t")).collect()
    assert len(shown) == len(rows)
    for x in shown:
        t, out, at = text[x["doc_id"]], [], 0
        spans = sorted(x["added"], key=lambda y: y.s)
        assert all(a.e <= b.s for a, b in zip(spans, spans[1:], strict=False))
        for y in spans:
            out += [t[at : y.s], f"[{pii.KINDS[y.kind]}]"]
            at = y.e
        assert x["t"] == "".join(out) + t[at:]
