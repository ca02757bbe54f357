"""The operators of the llm subpackage against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from toolspark.llm import common, components, fingerprints, gbt, html_pages, html_text, mixing, near, packing, private, quality, queries, repeats, simhash, substring_dedup, suffix_dedup, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, gram string, id string"


def make(spark, rows):
    """rows of (doc_id, text[, source]); three columns have names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    share, long = say(70), say(3000)
    out = [(i, say(rng.randint(1, 120))) for i in range(40)]
    out += [(100 + i, say(20) + " " + share + rng.choice([" ", "\n"]) + say(20)) for i in range(12)]
    out += [(200, long), (201, long), (202, long[:9000] + say(5)), (203, long), (203, long)]
    out += [(300, None), (301, ""), (302, " \n"), (303, "of " * 400), (304, "a" * 5000), (305, "a" * 700), (None, share), (306, share + " " + share)]
    return out


def spans(starts, size, n):
    mark = bytearray(n)
    for i in starts:
        mark[i : i + size] = b"\1" * size
    return mark


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_suffix_dedup(spark, texts, hot):
    raw = [(i, (t or "").encode()) for i, t in texts]
    count = collections.Counter(t[j : j + 200] for _, t in raw for j in range(len(t) - 199))
    want = []
    for i, t in raw:
        m = spans([j for j in range(len(t) - 199) if count[t[j : j + 200]] > 1], 200, len(t))
        kept = bytes(b for b, x in zip(t, m) if not x)
        want.append((i, len(t), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.dedup(make(spark, texts), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert key(map(tuple, got)) == key(want)


def test_suffix_array_is_in_order():
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [b"a" * 50, b"abab" * 12]
    array, text, _ = suffix_dedup.suffix_array(pieces, 8)
    seen = [bytes(text[i : i + 8]) for i in array]
    assert seen == sorted(seen) and len(array) == sum(max(0, len(p) - 7) for p in pieces)
    want = [0] + [next((k for k in range(8) if a[k] != b[k]), 8) for a, b in zip(seen, seen[1:])]
    assert suffix_dedup.common_prefixes(array, text, 8).tolist() == want


@pytest.mark.parametrize(("hot", "width"), [(repeats.HOT, substring_dedup.WIDTH), (3, 64)])
def test_substring_dedup(spark, texts, hot, width):
    ws = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    count = collections.Counter(tuple(w[j : j + 35]) for _, w in ws for j in range(len(w) - 34))
    want = []
    for i, w in ws:
        m = spans([j for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1], 35, len(w))
        want.append((i, len(w), sum(m), hashlib.sha256(" ".join(x for x, y in zip(w, m) if not y).encode()).hexdigest()))
    got = substring_dedup.dedup(make(spark, texts), hot=hot, width=width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert key(map(tuple, got)) == key(want)


def test_sketch_loses_nothing_and_rules_out(spark):
    rng = random.Random(8)
    grams = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    grams += grams[:200] + [0] * 50
    found = spark.createDataFrame([(g,) for g in grams], "gram long").repartition(5)
    often = {g for g, n in collections.Counter(grams).items() if n > 1}
    for width, most in ((1 << 27, 210), (256, len(grams))):
        kept = [r.gram for r in substring_dedup.estimated_repeated(found, width=width).collect()]
        assert sum(g in often for g in grams) == sum(g in often for g in kept) and len(set(kept)) <= max(most, 210)


def test_repeats_with_text_ids_and_rows_alike(spark, texts):
    rows = [*texts, *[(9000, "one row " * 60)] * 300]
    docs = make(spark, rows)
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    for dedup in (suffix_dedup.dedup, substring_dedup.dedup):
        want, got = dedup(docs).collect(), dedup(named).collect()
        assert key(map(tuple, got)) == key((None if r[0] is None else f"n{r[0]}", *r[1:]) for r in want)
        alike = [r for r in want if r.doc_id == 9000]
        assert len(alike) == 300 and len({r.n_removed for r in alike}) == 1 and alike[0].n_removed in (480, 120)


def fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 4])
def test_simhash(spark, texts, bucket):
    rows = [r for r in texts if r[0] is not None]
    fp = {i: fingerprint(t) for i, t in rows}
    ids, root = sorted(fp), {i: i for i in fp}
    for _ in ids:
        for i in ids:
            for j in ids:
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in ids):
            break
    got = simhash.near_duplicates(make(spark, rows), bucket=bucket).collect()
    assert key(map(tuple, got)) == key([(i, f"{fp[i]:016x}", root[i]) for i, _ in rows])


def test_covering_masks_miss_no_pair():
    masks, rng = simhash.covering_masks(3), random.Random(0)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not diff & m for m in masks)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tk = Tokenizer.from_file(path)
    odd = [*texts, (400, "a<|endoftext|>b   ١ 日本 ​ x y " * 300)]
    want = collections.defaultdict(list)
    for i, t in odd:
        want[i].append([*tk.encode(t or "", add_special_tokens=False).ids, 1])
    got = packing.packed(make(spark, odd), group=20_000).withColumn("crc", packing.ids_crc32("ids")).toPandas()
    assert (got.crc == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in got.ids]).all()
    for i, lists in want.items():
        g = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        assert g.length.sum() == sum(map(len, lists))
        for r in g.itertuples():
            assert any(list(r.ids) == x[r.start : r.start + r.length] and r.doc_tokens == len(x) for x in lists)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        n = s.length.sum()
        assert n == 2048 or n & (n - 1) == 0
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()


def test_pack_uses_every_token_once():
    rng = random.Random(3)
    for n in (0, 1, 5, 200):
        sizes = [rng.choice([0, 1, 7, 100, 2047, 2048, 5000]) for _ in range(n)]
        seen = collections.Counter((d, k) for s in packing.pack(sizes) for d, a, m in s for k in range(a, a + m))
        assert seen == collections.Counter((d, k) for d, m in enumerate(sizes) for k in range(m))


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 200)), rng.choice(["big"] * 6 + ["b", "é", "z"])) for i in range(400)] + [(900, None, "big"), (901, "x " * 50, None), (5, "x " * 50, "b"), (5, "x " * 50, "b")]
    docs = make(spark, rows)
    got = mixing.mixed(docs).toPandas()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    for s in order:
        g = got[got.source.isna()] if s is None else got[got.source == s]
        assert g["size"].sum() == sizes[s] == g.source_size.iloc[0]
        assert g.target.iloc[0] == pytest.approx(want[s]) and abs(g.taken.sum() - want[s]) <= 2 * mixing.BLOCK
    again = mixing.mixed(docs.repartition(3)).toPandas()
    cols = ["doc_id", "source", "size", "taken"]
    assert key(map(tuple, again[cols].astype(str).values)) == key(map(tuple, got[cols].astype(str).values))
    words = mixing.mixed_texts(docs).select("doc_id", "mixed_").toPandas()
    assert sorted(len(t.split()) for t in words.mixed_) == sorted(got.taken[got.taken > 0])


def test_targets_and_permutations():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    t = mixing.targets([1000, 1, 1], [1, 2, 3])
    assert t[1:] == [3, 3] and sum(t) == 1002
    quotas = [int(q) for q in np.random.default_rng(3).integers(0, 40, 5000)]
    counts = mixing.shard_counts(quotas, 16, 4096, 1, 20_000)
    assert counts.shape == (4, 5000) and counts.sum(0).tolist() == quotas and counts.min() == 0
    for n in (1, 2, 3, 10, 100, 1000):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 5))) == list(range(n))


def test_quality_statistics(spark, texts):
    rows = [*texts, (500, "a b\na b\n\n a b\nx # y %$\nx # y %$"), (501, "one two three four five " * 3)]
    got = quality.assess(make(spark, rows), None).select("doc_id", "quality_.*").collect()

    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = collections.Counter(g)
        cover = {j for i, x in enumerate(g) if c[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = len(lines) - len(set(lines))
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed

    assert key([(r.doc_id, *[r[c] for c in quality.BASE], r.base_failed) for r in got]) == key([(i, *brute(t)) for i, t in rows])
    assert all(r.kept == (not r.base_failed) for r in got)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.assess(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "quality_.kept").collect()
    assert sum(r.kept == bool(r.quality) for r in got) > 0.95 * len(got)


def test_trees_hold_to_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600)) > 0.6).astype(float)
    t = gbt.fit(x, y, {0: 1, 1: -1})
    assert ((t.probability(x) > 0.5) == y).mean() > 0.9
    grid = np.tile(x[:50], (20, 1))
    for j, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, j] = np.repeat(np.linspace(0, 1, 20), 50)
        assert (sign * np.diff(t.raw(g).reshape(20, 50), axis=0) >= -1e-12).all()
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).shape == (2,)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.scored(docs, chain).drop("n").withColumnRenamed("toxic", "said").join(labels.where("doc_id % 2 = 1"), "doc_id").select("toxic", "said").collect()
    hit = sum(r.said for r in got if r.toxic)
    assert hit > 0.85 * sum(r.toxic for r in got) and sum(r.said for r in got if not r.toxic) < 0.01 * len(got)
    assert np.count_nonzero(chain.earlier) == 6 and (np.array(chain.names) == ["kind_1", "kind_2", "kind_3", "toxic"]).all()


def test_toxicity_without_toxic_labels_and_odd_texts(spark):
    docs = make(spark, [*[(i, "good words and more") for i in range(30)], (90, None), (91, ""), (92, "bad " * 50_000), (92, "bad " * 50_000), (None, "bad")])
    none = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert not any(r.toxic for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect())
    some = make(spark, [(i, "good words and more") for i in range(300)] + [(i, ["awful bad", "bad nasty", "vile"][i % 3] + f" t{i}") for i in range(300, 360)])
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)] + [(5, None), (None, 1), (301, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(some, labels)
    got = {(r.doc_id, r.toxic) for r in toxicity.scored(docs, chain).collect()}
    assert got == {*((i, False) for i in range(30)), (90, False), (91, False), (92, True), (None, True)}
    assert len({(r.p_kind_1 > 0.5, r.p_kind_2 > 0.5, r.p_kind_3 > 0.5) for r in toxicity.scored(some, chain).where("doc_id >= 300").collect()}) == 3


def test_kinds_are_clusters():
    words = [[0, 1], [0, 1, 2], [0, 2], [5, 6], [5, 6], [8], [], [0]]
    row, feature = np.repeat(np.arange(8), [len(w) for w in words]), np.concatenate([np.array(w, int) for w in words])
    toxic = np.array([1, 1, 1, 1, 1, 1, 1, 0], bool)
    assert toxicity.kinds(row, feature, 8, 9, toxic).astype(int).T.tolist() == [[1, 1, 1, 0, 0, 0, 0, 0], [0, 0, 0, 1, 1, 0, 0, 0], [0, 0, 0, 0, 0, 1, 0, 0]]


def test_private(spark):
    rows = [(1, "Mail John.Doe@Example.org or john.doe@example.org, call +1 (499) 555-6503 or (499) 555-6503; card 4111 1111 1111 1111, 4111111111111111."), (2, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"### ip 8.8.8.8 DE89 3704 0044 0532 0130 00'), (3, "Mr. John Smith, Mrs Anna Smith, г-н Иван Петров"), (4, None), (5, ""), (6, "clean words, CC BY 4.0. 2024-11-12 12345"), (6, "clean words, CC BY 4.0. 2024-11-12 12345")]
    got = {r.doc_id: r for r in private.replaced(make(spark, rows)).collect()}
    e = [(x.kind, x.found, x.surrogate) for i in (1, 2, 3) for x in got[i].private_]
    by = {f: s for _, f, s in e}
    assert collections.Counter(k for k, _, _ in e) == {"email": 2, "phone": 2, "card": 2, "secret": 1, "ip": 1, "iban": 1, "name": 3}
    assert all(f != s and len(s) == len(f) for k, f, s in e if k in ("card", "secret", "iban"))
    assert by["John.Doe@Example.org"].lower() == by["john.doe@example.org"]
    assert by["+1 (499) 555-6503"] == "+1 " + by["(499) 555-6503"] and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", by["(499) 555-6503"])
    digits = by["4111111111111111"]
    assert by["4111 1111 1111 1111"].replace(" ", "") == digits
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits)) % 10 == 0
    iban = by["DE89 3704 0044 0532 0130 00"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert by["Mr. John Smith"].split()[-1] == by["Mrs Anna Smith"].split()[-1] and re.fullmatch(r"г-н [А-Я]\w+ [А-Я]\w+", by["г-н Иван Петров"])
    assert got[4].text is None and got[5].text == "" and got[6].text == rows[5][1]
    assert got[2].text.startswith('token = "') and '"###' in got[2].text


def test_private_names_are_one_whatever_the_title_and_keys_matter(spark):
    rows = [(1, "Mrs Anna Smith and Dr Anna Smith, Mr. Karl Weiss"), (2, "Prof Karl Weiss; Dr Robin Fox"), (3, "Dr. ANNA SMITH " + "x " * 3_000), (3, "Dr. ANNA SMITH " + "x " * 3_000)]
    odd = make(spark, rows).withColumns({"rid2": F.lit(1), "later": F.lit(2), "u": F.lit(3), "kind": F.lit(4), "value": F.lit(5)})
    got = private.replaced(odd, "k1").collect()
    by = {x.found: x.surrogate for r in got for x in r.private_}
    bare = lambda f: by[f].split(" ", 1)[1]
    assert bare("Mrs Anna Smith") == bare("Dr Anna Smith") == bare("Dr. ANNA SMITH").title() and bare("Mr. Karl Weiss") == bare("Prof Karl Weiss")
    assert any(bare("Mrs Anna Smith").split()[0].endswith(e) for e in private.ENDINGS["latin"]["f"]) and len({bare(f).title() for f in by}) == 3
    assert all((r.rid, r.rid2, r.later, r.u, r.kind, r.value) == ("x", 1, 2, 3, 4, 5) for r in got) and got[-1].text[14:] == got[-2].text[14:]
    again, other = ({x.found: x.surrogate for r in private.replaced(odd, k).collect() for x in r.private_} for k in ("k1", "k2"))
    assert again == by and all(other[f] != s for f, s in by.items())
    assert private.secret_key(spark) == private.secret_key(spark) and len(private.secret_key(spark)) >= 32
    with pytest.raises(ValueError):
        private.replaced(odd.withColumn("private_", F.lit(1)))


def test_private_surrogates_stay_distinct(spark):
    rows = [(i, f"10.0.0.{i} 10.0.1.{i} and 10.1.{i}.7") for i in range(1, 200)]
    found = [x for r in private.replaced(make(spark, rows)).collect() for x in r.private_]
    pairs = {(x.found, x.surrogate) for x in found}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert not {a for a, _ in pairs} & {b for _, b in pairs}


def test_private_surrogates_where_short_forms_run_out(spark):
    phones = [f"+44 {i // 100:02d} {i % 100:02d}" for i in range(6000)]
    rows = [(i, "; ".join(phones[i : i + 100])) for i in range(0, 6000, 100)]
    rows += [(7000, ", ".join(f"{c}@some.com" for c in "abcdefghijklmnopqrstuvwxyz")), (7001, ", ".join(f"192.168.{i}.{j}" for i in range(3) for j in range(256)))]
    found = [x for r in private.replaced(make(spark, rows)).collect() for x in r.private_]
    pairs = {(x.kind, x.found, x.surrogate) for x in found}
    assert len(found) == len(pairs) == 6000 + 26 + 768 and len({b for _, _, b in pairs}) == len(pairs)
    assert not {a for _, a, _ in pairs} & {b for _, _, b in pairs}
    assert all(re.fullmatch(r"\+44 \d\d \d\d+", b) for k, _, b in pairs if k == "phone")


def test_private_is_native(spark):
    plan = private.replaced(make(spark, [(1, "a@b.com")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_html_main_text(spark):
    article = "<h1>Some  title &amp; more</h1><p>First <b>bold</b> words of a paragraph, which is long enough.<br><p>Second one, with &nbsp; space &eacute;.</p>"
    page = f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>home</a></li><li><a href=/b>news</a></li></ul></nav><div class=\"ad\">Buy this thing now.</div><article>{article}</article><div class=\"comments\"><p>I liked it, said a reader.</p></div><footer>&copy; someone</footer></body></html>"
    df = spark.createDataFrame([(1, page, "u"), (2, None, "u"), (3, "", "u"), (4, "<p", "u"), (4, "<p", "u")], "page_id long, html string, text string")
    got = {r.page_id: r.text_ for r in html_text.extracted(df).collect()}
    assert got[1] == "Some title & more\n\nFirst bold words of a paragraph, which is long enough.\n\nSecond one, with space é."
    assert got[2] == got[3] == ""


def test_html_on_held_out_pages():
    model, good, all_ = html_text.train(), 0, 0
    for page in html_pages.pages(60, 4242):
        t = html_text.parse(page)
        chosen = html_text.decode(t.parent, model.probability(html_text.node_features(t)))
        assert all(chosen[t.parent[i]] for i in range(1, len(chosen)) if chosen[i])
        runs = [i for i, g in enumerate(t.tag) if g == "run"]
        good += sum(chosen[i] == t.main[i] for i in runs)
        all_ += len(runs)
    assert good > 0.97 * all_


def test_html_decoding_is_the_best_choice():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = 8
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        p = rng.random(n)
        best = max((sum(np.log(p[i]) if m >> i & 1 else np.log(1 - p[i]) for i in range(n)), m) for m in range(1 << n) if all(m >> parent[i] & 1 for i in range(1, n) if m >> i & 1))
        assert sum(1 << i for i, c in enumerate(html_text.decode(parent, p)) if c) == best[1]


@pytest.mark.parametrize("size", [16 << 20, 3000])
def test_fingerprints(spark, texts, size):
    rows = sorted({i: t or "" for i, t in texts if i is not None}.items())
    got = fingerprints.fingerprints(make(spark, rows), range_bytes=size).toPandas().sort_values("doc_id")
    assert got.doc_id.tolist() == [i for i, _ in rows]
    for (i, t), (_, n), r in zip(rows, rows[1:] + rows[:1], got.itertuples()):
        edited = fingerprints.edited(t, n)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = fingerprints.chains([t.encode(), edited.encode(), n.encode()])
        assert r.fingerprint == fingerprints.digest(*a) and r.near_edited == fingerprints.likeness(a, b) and r.near_next == fingerprints.likeness(a, c)
        assert fingerprints.from_digest(r.fingerprint)[1] == a[1] and 0 <= r.near_edited <= 1
    long = got[got.n_chars > 200]
    assert long.near_edited.median() > 0.5 > long.near_next.median()


def test_entropies():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 103, 200).astype(np.uint8)
    w = fingerprints.WINDOW
    for i, e in enumerate(fingerprints.entropies(data)):
        p = np.bincount(data[i : i + w])[97:] / w
        assert e == pytest.approx(-sum(x * np.log2(x) for x in p if x), abs=1e-4)


def plain_digest(text):
    """Operator 10's digest, window by window."""
    data, w = bytes(31) + text.encode() + bytes(31), 32
    if not text:
        return "0"
    windows = [data[i : i + w] for i in range(len(data) - w + 1)]

    def rank(x):
        counts = collections.Counter(x).values()
        e = np.log2(w) - sum(round((n * np.log2(n) - (n - 1) * (np.log2(n - 1) if n > 1 else 0)) * (1 << 20)) for m in counts for n in range(1, m + 1)) / (w * (1 << 20))
        return 1 << 15 if e < 2.4 else (1 << 15) - 1 - min(round(abs(e - 3.75) * 4096), (1 << 15) - 1)

    ranks = [rank(x) for x in windows]
    picks = collections.Counter(min(range(i, i + 32), key=lambda j: (ranks[j], j)) for i in range(len(windows) - 31))
    chosen = sorted(i for i, n in picks.items() if n >= 10 or len(picks) == 1)

    def value(x):
        h, codes = 0, [int(c) for c in common.BYTE_CODE]
        for i, c in enumerate(x):
            h += codes[c] * pow(0x9E3779B97F4A7C15, i, 1 << 64)
        return int(common.mix(np.array([h % (1 << 64)], np.uint64))[0])

    found = [value(windows[i]) for i in chosen]
    if not found:
        return None
    filters = []
    for i in range(0, len(found), 160):
        bits = [0] * 2048
        for h in found[i : i + 160]:
            for k in range(5):
                bits[h >> (11 * k) & 2047] = 1
        filters.append(bytes(int("".join(map(str, bits[j : j + 8])), 2) for j in range(0, 2048, 8)))
    return f"{len(found)}:{base64.b64encode(b''.join(filters)).decode()}"


def test_fingerprint_query_window_by_window(spark):
    rows = fingerprints.op10_fingerprints(spark, DATA).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    short = sorted((r for r in rows if r.n_chars < 3000), key=lambda r: r.doc_id)[:60]
    plain = [(r, plain_digest(docs[r.doc_id])) for r in short]
    assert len(plain) > 40 and all(r.fingerprint == p for r, p in plain if p is not None) and sum(p is not None for _, p in plain) > 40


def test_frequent_ids_are_spread_over_ranges(spark):
    rows = [(None, f"no id {i} " * 40) for i in range(60)] + [(5, f"five {i} " * 40) for i in range(60)] + [(i, f"row {i} " * 40) for i in range(100, 140)] + [(2**60 + 1, "far"), (2**60, "near")]
    r = fingerprints.Ranges([5, 5, 5, 120], 3)
    ids, rid = np.array([1, 5, 5, 6, 119, 120, 2**60], np.int64), np.array([0, -(2**62), 2**63 - 1, 0, 0, 0, 0], np.int64)
    assert r.of(ids, np.zeros(7, bool), rid).tolist() == [3, 4, 6, 7, 7, 8, 8] and r.of(ids[:1], np.ones(1, bool), rid[:1]).tolist() == [1]
    got = fingerprints.fingerprints(make(spark, rows), range_bytes=2000).collect()
    whole = fingerprints.fingerprints(make(spark, rows)).collect()
    assert key(map(tuple, got)) == key(map(tuple, whole)) and len(got) == len(rows)


def test_html_query_against_the_article_elements(spark):
    def plain(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        return "\n\n".join(x for x in parts if x)

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = html_text.op9_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: r.text for r in got} == {i: plain(p) for i, p in pages.items()} and all(r.n_chars == len(r.text) for r in got)


def test_html_odd_pages_in_linear_time(spark):
    began = time.time()
    for page in ("<a " * 350_000, "<option>" * 60_000, "<a '>'" * 100_000, "<div>" * 50_000 + "x", "<p><div>" * 30_000, "<svg>" * 60_000, "<!--" * 200_000):
        html_text.parse(page)
    assert time.time() - began < 20
    deep = "<article><p>An article of some words that go on for a while, and on.</p></article><div class=sidebar>" + "<div>" * 450 + "in the side" + "</div>" * 450 + "side still</div>"
    odd = ["<svg>" + deep, "<noscript>" + deep, deep + "<a href='x", deep + "<p", deep.replace("of some", "of <math><mi>x</mi></math> some")]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate([deep, *odd])], "page_id long, html string, rid string")
    got = [r.text_ for r in html_text.extracted(df).orderBy("page_id").collect()]
    assert got[:5] == ["An article of some words that go on for a while, and on."] * 5 and "of x some" in got[5]
    with pytest.raises(ValueError):
        html_text.extracted(df.withColumn("text_", F.lit(1)))
    assert html_text.extracted(df.where("page_id < 0")).count() == 0


def test_private_query_against_a_plain_reading(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in private.op2_private(spark, DATA).collect()}
    full = {r.doc_id: r.private_ for r in private.replaced(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    simple = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|\b[0-9a-f]{40}\b")
    made = {}
    assert got.keys() == docs.keys() and sum(len(v) for v in full.values()) > 20
    for i, text in docs.items():
        out, at = [], 0
        for e in full[i]:
            a = text.index(e.found, at)
            out += [text[at:a], e.surrogate]
            at = a + len(e.found)
            made.setdefault((e.kind, e.found), set()).add(e.surrogate)
        assert got[i].text == "".join([*out, text[at:]]) and got[i].n_entities == len(full[i]) and list(got[i].surrogates) == [e.surrogate for e in full[i]]
        numbers = [m for m in simple.findall(text) if m.replace(".", "").isdigit()]
        assert not [m for m in numbers if all(int(o) <= 255 for o in m.split(".")) and m in got[i].text]
        assert not [m for m in simple.findall(text) if m not in numbers and m in got[i].text]
    assert all(len(v) == 1 for v in made.values())


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES)))
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        db.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want, got = db.execute(queries.ORACLES[name]).fetchdf(), queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)
    assert key(map(tuple, want[cols].astype(str).values)) == key(map(tuple, got[cols].astype(str).values))


def test_quality_lines_that_sums_of_powers_confuse(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    got = quality.assess(make(spark, [(1, f"{a}\n{b}"), (2, f"{a}\n{a}"), (3, None)]), None).select("doc_id", "quality_.n_dup_lines").collect()
    assert {r.doc_id: r.n_dup_lines for r in got} == {1: 0, 2: 1, 3: 0}
    with pytest.raises(ValueError):
        quality.assess(make(spark, [(1, "x")]).withColumn("quality_", F.lit(1)), None)


def test_mixing_of_small_sources_and_clashing_columns(spark):
    rows = [(i, "w " * 20, "big") for i in range(500)] + [(900, "a b c d e", "tiny"), (901, "x y", None), (902, "", "none"), (903, None, "none")]
    docs = make(spark, rows).withColumns({"row": F.lit("r"), "turn": F.lit(2), "src": F.lit(3), "block": F.lit(4)})
    got = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in got if r.source != "big") and {r.source: r.taken for r in got}["none"] == 0
    texts_ = mixing.mixed_texts(docs)
    assert texts_.columns == [*docs.columns, "mixed_"] and {(r.row, r.turn, r.src, r.block) for r in texts_.collect()} == {("r", 2, 3, 4)}
    with pytest.raises(ValueError):
        mixing.mixed_texts(docs.withColumn("mixed_", F.lit(1)))


def test_mixing_sends_no_table_of_blocks_through_the_driver(spark):
    docs = make(spark, [(i, " ".join(f"w{i}_{j}" for j in range(400)), f"s{i % 3}") for i in range(30)])
    for words in (mixing.mixed(docs), mixing.mixed_texts(docs)):
        assert words.collect()
        joins = re.findall(r"(\w+Join) \[src#\d+, block#\d+L?\]", words._jdf.queryExecution().executedPlan().toString())
        assert joins and set(joins) == {"SortMergeJoin"}


def test_pipeline_over_an_empty_table_and_null_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert corpus_pipeline.quality_rules(spark, docs.limit(3).withColumn("text", F.lit(None).cast("string")), DATA).count() == 0
    now = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, DATA)
        assert not out.collect()
        now = spark.createDataFrame([], out.schema)


def test_empty_tables(spark):
    docs = make(spark, [(1, "x")]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert suffix_dedup.dedup(docs).count() == substring_dedup.dedup(docs).count() == simhash.near_duplicates(docs).count() == 0
    assert packing.packed(docs).count() == mixing.mixed(docs).count() == mixing.mixed_texts(docs).count() == private.replaced(docs).count() == fingerprints.fingerprints(docs).count() == 0
    assert quality.assess(docs, quality.fit(docs, labels)).count() == toxicity.scored(docs, toxicity.fit(docs, labels)).count() == 0
    one = make(spark, [(1, "word " * 50)])
    assert quality.assess(one, quality.fit(one, labels)).count() == 1 and not toxicity.scored(one, toxicity.fit(one, labels)).first().toxic
    assert fingerprints.fingerprints(one).first().near_next == 1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, DATA)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.schema.names == docs.schema.names
            rows = out.collect()
            now = spark.createDataFrame(rows, out.schema)
            if name == "quality_rules":
                assert 0 < len(rows) < docs.count()
            elif name == "simhash_near_dedup":
                fps = [fingerprint(r.text) for r in rows]
                assert all((a ^ b).bit_count() > 3 for k, a in enumerate(fps) for b in fps[k + 1 :])
            elif name == "private_data":
                assert not re.search(r"@mail\d", " ".join(r.text for r in rows))
    pieces = out.toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in now.select("doc_id").collect()}
    assert sorted(map(tuple, pieces[["doc_id", "start", "length"]].values)) == sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "start", "length").collect())


def test_near_dedup_stage_keeps_null_ids(spark):
    docs = make(spark, [(None, "alpha beta gamma delta"), (None, "one two three four five"), (2, "alpha beta gamma delta"), (3, "q w e r t y"), (3, "q w e r t y")]).select("doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.near_dedup(spark, docs, DATA).collect()
    assert key((r.doc_id, r.text) for r in got) == key([(2, "alpha beta gamma delta"), (None, "one two three four five"), (3, "q w e r t y")])
    assert got[0].asDict().keys() == set(docs.columns) and docs.select(F.max("doc_id")).first()[0] == 3


def test_near_dedup_stage_finds_all_pairs_of_similarity(spark):
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, line = [], say(30)
    for g in range(40):
        base = say(rng.randint(8, 200))
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = say(1)[0].upper()
            rows.append((len(rows), " ".join(copy + line * (g % 2))))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", " ", None, "a b", "A  b", "a b c"])]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, t in rows for w in [(t or "").lower().split()]}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {i: top(i) for i in sets}
    for bucket, tile in ((near.BUCKET, near.TILE), (1, near.TILE), (1, 3)):
        assert {r.doc_id: r.component_id for r in near.near_duplicates(make(spark, rows), bucket=bucket, tile=tile).collect()} == want
    docs = make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()} == set(want.values())


def test_private_long_and_plain_secrets_and_long_names(spark):
    rng = random.Random(4)
    run = lambda n, of="abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(rng.choice(of) for _ in range(n))
    jwt, late = run(300) + "." + run(500) + "." + run(101), "x" * 100 + "7abc"
    keys = ["sk-" + run(120), "ghp_" + run(200), "xoxb-" + run(300), run(400, "0123456789abcdef"), "sk-" + run(30, "abcdef")]
    rows = [(1, f"access_token: {jwt} end"), (2, f"token = {late}"), (3, 'token = "correct-horse-battery" or'), (4, "password: 'open!sesame'"), (5, 'password = "********" and token = required')]
    rows += [(10 + i, f"key {k} end") for i, k in enumerate(keys)] + [(20, "Mrs Anna Maria Smith left; Mr. Jean Luc Marc Dupont"), (21, "Dr " + "X" + "y" * 40)]
    got = {r.doc_id: r for r in private.replaced(make(spark, rows)).collect()}
    assert re.fullmatch(r"access_token: [^ ]{903} end", got[1].text) and not any(jwt[i : i + 12] in got[1].text for i in range(0, 890, 7))
    assert "7abc" not in got[2].text and got[5].text == rows[4][1] and not got[5].private_
    assert re.fullmatch(r'token = "[a-z]{7}-[a-z]{5}-[a-z]{7}" or', got[3].text) and "horse" not in got[3].text
    assert re.fullmatch(r"password: '[a-z]{4}![a-z]{6}'", got[4].text) and "sesame" not in got[4].text
    for i, k in enumerate(keys):
        assert len(got[10 + i].text) == len(k) + 8 and k[-12:] not in got[10 + i].text and [x.kind for x in got[10 + i].private_] == ["secret"]
    assert re.fullmatch(r"Mrs \w+ \w+ \w+ left; Mr\. \w+ \w+ \w+ \w+", got[20].text) and not re.search("Anna|Maria|Smith|Jean|Luc|Marc|Dupont|y{9}", got[20].text + got[21].text)


def test_fingerprints_of_plain_texts_tell_them_apart():
    rng = random.Random(6)
    texts = ["", "a", "hello world", "hello there", "Not Found", "".join(rng.choice("ACGT") for _ in range(610)), "".join(rng.choice("ACGT") for _ in range(610)), "ha " * 300, "0 1 0 2\n" * 90, "-" * 500]
    got = fingerprints.chains([t.encode() for t in texts])
    assert [fingerprints.digest(*c) == "0" for c in got] == [True] + [False] * 9
    assert len({fingerprints.digest(*c) for c in got}) == len(texts)
    assert all(fingerprints.likeness(a, b) < 0.9 for i, a in enumerate(got) for b in got[:i]) and all(fingerprints.likeness(a, a) == 1 for a in got)
    a, b = fingerprints.chains([texts[5].encode(), (texts[5][:450] + texts[6][:160]).encode()])
    assert fingerprints.likeness(a, b) > 0.4 > fingerprints.likeness(*got[5:7])
