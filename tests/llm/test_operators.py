"""Each operator against a plain version, and on nulls, empty, long, tied and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, html, imi, minhash, mixing, sharding, syncmers, templates, tokenfiles, toxicity
from tallyhouse.llm.wordhash import shingles, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "one two", "en", "a", 7),
    (3, "word " * 30_000, "en", "b", 150_000), (4, "  \n\t ", "en", "b", 5), (5, "日本語 text é́ <|endoftext|>", "ja", None, 9),
    (5, "日本語 text é́ <|endoftext|>", "ja", None, 9), (6, "x" * 70_000, "en", "c", 70_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------------------- 1, BPE


def test_bpe_digests_keep_one_worker_per_task(odd):
    # Two steps in a row in one task would be two workers, each with a tokenizer of its own.
    plan = bpe.digests(odd, bpe.public_path("word_bpe_49k.json"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4  # whole texts; normal forms, pieces and digests of long ones


def test_bpe_is_the_librarys(spark, odd, none):
    from tokenizers import Tokenizer

    path = bpe.public_path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    rows = odd.selectExpr("*", "1 AS no", "'x' AS ids", "'y' AS text_key")
    for piece in (bpe.PIECE_CHARS, 997):
        got = bpe.encode(rows, path, piece_chars=piece)
        assert got.columns == [*DOCS_COLUMNS, "no", "text_key", "ids"]
        for r in bpe.decode(got, path).collect():
            want = tool.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == want and r.decoded == tool.decode(want, skip_special_tokens=False)
    assert bpe.digests(none, path).count() == 0
    for piece in (bpe.PIECE_CHARS, 997):
        want = []
        for i, t, *_ in ODD:
            ids = tool.encode(t or "", add_special_tokens=False).ids
            shas = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tool.decode(ids, skip_special_tokens=False))]
            want.append((i, len(ids), *shas))
        assert sorted(map(repr, map(tuple, bpe.digests(odd, path, piece_chars=piece).collect()))) == sorted(map(repr, want))


def test_long_words_are_mended_at_every_join():
    from tokenizers import Tokenizer

    path = bpe.public_path("word_bpe_49k.json")
    tool, enc, r = Tokenizer.from_file(path), bpe.encoder(path), random.Random(4)
    for _ in range(150):
        word = "".join(r.choice(["the", "in", "a", "ing", "é", "zz", "日"]) for _ in range(r.randrange(20, 400)))
        assert enc.long_word(word, 8) == tool.encode(word, add_special_tokens=False).ids


# ---------------------------------------------------------------------------- 2, token counts


def test_separator_scan_over_any_blocks(spark, tmp_path):
    r = np.random.default_rng(3)
    for t, share in enumerate((0.02, 0.3, 0.0)):
        folder, ids = tmp_path / str(t), []
        folder.mkdir()
        for f in range(4):
            x = np.where(r.random(r.integers(0, 50)) < share, 9, r.integers(10, 99)).astype("<u2")
            x.tofile(folder / f"f{f}")
            ids += x.tolist()
        want, n = [], 0
        for i in ids:
            n = want.append((n, False)) or 0 if i == 9 else n + 1
        want += [(n, True)] if n else []
        rows = tokenfiles.counts(spark, str(folder), 9, 7).collect()
        got = [(x.n_tokens, x.open) for x in sorted(rows, key=lambda x: (x.file, x.position is None, x.position))]
        assert got == want


def test_token_counts_of_documents(spark, odd):
    path = bpe.public_path("byte_bpe_50k.tiktoken")
    enc = tokenfiles.encoding(path)
    got = tokenfiles.counted(odd, path).collect()
    want = sorted((str(i), len(enc.encode_ordinary(t or ""))) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


# ---------------------------------------------------------------------------- 3, line templates

BODY = ["alpha beta gamma delta {}", "some quite other line of text {}", "yet another one that is long {}", "and a closing sentence here {}"]


def body(r, n=4):
    return [f"{' '.join(r.choice('ka lo mi nu po re sa ti vu'.split()) + str(r.random())[2:6] for _ in range(9))}" for _ in range(n)]


def test_templates_drop_what_recurs(spark):
    r = random.Random(2)
    rows = [(i, "\n".join([*body(r), f"Page printed on monday by user{i} at office", *body(r)])) for i in range(6)]
    passage = "this passage of many words " * 12
    rows += [(10 + i, "\n".join([*body(r), passage.strip(), *body(r)])) for i in range(4)]
    copy = body(r, 20)
    rows += [(20 + i, "\n".join([*copy[:i], *body(r, 1), *copy[i + 1 :]])) for i in range(5)]
    rows += [(30, None), (31, ""), (32, "Ok."), (33, "Ok."), (34, "Ok."), (35, "only here and nowhere else\n\n"), (None, "twice is not enough x"), (36, "twice is not enough x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS ka", "1 AS leaf", "2 AS drop")
    got = {x.doc_id: x for x in templates.drop_recurring_lines(df, dropped_col="gone").collect()}
    text = dict(rows)
    for i in (*range(6), *range(10, 14)):
        assert got[i].gone == [4] and got[i].text == "\n".join([x for k, x in enumerate(text[i].split("\n")) if k != 4]), i
    for i in (*range(20, 25), *range(30, 37), None):
        assert got[i].gone == [] and got[i].text == text[i], i
    assert len(got) == len(rows) and df.columns == [c for c in templates.drop_recurring_lines(df).columns]
    assert templates.drop_recurring_lines(df.limit(0)).count() == 0


def test_passages_that_are_most_of_their_documents_go(spark):
    r = random.Random(12)
    passage = ["the %s same line of eleven words in all of them %s" % (w, w) for w in "a b c d e f g h".split()]
    for own in (12, 30, 60):
        rows = [(i, "\n".join([" ".join(str(r.random()) for _ in range(own)), *passage])) for i in range(40)]
        got = templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), dropped_col="gone").collect()
        assert all(x.gone == list(range(1, 9)) for x in got), own


# ---------------------------------------------------------------------------- 4, sharding


def test_lookup_table_is_even_and_steady(spark, odd, none):
    names = sharding.shard_names(8)
    table = sharding.lookup_table(names, 509)
    assert max(np.bincount(table)) - min(np.bincount(table)) <= 1
    fewer = sharding.lookup_table(names[:-1], 509)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 7) < 509 * 0.25
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 509)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 510)
    rows = odd.selectExpr("*", "1 AS _slot", "2 AS shard")
    for r in sharding.place(rows, "doc_id", names, 509).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == table[int(hashlib.md5(key.encode()).hexdigest()[:13], 16) % 509]
    assert sharding.place(none, "doc_id", names, 509).count() == 0


def test_shards_are_written_whole(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), "doc_id", sharding.shard_names(3), 101)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# ---------------------------------------------------------------------------- 5, MinHash


def near_rows():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows, base = [], [r.choice(vocab) for _ in range(200)]
    for i in range(60):
        w = list(base)
        for _ in range(i % 3):
            w[r.randrange(200)] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 50, 300])))) for i in range(60)]
    rows += [(200, rows[0][1]), (None, rows[70][1]), (201, None), (202, ""), (203, "a b"), (204, "a b"), (205, "word " * 9000)]
    return rows


def test_classes_join_what_is_similar(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    cls = {r.doc_id: r.class_id for r in got}
    idf = minhash.document_frequency(df)
    vec = minhash.Vectors(idf)
    texts = [(i, t or "") for i, t in rows if t]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(texts):
        for j, t in texts[:a]:
            if s == t or vec.similarity(s, t) >= minhash.SIMILARITY:
                parent[root(i)] = root(j)
    parent[201] = 202
    groups = collections.defaultdict(list)
    for i, _ in rows:
        groups[root(i)].append(i)
    for members in groups.values():
        assert {cls[i] for i in members} == {min(i for i in members if i is not None)}
    extra = df.selectExpr("*", "1 AS id", "2 AS root", "3 AS best")
    kept = minhash.one_of_each(extra)
    assert kept.columns == extra.columns and kept.count() == len(groups)
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.one_of_each(df.limit(0)).count() == 0


def test_rows_alike_in_id_and_text_leave_the_same_one(spark):
    rows = [(7, "one and the same text", s, {"k": s}) for s in ("web", "books", None, "web")] + [(None, None, "b", None), (None, "", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `odd name` map<string, string>")
    orders = [docs, docs.orderBy(F.desc("source")).coalesce(1), docs.orderBy("source").repartition(5)]
    got = [sorted(map(str, minhash.one_of_each(d).collect())) for d in orders]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2


def test_pairs_within_a_family_that_shares_a_passage(spark, monkeypatch):
    # Equal weights: all texts are alike by 0.6 to 0.7, each like its own partner by 0.8 and more only.
    monkeypatch.setattr(minhash, "document_frequency", lambda docs: np.ones(minhash.BUCKETS, np.float32))
    passage = " ".join(f"common{k}" for k in range(244))
    rows = []
    for i in range(1_000):
        own = [f"p{i}x{k}" for k in range(60)]
        for j in range(2):
            edited = own[: 60 - (20 if i % 2 else 30)] + [f"q{i}x{j}x{k}" for k in range(20 if i % 2 else 30)]
            rows.append((2 * i + j, passage + " " + " ".join(edited)))
    got = collections.defaultdict(set)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for r in minhash.near_duplicates(df).collect():
        got[r.class_id].add(r.doc_id)
    # All pairs, in one matrix product over the shingles that not all texts have.
    grams, at = {}, []
    for i, text in rows:
        w = text.split()[240:]
        at += [(i, grams.setdefault(tuple(w[k : k + 5]), len(grams))) for k in range(len(w) - 4)]
    m = np.zeros((len(rows), len(grams)), np.float32)
    m[tuple(np.array(at).T)] = 1
    both = 240 + m @ m.T
    alike = both / (2 * (240 + m.sum(axis=1)[0]) - both) >= minhash.SIMILARITY
    pairs = {frozenset((int(a), int(b))) for a, b in zip(*np.nonzero(alike), strict=True) if a != b}
    assert pairs == {frozenset((2 * i, 2 * i + 1)) for i in range(1_000)}
    found = {frozenset(x) for x in got.values() if len(x) > 1}
    # A pair may be missed only where it never shares a bucket, which is the odds of the bands.
    drawn = {bytes(r.id): r.bands for r in minhash.bands(df, np.ones(minhash.BUCKETS, np.float32)).collect()}
    key = {i: hashlib.md5(text.encode()).digest() for i, text in rows}
    met = {p for p in pairs if any(x == y for x, y in zip(*[drawn[key[i]] for i in p], strict=True))}
    assert met <= found <= pairs and len(met) > 980


def test_leading_shingles_of_similar_texts_meet():
    r = np.random.default_rng(4)
    counts = r.integers(0, 50, minhash.SLOTS)
    for _ in range(200):
        s = np.unique(r.integers(0, 1 << 62, 120).astype(np.uint64))
        w = r.choice([0.5, 1, 3], len(s)).astype(np.float32)
        a, b = r.random(len(s)) < 0.95, r.random(len(s)) < 0.95
        both = float(w[a & b].sum()) / float(w[a | b].sum())
        kept = []
        for side in (a, b):
            at, rest, total = minhash.leading(s[side], np.zeros(side.sum(), np.int64), w[side], counts)
            kept.append({int(x): (y, z) for x, y, z in zip(s[side][at], rest, total, strict=True)})
        meet = [min(kept[0][x][0], kept[1][x][0]) for x in kept[0].keys() & kept[1].keys()]
        need = minhash.SIMILARITY / (1 + minhash.SIMILARITY) * (float(w[a].sum()) + float(w[b].sum()))
        assert both < minhash.SIMILARITY or (meet and max(meet) >= need * minhash.SLACK)


def test_frequencies_of_many_documents():
    n, maps = 20_000_000, np.zeros(2 * minhash.MAPS, np.uint64)
    for a in range(0, n, 1_000_000):
        name = minhash.mixed(np.arange(a, a + 1_000_000, dtype=np.uint64))
        minhash.note(maps, np.ones(len(name), np.int64), name)
        minhash.note(maps, np.zeros(50_000, np.int64), name[:50_000])
    part, whole = minhash.counted(maps.reshape(-1, minhash.MAPS))
    assert abs(whole / n - 1) < 0.5 and abs(part / whole / 0.05 - 1) < 0.7
    assert minhash.counted(np.zeros((1, minhash.MAPS), np.uint64))[0] == 0


def test_samples_agree_as_often_as_texts_are_alike():
    r = random.Random(1)
    a = [f"w{r.randrange(10_000)}" for _ in range(400)]
    b = [x if r.random() < 0.97 else f"v{r.randrange(10_000)}" for x in a]
    idf = np.ones(minhash.BUCKETS, np.float32)
    s, o, w = minhash.weighted(*shingles(*words([" ".join(a), " ".join(b)]), 5), idf)
    starts = np.unique(o, return_index=True)[1]
    same = np.mean([len(set(minhash.samples(s, w, starts, k).tolist())) == 1 for k in range(600)])
    assert abs(same - minhash.Vectors(idf).similarity(" ".join(a), " ".join(b))) < 0.07


# ---------------------------------------------------------------------------- 6, HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu, one</a></ul></nav><div class="ad">Buy, now</div>
<div class="cookie-notice"><p>We use cookies, sir.</p></div><article><h1>Head &amp; line</h1><p>First,   one
 <b>bold</b> &copy; 2020<p>Second<br>part<ul><li>x<li>y</ul><form><input><p>Sign up</p></form>
<div class="share">Share</div></article><aside><p>Side, bar.</p></aside><div id="comments"><p>Nice, really, nice.</p></div>
<footer>&copy; foot</footer></body></html>"""


def test_article_only():
    assert html.main_text(PAGE) == "Head & line\nFirst, one bold © 2020\nSecond part\nx\ny"
    assert html.main_text(None) == html.main_text("") == html.main_text("<html><body><nav>a</nav></body>") == ""
    assert html.main_text("plain &lt;text&gt;\n here") == "plain <text> here"
    divs = '<div id="menu">a, b</div><div class="post-content"><p>' + "Long text, with commas. " * 9 + "</p><p>short</p></div>"
    assert html.main_text(divs) == ("Long text, with commas. " * 9).strip() + "\nshort"
    assert html.main_text("<p>" * 3000 + "deep" + "<div>" * 3000).endswith("deep")


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "a, b " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text")
    assert [r.text for r in html.extract(df).collect()] == [html.main_text(h) for _, _, h in rows]
    out = html.main_texts(df).collect()
    assert [(r.page_id, r.n_chars) for r in out] == [(i, len(html.main_text(h))) for i, _, h in rows]
    assert html.main_texts(df.limit(0)).count() == 0


# ---------------------------------------------------------------------------- 7, toxicity


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(800)]
    rows, labels = [], []
    for i in range(500):
        w = [r.choice(vocab) for _ in range(r.choice([8, 40, 120]))]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["idiotic", "grumpf", "zorkix" + r.choice("abcdef")])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_learned(spark, judged, odd):
    docs, labels = judged
    got = toxicity.toxicity(docs, labels).collect()
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert {r.doc_id: r.score for r in got} == again
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) >= 0.9
    model = toxicity.fit(toxicity.sample(docs, labels))
    scored = toxicity.score(odd.selectExpr("*", "'s' AS score"), model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    # Windows reach the end of a long text.
    long = " ".join(["dddddd"] * 3000)
    low, high = model.scores([long, long + " idiotic grumpf"])
    assert high > low


def test_toxicity_without_lessons(spark, odd, none, judged):
    docs, labels = judged
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert {r.predicted for r in toxicity.toxicity(docs, labels.selectExpr("doc_id", "quality", "CAST(NULL AS INT) AS toxic")).collect()} == {0}
    assert toxicity.toxicity(none, labels).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = toxicity.Network(5, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, at, mask = rng.standard_normal((6, 5)), rng.integers(0, 6, (3, 4)), np.ones((3, 4))
    mask[1, 2:] = 0
    keep: dict = {}
    net.forward(net.project(x), at, mask, keep)
    grads, _ = net.backward(x, at, mask, keep, np.ones(3))
    for name in ("f_rec", "b_in", "att", "out", "att_v", "f_bias"):
        place = tuple(0 for _ in net.w[name].shape)
        old, values = net.w[name][place], []
        for step in (1e-3, -1e-3):
            net.w[name][place] = old + step
            values.append(net.forward(net.project(x), at, mask).sum())
        net.w[name][place] = old
        assert abs((values[0] - values[1]) / 2e-3 - grads[name][place]) < 2e-2 * max(1, abs(grads[name][place])), name


# ---------------------------------------------------------------------------- 8, nearest neighbours


def test_multi_index_against_all(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1200, 12)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(2000 + i, base[50].tolist()) for i in range(20)]
    rows += [(3000, None), (3001, [0.0] * 12), (3002, [1.0, None, *[0.0] * 10]), (3003, [float("nan")] * 12), (3004, [1.0]), (None, [1.0] * 12), (3050, [1e200] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 50 = 0")
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and len(v) == 12 and np.isfinite(v).all() and any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in fine}

    def recall(**k):
        got = collections.defaultdict(list)
        for r in imi.search(df, asked, **k).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        hits = total = 0
        for q in [i for i in unit if i % 50 == 0]:
            near = sorted((-float(unit[q] @ unit[i]), i) for i in unit if i != q)[:5]
            worst = near[-1][0]
            hits += sum(-float(unit[q] @ unit[i]) <= worst + 1e-12 for i in got[q])
            total += 5
            assert len(got[q]) == 5 and q not in got[q]
        return hits / total

    assert recall(visit=1.0) == 1.0 and recall() >= 0.9
    assert imi.search(df.limit(0), asked).count() == 0 and imi.search(df, asked.limit(0)).count() == 0
    few = imi.search(df.filter("vec_id in (0, 7)"), df.filter("vec_id = 0")).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 7)]


def test_cells_come_by_rising_distance():
    rng = np.random.default_rng(2)
    books = [rng.standard_normal((5, 3)), rng.standard_normal((4, 3))]
    q = rng.standard_normal(6)
    order = imi.visited(q, books, np.ones(20, np.int64), 20)
    sums = [imi._distances(q[None, :3], books[0])[0, c // 4] + imi._distances(q[None, 3:], books[1])[0, c % 4] for c in order]
    assert sorted(order) == list(range(20)) and sums == sorted(sums)


# ---------------------------------------------------------------------------- 9, mixing


def test_targets_share_the_excess():
    assert mixing.targets({"a": 10, "b": 10}, {"a": 1, "b": 1}) == {"a": 10.0, "b": 10.0}
    got = mixing.targets({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2})
    assert got["a"] == 30 and got["b"] == 60 and got["c"] == 120
    assert mixing.targets({"a": 0, "b": 4}, {"a": 3, "b": 1}) == {"a": 0.0, "b": 4.0} and mixing.targets({}, {}) == {}


def test_flow_repeats_as_little_as_it_can():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 20.0, "b": 20.0})
    used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in [("a",), ("a", "b"), ("b",)]}
    assert used == {("a",): 10.0, ("a", "b"): 20.0, ("b",): 10.0}


def test_mix_comes_near_its_targets(spark, odd, none):
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(0, 300), "en", r.choice(["a", "b", "b", "b", None]), 0) for i in range(800)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.source_mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.source_mix(df).collect()))
    source, taken = {i: s for i, _, _, s, _ in rows}, collections.Counter()
    for x in got:
        assert x.size == len(re.findall("[^\x20\x09-\x0d]+", rows[x.doc_id][1])) and x.taken <= 3 * x.size
        taken[source[x.doc_id]] += x.taken
    goal = {source[x.doc_id]: x.target for x in got}
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 2 for s in goal)
    extra = df.selectExpr("*", "1 AS _h", "2 AS times", "3 AS u")
    assert mixing.take(extra).columns == extra.columns
    assert mixing.source_mix(odd).count() == len(ODD) and mixing.source_mix(none).count() == 0 and mixing.take(none).count() == 0


def test_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"]] * 30 + [["a", "b"]] * 30 + [["b"]] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    taken, quotas = mixing.mix(df, F.col("s"), mixing.by_rank)
    total = sum(x.size * x.times for x in taken.collect())
    assert abs(total - sum(quotas.values())) <= 20


# ---------------------------------------------------------------------------- 10, syncmers


def test_fingerprints_of_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_CHARS", 2000)
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.choice([0, 3, 40, 400])))) for i in range(60)]
    rows += [(100, None), (101, "日本" * 50), (102, "same text here, that is long"), (103, "same text here, that is long")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS part")
    got = {x.doc_id: x for x in syncmers.compared(df).collect()}
    order = sorted([(i, t or "") for i, t in rows], reverse=True)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = (syncmers.anchors([x])[0] for x in (t, edited, nxt))
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (syncmers.to_text(a), syncmers.to_text(b))
        assert (x.near_edited, x.near_next) == (syncmers.likeness(a, b), syncmers.likeness(a, c))
        assert x.near_edited == syncmers.likeness(syncmers.from_text(x.fingerprint), syncmers.from_text(x.edited_fingerprint))
    assert len(got) == len(rows) and got[102].fingerprint == got[103].fingerprint and got[103].near_next == 1.0
    ties = spark.createDataFrame([(None, "x y z"), (3, None), (3, ""), (None, "x y z")], "doc_id long, text string")
    assert syncmers.compared(ties).count() == 4 and syncmers.compared(ties.limit(0)).count() == 0
    assert [x.fingerprint for x in syncmers.fingerprints(ties.selectExpr("*", "9 AS fingerprint")).collect()][1:3] == ["", ""]


def test_syncmers_by_definition():
    r = random.Random(4)
    text = "".join(r.choice("abcd") for _ in range(300))
    from tallyhouse.llm.wordhash import mixed, powers, prefix_sums

    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    total, down = prefix_sums(codes), powers(400)[1]
    h = lambda i, n: int(mixed((total[i + n : i + n + 1] - total[i : i + 1]) * down[i : i + 1])[0])
    want = {}
    for i in range(len(text) - syncmers.K + 1):
        inner = [h(j, syncmers.S) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            want.setdefault(h(i, syncmers.K) >> 32, i)
    got = syncmers.anchors([text])[0]
    assert [tuple(x) for x in got.tolist()] == sorted(want.items())[: syncmers.KEPT]
    assert [tuple(x) for x in syncmers.anchors([text], share=1)[0].tolist()] == sorted(want.items())


def test_fingerprints_grow_with_the_text():
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefghijkl ") for _ in range(n))
    passage = some(3000)
    long, other = some(90_000) + passage + some(20_000), some(70_000) + passage + some(30_000)
    every, also = syncmers.anchors([long, other], share=1)
    kept, kept_other = syncmers.anchors([long, other])
    # The kept ones are those of the least hashes of all, about a sixteenth, with full places.
    assert [tuple(x) for x in kept.tolist()] == [tuple(x) for x in every.tolist() if x[0] < 2**28]
    assert len(kept) > 1000 and kept[:, 1].max() > 100_000
    assert syncmers.from_text(syncmers.to_text(kept)).tolist() == kept.tolist()
    # The shared passage keeps anchors in both, at one distance, beyond 2^16.
    shared, i, j = np.intersect1d(kept[:, 0], kept_other[:, 0], assume_unique=True, return_indices=True)
    assert len(shared) >= 20 and (kept[i, 1] - kept_other[j, 1] == 20_000).mean() > 0.9
    # The likeness estimates that of all anchors.
    exact = syncmers.likeness(every, also, share=1)
    assert 0 < exact < 0.03 and abs(syncmers.likeness(kept, kept_other) - exact) < 0.01
    assert syncmers.likeness(kept, kept) == 1.0 and syncmers.likeness(kept, syncmers.anchors(["short text of its own"])[0]) == 0.0


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
