"""Chat formatting, importance resampling and the filter audit against plain versions."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import audit, chat, resample

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, source string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ 11, chat formatting

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "/", " ok ", "\n", "<\\s>", "[\\\\/INST]", "é", "s>", "SYS>>", ""]


def conversations():
    r = random.Random(5)
    roles = ["user", "assistant", "system", None, "", "tool", "<s>x[INST]", "a\\b"]
    rows = [(c, t, r.choice(roles), "".join(r.choice(BITS) for _ in range(r.randrange(12)))) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t} <s>" if t % 7 == 0 else f"turn {t}") for t in range(300)]
    rows += [(101, None, "user", None), (101, None, None, None), (101, 3, "assistant", ""), (101, 3, "assistant", ""), (101, -5, "user", "first")]
    rows += [(None, 0, "user", "x" * 200_000), (None, 1, "assistant", "</s>" * 5_000), (102, 0, "assistant", "<" * 3_000 + "</s>")]
    return rows


def in_order(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: sorted(v) for c, v in by.items()}


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame(conversations(), TURNS).selectExpr("*", "1 AS t", "'x' AS block", "2 AS turns")


def test_chat_reads_back_what_was_said(chats):
    for block in (chat.BLOCK_TURNS, 1, 7):
        got = {r.conv_id: r for r in chat.digests(chat.formatted(chats, block_turns=block)).collect()}
        want = in_order(conversations())
        assert got.keys() == want.keys()
        for c, turns in want.items():
            loss = "".join(t[3] for t in turns if t[2] == "assistant")
            assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss), c
            assert got[c].turns_sha256 == sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), c


def plain_read(text):
    """The grammar again, with a scanner instead of expressions."""
    marks = re.compile(r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>")
    turns, at = [], 0

    def undo(s):
        s = re.sub(r"<(\\*)\\(/?s>|</?SYS>>)", r"<\1\2", s)
        return re.sub(r"\[(\\*)\\(/?INST\])", r"[\1\2", s)

    while at < len(text):
        found, parts = [], []
        while not found or found[-1] not in ("[/INST]", "</s>", "<</SYS>>"):
            m = marks.search(text, at)
            parts.append(text[at : m.start()])
            found.append(m.group())
            at = m.end()
        assert parts[0] == ""
        kind = " ".join(found)
        known = {"[INST] [/INST]": "user", "<s> </s>": "assistant", "<<SYS>> <</SYS>>": "system"}
        turns.append((known[kind], undo(parts[1])) if kind in known else (undo(parts[1]), undo(parts[2])))
        assert kind in known or kind == "<<SYS>> [INST] [/INST]"
    return turns


def test_chat_blocks_spans_and_escapes(chats):
    said = collections.defaultdict(list)
    for r in chat.formatted(chats).collect():
        said[r.conv_id].append((r.block is not None, r.block or 0, r))
    for c, turns in in_order(conversations()).items():
        blocks = [r for *_, r in sorted(said[c], key=lambda x: x[:2])]
        assert [t for r in blocks for t in plain_read(r.formatted)] == [t[2:] for t in turns], c
        masked = [r.formatted[s.start : s.start + s.length] for r in blocks for s in r.spans]
        assert [re.sub(r"\[(\\*)\\(/?INST\])", r"[\1\2", re.sub(r"<(\\*)\\(/?s>|</?SYS>>)", r"<\1\2", m)) for m in masked] == [t[3] for t in turns if t[2] == "assistant"]
        # Only contents that conflict are escaped.
        assert [e for r in blocks for e in r.escapes] == [bool(re.search(r"<\\*(/?s>|</?SYS>>)|\[\\*/?INST\]", t[3] + "\n" + (t[2] if t[2] not in ("user", "assistant", "system") else ""))) for t in turns]


def test_chat_of_nothing_and_the_probe(spark, chats):
    assert chat.digests(chat.formatted(chats.limit(0))).count() == 0
    r = chat.digests(chat.formatted(chat.with_probe(chats.limit(0)))).first()
    text = chat.PROBE
    assert (r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) == (-1, 2, len(text), sha(text))
    assert r.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n") and r.formatted_chars == 2 * (len(text) + 3) + 13 + 7


def test_reading_refuses_what_the_grammar_lacks(spark):
    for text in ("[INST]a", "<s>a[INST]b</s>", "x<s>a</s>", "<s>a</s>x", "[/INST]", "<<SYS>>r[INST]a</s>"):
        turns = spark.range(1).select(chat.read(chat.F.lit(text)).alias("t")).first().t
        assert None in turns, text


def test_chat_plan_has_no_python(spark, chats):
    plan = chat.digests(chat.formatted(chat.with_probe(chats)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------ 12, importance resampling


def plain_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_runs(text, longest):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_draw(docs, goal, longest=1, percent=10, least=20, seed=2024, n=10_000):
    def counts(texts):
        return collections.Counter(zlib.crc32(f.encode()) % n for t in texts for f in plain_runs(t, longest))

    c, t = counts(x[1] for x in docs), counts(goal)
    s_all, t_all = float(sum(c.values())), float(sum(t.values()))
    out = []
    for i, text, *_ in docs:
        f = [zlib.crc32(x.encode()) % n for x in plain_runs(text, longest)]
        g = [math.floor(1000.0 * math.log(((t[b] + 1.0) * (s_all + n)) / ((c[b] + 1.0) * (t_all + n)))) for b in f]
        weight = sum(g) // len(g) if g else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0))), len(plain_words(text))])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = collections.defaultdict(list)
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        ranks[id(x)].append(k + 1)
    return [(*x[:4], ranks[id(x)][0] if id(x) in ranks else None) for x in out]


def many_docs():
    r = random.Random(8)
    bag = ["Alpha", "beta", "gamma9", "élan", "日本語", "x", "I.B.M", "co-op", "ÀÉ", "z" * 50, "q" * 33, "w" * 32]
    docs = [(i, " ".join(r.choice(bag) + str(r.randrange(30)) for _ in range(r.randrange(0, 60))), f"s{i % 3}") for i in range(400)]
    docs += [(i, docs[7][1] + " more words" * 20, "s0") for i in (400, 400, 400, 401)]
    docs += [(None, "some words " * 30, "s1"), (402, None, None), (403, "", "s1"), (404, "word " * 40_000, "s2"), (405, "y" * 300_000, "s2"), (406, " - -- !!", None)]
    return docs


def key(rows):
    return sorted(map(repr, rows))


def test_draw_is_the_plain_one(spark):
    docs, goal = many_docs(), ["alpha3 beta1 élan4 alpha3", None, "", "日本語5 unknown"]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS rank", "2 AS n_words", "3 AS before", "4 AS _part").repartition(5)
    target = spark.createDataFrame([(g,) for g in goal], "text string")
    for options in ({}, {"longest": 2}, {"percent": 100, "min_words": 0}, {"percent": 37, "margin": 0.0}, {"percent": 3, "margin": 0.5}):
        out = resample.resampled(df, target, **options)
        assert out.columns == ["doc_id", "source", "n_words", "before", "_part", "n_features", "weight", "score", "rank"]
        got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
        want = plain_draw(docs, goal, options.get("longest", 1), options.get("percent", 10), options.get("min_words", 20))
        assert key(got) == key(want), options


def test_draw_of_nothing(spark):
    df = spark.createDataFrame(many_docs(), DOCS)
    none = spark.createDataFrame([], "text string")
    assert resample.resampled(df.limit(0), none).count() == 0
    got = resample.resampled(df, none, percent=0).collect()
    assert len(got) == len(many_docs()) and {r["rank"] for r in got} == {None}
    assert key((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample.resampled(df, none).collect()) == key(plain_draw(many_docs(), []))


def test_runs_do_not_depend_on_blocks(monkeypatch):
    texts = [t for _, t, _ in many_docs()]
    column = pa.array(texts, pa.string())
    for block in (1 << 21, 1_000, 7):
        monkeypatch.setattr(resample, "BLOCK", block)
        for longest in (1, 3):
            got = collections.defaultdict(list)
            for a, _, found, owner, _ in resample.runs(column[3:], longest, 1 << 20):
                for b, o in zip(found.tolist(), owner.tolist(), strict=True):
                    got[a + o].append(b)
            for i, t in enumerate(texts[3:]):
                assert collections.Counter(got[i]) == collections.Counter(zlib.crc32(f.encode()) % (1 << 20) for f in plain_runs(t, longest)), (block, longest, i)


def test_ties_at_the_cutoff(spark):
    text = "same words " * 15
    rows = [(7, text, "a")] * 60 + [(i, text, "a") for i in range(100, 140)]
    out = resample.resampled(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(text,)], "text string"), percent=50)
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
    assert sorted(g[4] for g in got if g[4]) == list(range(1, 51))
    assert key(got) == key(plain_draw(rows, [text], percent=50))


# --------------------------------------------------------------------- 13, filter audit


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        + 8 * bool(re.search(r"[#$%&*|]", text))
    )


def plain_audit(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, source in docs:
        mask = plain_mask(text or "") + 16 * (i is not None and i > least[text or ""])
        rows.append((source or "", mask, (i, "quality") in labels, (i, "toxic") in labels))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, lines = [r for r in rows if r[0] == part], collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, letter in enumerate(order):
                bit = 1 << "ABCDE".index(letter)
                gone = [r for r in left if r[1] & bit]
                fail = sum(1 for r in own if r[1] & bit)
                left = [r for r in left if not r[1] & bit]
                shapley[letter] += len(gone)
                lines.append([part, order, k + 1, len(left), len(gone), fail - len(gone), sum(1 for r in own if r[1] == bit), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return out


def audit_docs():
    r = random.Random(3)
    base = [" ".join(r.choice(["Ab", "cd", "e$", "é", "GH", str(r.random())]) for _ in range(r.randrange(0, 130))) for _ in range(60)]
    head = "the same long head of words " * 40
    base += [head + x for x in base[:20]] + [head[:k] for k in range(0, 60, 3)]
    docs = [(r.randrange(400), r.choice(base), r.choice(["s1", "s2", None, ""])) for _ in range(500)]
    docs += [(1, base[0], "s1"), (1, base[0], "s2"), (1, base[0], "s2"), (1, base[1], "s1"), (None, base[0], "s1"), (None, None, None), (9, None, "s3"), (5, "", "s3")]
    docs += [(1000, "word " * 50_000, "s4"), (1001, "word " * 50_000, "s4"), (1002, "W" * 200_000, "s4")]
    return docs


def test_audit_is_the_plain_one(spark):
    docs = audit_docs()
    r = random.Random(6)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 1003, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    marks = {(i, name) for i, q, t in labels for name, v in (("quality", q), ("toxic", t)) if v == 1 and i is not None}
    want = key(plain_audit(docs, marks))
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS mask", "'x' AS part", "2 AS n", "3 AS step").repartition(6)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS n", "2 AS part")
    for options in ({}, {"block": 3_000, "range_bytes": 4_000}, {"block": 1, "parts": 2, "range_bytes": 1}):
        got = [tuple(x) for x in audit.audit(frame, labelled, **options).collect()]
        assert key(got) == want, options
    assert audit.audit(frame.limit(0), labelled).count() == 0
    assert audit.audit(frame, labelled.limit(0)).count() == len(want)


def test_trie_holds_every_text_and_cuts_it_evenly():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(400)] + [b"a" * n for n in range(300)]
    trie = audit.Trie()
    for i, t in enumerate(texts):
        node = trie.insert(t)
        node.least = i if node.least is None else min(node.least, i)
        node.rows = (t, {})
    found = [(b"".join(path), node.least) for node, path in trie.walk() if node.rows]
    assert found == sorted((t, texts.index(t)) for t in set(texts))
    bounds = [c for c, _ in audit.cuts(trie, 2_000) if c]
    assert bounds == sorted(bounds) and sum(w for _, w in audit.cuts(trie, 2_000)) == sum(64 + len(t) for t in set(texts))
    weights = collections.Counter()
    for t in set(texts):
        weights[sum(t >= b for b in bounds)] += 64 + len(t)
    assert len(weights) == len(bounds) + 1 and max(weights.values()) < 3_000


def test_crc_of_many_words_at_once():
    data = np.frombuffer(bytes(range(256)) * 5, np.uint8)
    start = np.array([0, 10, 10, 300, 5, 1280])
    end = np.array([0, 11, 42, 1280, 38, 1280])
    got = ~resample.extended(np.full(6, 0xFFFFFFFF, np.uint32), data, start, end)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
