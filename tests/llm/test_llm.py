"""The ten corpus operators and the pipeline against brute force, and their edge cases."""

import itertools
import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import bpe, brown, chat, jaccard, pieces, quality, registry, rlz, suffix_dedup, templates, token_counts, token_files
from tessera.llm.common import shared_dir, written
from tessera.llm.text import buffers
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, _id string, _row string, _text string, spans string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x{r.randrange(9)}" for _ in range(n)]


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "a", "b", "c", "d", "e") for i, t in zip(ids, texts)], SCHEMA)


ODD = [None, "", "   ", "x", "é è 漢字 😀\n\n\nend  ", "'s don't we'll 'REs  \t x'", " ".join(words(30_000, 1)), "y" * 50_000]
ODD_IDS = [None, 1, 2, 3, 4, 5, 6, 6]


def odd(spark):
    rows = frame(spark, ODD, ODD_IDS)
    return rows.union(rows)


OPERATORS = {
    "op1": lambda s, d: token_counts.recount(token_counts.trees(d), token_counts.redactions),
    "op2": lambda s, d: suffix_dedup.find(d),
    "op2r": lambda s, d: suffix_dedup.remove(d),
    "op3": lambda s, d: templates.find(d, d.selectExpr("doc_id as item_id", "text")),
    "op3c": lambda s, d: templates.clean(d, d.selectExpr("doc_id as item_id", "text", "lang")),
    "op4": lambda s, d: rlz.find(d),
    "op5": lambda s, d: brown.perplexities(d),
    "op6": lambda s, d: quality.judge(d, d.selectExpr("doc_id", "1 as quality", "cast(doc_id % 2 as int) as toxic")),
    "op7": lambda s, d: token_files.write(d)[0],
    "op8": lambda s, d: pieces.decode(pieces.encode(d)),
    "op9": lambda s, d: jaccard.classes(d),
    "op9j": lambda s, d: jaccard.join(d),
    "op9k": lambda s, d: jaccard.keep_first(d),
    "op10": lambda s, d: chat.format_pairs(chat.pairs(d.selectExpr("doc_id as conv_id", "n_chars as turn", "lang as role", "text", "_k"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty(spark, name):
    OPERATORS[name](spark, odd(spark)).collect()
    assert OPERATORS[name](spark, odd(spark).limit(0)).collect() == []
    nulls = spark.createDataFrame([(None,) * 10] * 2, SCHEMA)
    OPERATORS[name](spark, nulls).collect()


def test_kept_columns_are_unchanged(spark):
    d = odd(spark)
    for f in (suffix_dedup.remove, jaccard.keep_first, lambda x: templates.clean(x, d.selectExpr("doc_id as item_id", "text").limit(0)), lambda x: quality.keep_good(x)):
        out = f(d)
        assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()
        assert {(r._k, r._id, r._row, r._text, r.spans) for r in out.collect()} == {("a", "b", "c", "d", "e")}


def test_pretokens_equal_the_pattern():
    import regex

    r = random.Random(3)
    alphabet = ["a", "Z", "é", "漢", "1", "٣", " ", "  ", "\n", "\t", " ", "'", "'s", "'re", "'ll", "'x", "!", "😀", "́"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    leaves = bpe.Leaves(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    data = b"".join(raw)
    got = [[data[leaves.start[i] : leaves.end[i]].decode() for i in range(leaves.doc_words[k], leaves.doc_words[k + 1])] for k in range(len(texts))]
    assert got == [regex.findall(bpe.PATTERN, t) for t in texts]
    enc = bpe.encoder()
    ids, at = enc.encode(np.frombuffer(data, np.uint8), leaves.offsets)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == enc.encoding.encode_ordinary_batch(texts)


def test_op1_edits_equal_recounting(spark):
    r, rows = random.Random(5), []
    for i in range(60):
        text = " ".join(words(r.choice([0, 1, 5, 300, 3000]), i)) + r.choice(["", "\n\n", "  x  'll"])
        log, now = [], text
        for _ in range(r.randrange(12)):
            a = r.randrange(len(now) + 3)
            b = a + r.choice([0, 1, 2, 7, 400])
            new = r.choice(["", " ", "'", "ll", "\n \n", "hello there", "é'", "1", " 's"])
            log.append((a, b, new))
            a, b = min(a, len(now)), min(b, len(now))
            now = now[:a] + new + now[b:]
        rows.append((i, text, log, now))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, edits array<struct<start:int,end:int,insert:string>>")
    got = {x.doc_id: x for x in token_counts.recount(token_counts.trees(docs)).collect()}
    count = lambda t: len(bpe.encoder().encoding.encode_ordinary(t))
    for i, text, log, now in rows:
        assert (got[i].n_tokens, got[i].n_edits, got[i].n_tokens_edited) == (count(text), len(log), count(now)), i


def test_op1_takes_log_after_log(spark):
    """Each log starts from the tree that the one before it left; little of a long text is encoded again."""
    r, count = random.Random(6), lambda t: len(bpe.encoder().encoding.encode_ordinary(t))
    now = {0: " ".join(words(20_000, 1)), 1: "", 2: None, 3: " ".join(words(90, 2)), 4: "y" * 50_000}
    fields = "doc_id long, text string, other string"
    docs = token_counts.trees(spark.createDataFrame([(i, t, "o") for i, t in now.items()], fields))
    for step in range(4):
        logs = {}
        for i, t in now.items():
            log = []
            for _ in range(r.randrange(1, 6)) if t is not None else ():
                a = r.randrange(len(t) + 2)
                b, new = a + r.choice([0, 1, 7, 300]), r.choice(["", " ", "'ll", "\n \n", "hello there ", "x " * 1500 if step == 1 and i == 3 else "q"])
                log.append((a, b, new))
                t = t[:a] + new + t[b:]
            logs[i], now[i] = log, t
        edits = spark.createDataFrame(list(logs.items()), "doc_id long, edits array<struct<start:int,end:int,insert:string>>")
        docs = spark.createDataFrame(token_counts.recount(docs.drop("n_tokens", "n_edits", "n_tokens_edited", "n_reencoded").join(edits, "doc_id")).toArrow())
        got = {x.doc_id: x for x in docs.collect()}
        for i, t in now.items():
            assert (got[i].text, got[i].n_tokens_edited, got[i].other) == (t, None if t is None else count(t), "o")
        assert got[0].n_reencoded < 200 and got[2].widths is None
        again = {x.doc_id: x for x in token_counts.recount(docs, lambda t: []).collect()}
        assert all(again[i].n_tokens == got[i].n_tokens_edited for i in now)


def test_op1_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "n", 5, b"w")], "doc_id long, text string, n_tokens string, Sums int, widths binary")
    row = token_counts.recount(token_counts.trees(docs), lambda t: [(0, 1, "zz")]).first()
    assert sorted(row.asDict()) == sorted(["doc_id", "text", "widths", "tokens", "leaves", "sums", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"])
    assert (row.text, row.n_tokens, row.n_tokens_edited) == ("zz b c", 3, len(bpe.encoder().encoding.encode_ordinary("zz b c")))


def test_op1_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = bpe.encoder().encoding

    def edited(t):
        for a, b, s in token_counts.redactions(t):
            t = t[:a] + s + t[b:]
        return t

    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in registry.op1_token_counts(spark, sf).collect()}
    assert got == {d: (len(enc.encode_ordinary(t)), len(enc.encode_ordinary(edited(t)))) for d, t in texts.items()}
    assert token_counts.redactions("me a.b@c.de, +1 (743) 555-3824 4785380592391139") == [(3, 11, "<EMAIL>"), (12, 29, "<PHONE>"), (20, 36, "<CARD>")]
    long = "the same line of text again\n"
    assert edited("x\n" + 3 * long) == "x\n" + long


def repeated(docs, length):
    """Merged spans of windows that stand earlier, by (id, text)."""
    seen, out = set(), {}
    for i, t in sorted(set(docs), key=lambda x: (x[0], x[1])):
        w = re.findall(r"[^\x00-\x20]+", t)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            if g in seen:
                s = out.setdefault(i, [])
                if s and k <= s[-1][1]:
                    s[-1] = (s[-1][0], k + length)
                else:
                    s.append((k, k + length))
            seen.add(g)
    return out


@pytest.mark.parametrize("find", [suffix_dedup.find, rlz.find])
@pytest.mark.parametrize("limits", [{}, {"hot": 3, "group_words": 300}])
def test_repeats(spark, find, limits):
    r = random.Random(7)
    parts = [words(r.randrange(20, 90), 100 + i, 12) for i in range(12)]
    texts = [" \n".join(itertools.chain(*r.choices(parts, k=r.randrange(1, 6)))) for _ in range(60)] + [" ".join(["ab"] * 300), " ".join(["ab", "cd"] * 150)]
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in find(frame(spark, texts), **limits).collect()}
    assert got == repeated(list(enumerate(texts)), 40)
    assert {x.doc_id: [(s.start, s.end) for s in x.spans] for x in find(frame(spark, texts), length=20, **limits).collect()} == repeated(list(enumerate(texts)), 20)


@pytest.mark.parametrize("find", [suffix_dedup.find, rlz.find])
def test_repeats_with_one_minimizer_in_most_rows(spark, find):
    line, r = words(45, 1), random.Random(3)
    texts = [" ".join(words(r.randrange(30), i) + line + words(r.randrange(30), 900 + i)) for i in range(200)]
    texts += [" ".join(words(20, 5000 + i) + line[:36] + words(20, 7000 + i)) for i in range(100)] + ["", None, "x"]
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in find(frame(spark, texts), hot=10).collect()}
    assert got == repeated([(i, t or "") for i, t in enumerate(texts)], 40) and len(got) == 199


@pytest.mark.parametrize("find", [suffix_dedup.find, rlz.find])
def test_repeats_odd_rows(spark, find):
    long = " ".join(words(20_000, 8, 10**6))
    docs = frame(spark, [None, "", long, long, f"x {long}", " ".join(words(39, 1)), " ".join(words(39, 1))], [1, 2, 5, 5, None, 7, 8])
    assert [(r.doc_id, [(s.start, s.end) for s in r.spans], r.n_words) for r in find(docs).collect()] == [(5, [(0, 20_000)], 20_000)]
    with pytest.raises(TypeError, match="integer"):
        find(docs.selectExpr("'x' as doc_id", "text"))


def test_rlz_longest_matches_are_the_longest():
    r = np.random.default_rng(0)
    for _ in range(60):
        blocks = [r.integers(1, 4, r.integers(1, 30)).astype(np.uint64) for _ in range(r.integers(1, 6))]
        n = len(blocks)
        g = type("Group", (), {})()
        g.size = np.array([len(b) for b in blocks])
        g.start = np.concatenate([[0], np.cumsum(g.size + 1)])[:-1]
        text = np.concatenate([*(np.append(b, 0) for b in blocks), np.zeros(5)]).astype(np.uint64)
        g.full, g.k, g.id, g.at = lambda text=text: text, np.arange(n), r.integers(0, 3, n), np.zeros(n, int)
        best, source = rlz.longest(g)
        for b, o in [(b, o) for b in range(n) for o in range(g.size[b])]:
            want = 0
            for c, q in [(c, q) for c in range(n) for q in range(g.size[c]) if (g.id[c], c, q) < (g.id[b], b, o)]:
                m = 0
                while o + m < g.size[b] and q + m < g.size[c] and blocks[b][o + m] == blocks[c][q + m]:
                    m += 1
                want = max(want, m)
            i = g.start[b] + o
            assert best[i] == want and (text[i : i + want] == text[source[i] : source[i] + want]).all()


def test_rlz_factors_copy_what_they_say(spark):
    a, b = words(100, 1), words(80, 2)
    texts = [" ".join(a), " ".join(b), " ".join(["x"] + a[5:95] + ["y"] + b)]
    got = rlz.find(frame(spark, texts)).collect()
    assert [(r.doc_id, [tuple(f) for f in r.factors]) for r in got] == [(2, [(1, 91, 0, 5), (92, 172, 1, 0)])]


def test_two_stage_sort_is_a_suffix_sort():
    r = np.random.default_rng(1)
    for size in (3, 50, 700):
        text = np.concatenate([r.choice(np.array([5, 1 << 24, 3 << 24, (3 << 24) + 1, 9 << 28], np.uint32), size), np.zeros(12, np.uint32)])
        windows = np.arange(size - 2)
        got = suffix_dedup.suffix_array(text, windows, 10)
        keys = [tuple(text[i : i + 10].tolist()) for i in got]
        assert sorted(got.tolist()) == windows.tolist() and keys == sorted(keys)


def test_rlz_covers_matches_across_factors(spark):
    a, b = words(60, 1), words(60, 2)
    texts = [" ".join(a), " ".join(b), " ".join(a[-30:] + b[:30]), " ".join(a[10:] + b[:50])]
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in rlz.find(frame(spark, texts)).collect()}
    assert got == {3: [(0, 100)]}


def test_op2_remove(spark):
    passage = " ".join(words(60, 3))
    texts = [f"start {passage} end", f"other\n{passage}\ntail here", passage]
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.remove(frame(spark, texts)).collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: ("other\ntail here", 15)}


def test_op3_catches_new_parameters_and_checks_slots(spark):
    item = "If Anna buys 12 red apples and 7 green pears at the old market, then how many more of the 12 apples than of the 7 pears does she hold?"
    ok = item.replace("12", "31").replace("7", "5").replace("Anna", "Boris")
    bad = "If Anna buys 12 red apples and 7 green pears at the old market, then how many more of the 9 apples than of the 4 pears does she hold?"
    filler = " ".join(words(50, 9))
    docs = frame(spark, [filler, f"{filler}. {item} {filler}", f"{filler}. {ok} {filler}", f"{filler}. {bad}", None])
    bench = spark.createDataFrame([(0, item, "x"), (1, None, "x"), (None, "too short", "x")], "item_id int, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.covered for r in templates.find(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 0)} and min(got.values()) > 0.9
    assert sorted((r.doc_id for r in templates.clean(docs, bench).collect())) == [0, 3, 4]


def symbols(text):
    """[(words, kind), ...] of a text by the definition, one word after another."""
    small = lambda c: c.lower() if ord(c) < 128 or ord(c) < 0x800 and len(c.lower().encode()) == 2 else c
    large = lambda c: c != small(c)
    out, behind = [], None
    for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text):
        raw, low = m[0], "".join(map(small, m[0]))
        gap = text[behind : m.start()] if behind is not None else None
        number = bool(re.search("[0-9]", raw))
        name = large(raw[0]) and not (len(raw) > 1 and large(raw[1])) and not number and low not in templates.OPENERS
        last = out[-1] if out else ((), None, None)
        if gap is not None and (number and last[2] == "number" and gap in (",", ".") or len(gap.encode()) == 1 and low in templates.UNITS and last[2] == "number" or name and last[2] == "name" and gap == " "):
            out[-1] = ((*last[0], low), last[1], "unit" if not number and not name else last[2])
        else:
            kind = "number" if number else "name" if name else None
            out.append(((low,), kind, kind))
        behind = m.end()
    return [(w, k) for w, k, _ in out]


def covered(doc, item):
    """The share of the item's words that consistent alignments cover, by brute force."""
    d, i = symbols(doc), symbols(item)
    shown = lambda s: [k or w[0] for w, k in s]
    flat = lambda s: [x for w, _ in s for x in w]
    edge = lambda s: list(itertools.accumulate((len(w) for w, _ in s), initial=0))
    found = {}
    n = min(10, len(i))
    if n >= 6:
        for a in range(len(i) - n + 1):
            if sum(k is None for _, k in i[a : a + n]) >= 5:
                for b in range(len(d) - n + 1):
                    if shown(i)[a : a + n] == shown(d)[b : b + n]:
                        found.setdefault(b - a, []).append((edge(i)[a], edge(i)[a + n], [(x[0], y[0]) for x, y in zip(i[a : a + n], d[b : b + n]) if x[1]], False))
    wi, wd = flat(i), flat(d)
    n = min(10, len(wi))
    owner = lambda s: [j for j, (w, _) in enumerate(s) for _ in w]
    for a in range(len(wi) - n + 1 if n else 0):
        for b in range(len(wd) - n + 1):
            if wi[a : a + n] == wd[b : b + n]:
                inside = [w for j, (w, k) in enumerate(i) if k and edge(i)[j] >= a and edge(i)[j + 1] <= a + n]
                found.setdefault(owner(d)[b] - owner(i)[a], []).append((a, a + n, [(w, w) for w in inside], True))
                if n < 10:
                    break
    on = set()
    for hits in found.values():
        for kinds in ((False, True), (False,)):
            mine = [h for h in hits if h[3] in kinds]
            pairs = {p for h in mine for p in h[2]}
            if len({v for v, _ in pairs}) == len(pairs) == len({w for _, w in pairs}):
                for h in mine:
                    on.update(range(h[0], h[1]))
    return len(on) / len(wi) if wi else 0.0


def test_op3_equals_brute_force(spark):
    r = random.Random(4)
    some = ["anna", "Anna", "Boris Carl", "Zoë", "Иван", "7", "12", "1,000", "2.5 kg", "5 km", "5km", "in", "m", "The", "How", "red", "buys", "apples", "then", "pears", "more", "old", "ÉCRU", "漢字"]
    item = lambda n: "".join(r.choice(some) + r.choice([" ", " ", " ", ", ", "? "]) for _ in range(n))
    items = [item(n) for n in (1, 3, 5, 6, 8, 9, 10, 11, 14, 20, 25, 30) for _ in range(4)] + ["", None]

    def changed(t):
        other = {"7": "31", "12": "9", "Anna": "Dora", "5 km": "8 m", "1,000": "20"}
        return " ".join(r.choice([other.get(w, w), w]) if r.random() < 0.5 else w for w in re.split(" ", t or ""))

    docs = [f"{item(r.randrange(20))} {t if r.random() < 0.4 else changed(t)} {item(r.randrange(15))}" for t in items for _ in range(3)] + [None, ""]
    want = {(d, i): c for d, x in enumerate(docs) for i, y in enumerate(items) if (c := covered(x or "", y or "")) >= 0.4}
    got = {(x.doc_id, x.item_id): x.covered for x in templates.find(frame(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()}
    assert len(want) > 100 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_op3_finds_verbatim_items_of_any_kind(spark):
    items = ["What is the capital of France?", "Add 12 and 30", "12 + 7 - 3 * 5 + 11 - 2 + 9 - 4 + 8 * 6 + 1 - 10", "Did Anna Boris Carla Dora Emil Frida Georg Hanna or Ivan win?", "Was Anna in Rome?", "Name 5 units: mm, cm, m, km and mi, or ft"]
    filler = " ".join(words(50, 9))
    docs = frame(spark, [*(f"{filler} {x} {filler} {x.upper()}" for x in items), filler])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in templates.find(docs, bench).collect()}
    assert got == {(i, i): 1.0 for i in range(len(items))}
    assert [r.doc_id for r in templates.clean(docs, bench).collect()] == [len(items)]


def test_op3_query_finds_all_verbatim_items(spark):
    sf = SF.replace("0.001", "0.01")  # where items stand in some texts
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for i, b in items.items() for d, t in docs.items() if b in t}
    got = {(r.doc_id, r.item_id) for r in registry.op3_decontamination(spark, sf).collect()}
    assert want and want <= got


def test_op5_learns_and_equals_brute_force(spark):
    r = random.Random(2)
    nouns, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    texts = [" ".join(itertools.chain(*((r.choice(nouns), r.choice(verbs)) for _ in range(40)))) for _ in range(80)]
    docs = frame(spark, [*texts, None])
    m = brown.train(docs, clustered=1000, classes=4)
    hashed = lambda w: int(brown.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
    ids = {int(k): i for i, k in enumerate(m.keys)}
    kind = lambda w: int(m.kind[ids[hashed(w)]])
    assert not {kind(w) for w in nouns} & {kind(w) for w in verbs}
    got = {x.doc_id: (x.n_words, x.perplexity) for x in brown.score(docs, m).collect()}
    assert got[len(texts)] == (0, None) and m.rounds > 2
    shuffled = [" ".join(r.sample(t.split(), 80)) for t in texts[:20]]
    worse = [x.perplexity for x in brown.score(frame(spark, shuffled), m).collect()]
    assert np.mean(worse) > 1.3 * np.mean([got[i][1] for i in range(20)])


@pytest.mark.parametrize("clustered", [1000, 12])
def test_op5_scores_equal_brute_force(spark, clustered):
    """Also where most words are rare, and some occur once."""
    r = random.Random(3)
    texts = [" ".join([f"w{min(int(r.expovariate(0.06)), 60)}" for _ in range(r.randrange(1, 60))] + [f"once{i}"] * (i % 3 == 0)) for i in range(60)] + ["", "once0 new words"]
    docs = frame(spark, texts, [None, *range(1, 61), 60])
    m = brown.train(docs, clustered=clustered, classes=4)
    hashed = lambda w: int(brown.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0].view(np.int64)[0])
    n = {}
    for w in itertools.chain(*(t.split() for t in texts)):
        n[w] = n.get(w, 0) + 1
    ids = {int(k): i for i, k in enumerate(m.keys.view(np.int64))}
    assert len(ids) == min(clustered, sum(c > 1 for c in n.values()))
    rare = {x.h: x.kind for x in m.rare.collect()}
    assert len(ids) + len(rare) == sum(c > 1 for c in n.values()) and m.unknown == sum(c == 1 for c in n.values())
    kind = lambda w: int(m.kind[ids[hashed(w)]]) if hashed(w) in ids else rare.get(hashed(w), 4)
    context = lambda w: int(m.kind[ids[hashed(w)]]) if hashed(w) in ids else 4
    size, pairs = np.zeros(6), np.zeros((6, 6))
    for t in texts:
        before = 5
        for w in t.split():
            pairs[before, kind(w)] += 1
            size[kind(w)] += 1
            before = context(w)
    uni = (pairs.sum(0) + 1) / (pairs.sum() + 6)

    def perplexity(t):
        before, total = 5, 0.0
        for w in t.split():
            c = kind(w)
            total += math.log((pairs[before, c] + 5 * uni[c]) / (pairs[before].sum() + 5)) + (math.log(n[w] / size[c]) if c != 4 else -math.log(m.unknown))
            before = context(w)
        return math.exp(-total / len(t.split())) if t.split() else None

    got = sorted(((x.doc_id or 0, x.n_words, x.perplexity or 0) for x in brown.score(docs, m).collect()))
    want = sorted((i or 0, len(t.split()), perplexity(t) or 0) for i, t in zip([None, *range(1, 61), 60], texts))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_op5_rare_words_settle_in_classes(spark):
    """Words that occur twice or more are of a class, never unknown, also where their contexts leave out most classes."""
    r = random.Random(4)
    nouns, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    texts = [" ".join(itertools.chain(*((r.choice(nouns), r.choice(verbs)) for _ in range(40)))) for _ in range(80)]
    texts += [f"{r.choice(nouns)} {r.choice(verbs)} rn{i % 10} {r.choice(verbs)} {r.choice(nouns)} rv{i % 10}" for i in range(30)] + ["n1 once v2"]
    m = brown.train(frame(spark, texts), clustered=40, classes=4)
    hashed = lambda w: int(brown.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0].view(np.int64)[0])
    ids = {int(k): i for i, k in enumerate(m.keys.view(np.int64))}
    kinds = lambda ws: {int(m.kind[ids[hashed(w)]]) for w in ws}
    rare = {x.h: (x.kind, x.n) for x in m.rare.collect()}
    assert len(rare) == 20 and set(x for _, x in rare.values()) == {3}
    assert {rare[hashed(f"rn{i}")][0] for i in range(10)} <= kinds(nouns) and {rare[hashed(f"rv{i}")][0] for i in range(10)} <= kinds(verbs)
    assert m.unknown == m.size[4] == 1


def test_op5_takes_many_classes_and_clashing_names(spark):
    docs = spark.createDataFrame([("a", " ".join(f"w{i} w{i}" for i in range(300)), 1, 2.0)], "doc_id string, text string, n_words int, Perplexity double")
    out = brown.perplexities(docs, classes=260, clustered=280)
    assert out.columns == ["doc_id", "n_words", "perplexity"] and out.first().n_words == 600


def test_op5_gains_are_exact():
    r = np.random.default_rng(0)
    v, k = 12, 4
    pair = r.integers(0, 9, (v, v))
    kind = r.integers(0, k, v)

    def matrix(kind, pair):
        m = np.zeros((k, k))
        for a in range(v):
            for b in range(v):
                m[kind[a], kind[b]] += pair[a, b]
        return m

    for w in range(v):
        own = np.array([pair[w, w]])
        right, left = np.zeros((1, k)), np.zeros((1, k))
        for o in range(v):
            if o != w:
                right[0, kind[o]] += pair[w, o]
                left[0, kind[o]] += pair[o, w]
        gain = brown.gains(matrix(kind, pair), right, left, own, np.array([kind[w]]))[0]
        full = []
        for c in range(k):
            moved = kind.copy()
            moved[w] = c
            full.append(brown.likelihood(matrix(moved, pair)))
        assert np.allclose(gain - gain[0], np.array(full) - full[0])


def test_op5_neighbours_travel_in_blocks_and_rounds_read_one_half(spark, monkeypatch):
    """The table of neighbours has a row for each block, of words of one half, and holds every pair; also counts beyond 16 bits."""
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(400)) for _ in range(100)] + ["often often " * 40_000]
    tables = {}

    def kept(df, name, *by):
        tables[name] = written(df, name, *by)
        return tables[name]

    monkeypatch.setattr(brown, "written", kept)
    m = brown.train(frame(spark, texts), clustered=300, classes=4)
    near = tables["neighbours"]
    assert near.count() <= 302 // brown.BLOCK + 3  # a row for each word before
    assert {(x.half, x.block % 2) for x in near.select("half", "block").collect()} == {(0, 0), (1, 1)}
    ids = {int(k): i for i, k in enumerate(m.keys)}
    pairs = {}
    for t in texts:
        h = brown.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
        w = [len(ids) + 1, *(ids.get(int(x), len(ids)) for x in h)]
        for a, b in itertools.pairwise(w):
            pairs[a, b] = pairs.get((a, b), 0) + 1
    got = {}
    for batch in near.toArrow().to_batches():
        for w, per, own, o, n in brown._blocks([batch], len(ids) + 2):
            got |= {(int(x), int(x)): int(c) for x, c in zip(w, own) if c}
            side = np.repeat(np.tile([0, 1], len(w)), per.ravel())
            for x, b, y, c in zip(np.repeat(w, per.sum(1)), side, o, n):
                key = (int(x), int(y)) if not b else (int(y), int(x), "before")
                got[key] = got.get(key, 0) + int(c)
    assert max(pairs.values()) > 65_535 and got == pairs | {(a, b, "before"): c for (a, b), c in pairs.items() if a != b}


def test_op5_moves_shift_the_matrix_as_a_recount_would():
    r = np.random.default_rng(1)
    v, k = 150, 6
    count = r.poisson(0.8, (v + 2, v + 2))
    count[3, 4], count[:, v + 1] = 200_000, 0
    a, b = np.nonzero(count)
    n, apart = count[a, b], a != b
    sent = pa.Table.from_batches([brown._sent(brown._seats(a), b, n), brown._sent(brown._seats(b[apart]), a[apart] | brown.BEFORE, n[apart])])
    near = list(brown._neighbours(sent.sort_by("block").combine_chunks().to_batches()))

    def recounted(kind):
        m = np.zeros((k, k), np.int64)
        np.add.at(m, (kind[a], kind[b]), n)
        return m

    def cells(out):
        m = np.zeros(k * k, np.int64)
        for x in out:
            m[x["c"].to_numpy()] += x["n"].to_numpy()
        return m.reshape(k, k)

    kind = np.append(r.integers(0, k - 2, v), [k - 2, k - 1]).astype(np.uint16)
    matrix = cells(brown._matrix(SimpleNamespace(value=kind), k)(near))
    assert (matrix == recounted(kind)).all()
    for half in (0, 1):
        mine = [x for x in near if x["half"][0].as_py() == half]
        moves = list(brown._moves(SimpleNamespace(value=(kind, matrix)), k)(mine))
        new = kind.copy()
        for x in moves:
            new[x["w"].to_numpy()] = x["c"].to_numpy()
        moved = np.flatnonzero(new != kind)
        assert len(moved) > 10 and (moved % 2 == half).all() and (moved < v).all()
        matrix = matrix + cells(brown._shifts(SimpleNamespace(value=(kind, new)), k)(mine))
        kind = new
        assert (matrix == recounted(kind)).all()


def test_op6_equals_rules_in_any_order(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from functools import reduce

    cascade = quality.rules(quality.learn_toxic(docs, labels))
    want = {r.doc_id: not r.bad for r in docs.select("doc_id", reduce(lambda a, b: a | b, [x.reject for x in cascade]).alias("bad")).collect()}
    assert {r.doc_id: r.keep for r in quality.judge(docs, labels).collect()} == want
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {d for d, k in want.items() if k}


def test_op6_orders_by_rejections_per_cost():
    rules = [quality.Rule(n, None) for n in "abcd"]
    est = [quality.Estimate("a", 1, 0.1), quality.Estimate("b", 10, 0.5), quality.Estimate("c", 2, 0.4), quality.Estimate("d", 1, 0.0)]
    assert [r.name for r in quality.ordered(rules, est)] == ["c", "a", "b", "d"]


def test_op6_learns_toxic_words_and_rejects_junk(spark):
    texts = [f"{' '.join(words(30, i))} {'vilex' if i % 3 == 0 else 'calm'}" for i in range(120)]
    docs = frame(spark, [*texts, "", None, "#$%^ &*=+ {}|~ <> @@ a", "AAAA BBBB CCCC", "same line\n" * 20, "copy copy " * 30])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.judge(docs, labels).collect()}
    assert all(got[i] == (i % 3 != 0) for i in range(120)) and not any(got[i] for i in range(120, 126))


def test_op6_equals_rules_by_hand(spark):
    """The rules again in Python, on each kind of junk and on near misses of it."""
    plain = " ".join(words(60, 1)) + " and the end"
    texts = ["", " \n", None, "#$%^ &*=+ {}|~ <> @@ a", "A" * 50 + " b", "same line\n" * 20, "copy copy " * 30, "see http://a.b/c www.d.e f", "mail a@b.cd x@y.zw", "call +1 (743) 555-3824", "All rights reserved", "Privacy Policy\nfine\nfine", "z" * 1000, "z" * 999, " ".join(f"{chr(97 + i % 26)}q{chr(97 + i // 26)}" for i in range(300)), plain, plain + " http://a.b", plain + " a@b.cd " + plain, "日本語" * 400]

    def bad(t):
        t = t or ""
        n, spaced, lines = max(len(t), 1), t.split(" "), t.split("\n")
        low = t.lower().split(" ")
        word = r"(?<![^\W_]){}(?![^\W_])"
        return (
            not t.strip()
            or len(re.findall(r"[!#$%&*+<=>@^_`~\\|{}]", t)) / n > 0.06
            or len(re.findall("[A-ZÀ-ÖØ-Þ]", t)) / n > 0.5
            or 1 - len(set(lines)) / len(lines) > 0.4
            or len(low) >= 20 and len(set(low)) / len(low) < 0.35
            or len(re.findall(quality.LINK, t)) > 0.3 * len(spaced)
            or len(re.findall(quality.PERSONAL, t)) > 0.5 * len(spaced)
            or len(re.findall(quality.BOILERPLATE, t)) > 0.6 * len(lines)
            or bool(re.search("[A-Za-z]{1000}", t))
            or not re.search("(?i)" + word.format("(?:" + "|".join(quality.STOP) + ")"), t) and len(re.findall(word.format("[a-z]+"), t)) >= 200
        )

    rows = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    assert {i: r.keep for i, r in rows.items()} == {i: not bad(t) for i, t in enumerate(texts)}
    assert {rows[i].rule for i in (2, 10, 12, 14, 15)} == {"empty", "boilerplate", "run_on", "language", None}
    assert sum(r.keep for r in rows.values()) == 7


def test_op6_shows_its_cascade(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.cascade(docs).orderBy("place").collect()
    assert [r.rule for r in got] != [] and {r.rule for r in got} == {r.name for r in quality.rules()}
    assert all(a.worth >= b.worth for a, b in itertools.pairwise(got)) and all(r.cost > 0 and 0 <= r.selectivity <= 1 for r in got)


def test_op7_round_trip(spark):
    docs = odd(spark).repartition(3)
    rows, folder = token_files.write(docs)
    rows = sorted(rows.collect(), key=lambda r: (r.start, r.n_tokens))
    reader, enc = token_files.Reader(folder), bpe.encoder().encoding
    assert len(reader) == 2 * len(ODD) == len(rows)
    texts = [enc.decode(reader[i].tolist()) for i in range(len(reader))]
    assert sorted(texts) == sorted(2 * [t or "" for t in ODD])
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(rows))
    assert reader.parts[0][1].dtype == np.uint16 and isinstance(reader.parts[0][1], np.memmap)
    with pytest.raises(IndexError):
        reader[len(reader)]


def test_op7_leaves_the_files_of_others_alone(spark, tmp_path):
    (tmp_path / "mine.txt").write_text("mine")
    with pytest.raises(FileExistsError):
        token_files.write(odd(spark), f"file://{tmp_path}")
    assert [x.name for x in tmp_path.iterdir()] == ["mine.txt"] and (tmp_path / "mine.txt").read_text() == "mine"
    _, folder = token_files.write(spark.createDataFrame([("a", "x y", 1, 2)], "doc_id string, text string, part int, start int"), f"file://{tmp_path}/new")
    assert len(token_files.Reader(folder)) == 1 and len(list((tmp_path / "new").iterdir())) == 3


def test_a_cluster_must_name_the_shared_folder(spark):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_op7_query(spark, sf):
    enc = bpe.encoder().encoding
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in registry.op7_token_files(spark, sf).collect()} == want


def test_op8_is_lossless_and_reproducible(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd(spark).where("doc_id is not null").select("doc_id", "text"))
    a, b = pieces.encode(docs), pieces.encode(docs.repartition(5))
    key = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(a) == key(b) != key(pieces.encode(docs, seed=1))
    assert sorted((r.doc_id, r.text) for r in pieces.decode(a).collect()) == sorted((r.doc_id, r.text) for r in docs.collect())


def test_op8_draws_follow_the_lattice():
    v, n = pieces.load(), 40_000
    raw = np.frombuffer(b"the ing" * n, np.uint8)
    ids, at = pieces.encode_buffers(v, raw, np.arange(n + 1) * 7, np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64))
    got: dict = {}
    for i in range(n):
        seg = tuple(ids[at[i] : at[i + 1]].tolist())
        got[seg] = got.get(seg, 0) + 1
    known = {bytes(v.data[v.at[i] : v.at[i + 1]]): i for i in range(len(v.weight)) if v.weight[i] and i not in set(v.byte_ids.tolist())}

    def segments(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest, w in segments(s[k:]):
                    yield (known[s[:k]], *rest), w * v.weight[known[s[:k]]]

    one, two = list(segments(b"the")), list(segments(b" ing"))
    want = {a + b: x * y for (a, x), (b, y) in itertools.product(one, two)}
    total = sum(want.values())
    assert set(got) <= set(want)
    for seg, w in want.items():
        p = w / total
        assert abs(got.get(seg, 0) / n - p) < 5 * math.sqrt(p / n) + 1e-3


@pytest.mark.parametrize("text", ["in", "né", "日x", "\u0000\uffffe"])
def test_op8_long_units_follow_the_lattice(text):
    """Units of any length can go character by character; the draws of short ones are countable."""
    v, n = pieces.load(), 30_000
    raw = text.encode()
    r = np.random.default_rng(0)
    ids, per = pieces._long_units(v, np.frombuffer(raw * n, np.uint8), np.full(n, len(raw)), lambda i, s: r.random(len(i)))
    at = np.concatenate([[0], np.cumsum(per)])
    got: dict = {}
    for i in range(n):
        seg = tuple(ids[at[i] : at[i + 1]].tolist())
        got[seg] = got.get(seg, 0) + 1
    byte = set(v.byte_ids.tolist())
    known = {bytes(v.data[v.at[i] : v.at[i + 1]]): i for i in range(len(v.weight)) if v.weight[i] and i not in byte}

    def segments(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            p = known.get(s[:k], int(v.byte_ids[s[0]]) if k == 1 else None)
            if p is not None:
                for rest, w in segments(s[k:]):
                    yield (p, *rest), w * v.weight[p]

    want = dict(segments(raw))
    total = sum(want.values())
    assert set(got) <= set(want)
    for seg, w in want.items():
        p = w / total
        assert abs(got.get(seg, 0) / n - p) < 5 * math.sqrt(p / n) + 1e-3
    best, _ = pieces._long_units(v, np.frombuffer(raw, np.uint8), np.array([len(raw)]), lambda i, s: None)
    assert tuple(best.tolist()) in want


def test_op8_texts_without_spaces(spark):
    r = random.Random(1)
    texts = ["".join(chr(r.randrange(0x4E00, 0x5200)) for _ in range(3000)), "日本語" * 500, "http://" + "ab/c?d=" * 40 + " x " + "é" * 70, "😀" * 100, "\n".join(["wörd" * 30] * 5), "y" * 20_000, "a" * 65]
    docs = frame(spark, texts)
    assert [r.text for r in pieces.decode(pieces.encode(docs)).orderBy("doc_id").collect()] == texts
    assert [r.text for r in pieces.decode(pieces.encode(docs, sample=False)).orderBy("doc_id").collect()] == texts
    again = lambda d: {r.doc_id: r.ids for r in pieces.encode(d).collect()}
    assert again(docs) == again(docs.repartition(3, "text"))


def grams(t, n=5):
    w = re.findall(r"[^\x00-\x20]+", t or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near(texts, threshold):
    sets = [grams(t) for t in texts]
    return {(i, j): round(len(a & b) / len(a | b), 6) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if a and b and len(a & b) / len(a | b) >= threshold}


def near_texts():
    r, out = random.Random(11), []
    for g in range(40):
        base = words(120, 1000 + g, 5000)
        for _ in range(r.choice([1, 2, 5])):
            w = list(base)
            for _ in range(r.randrange(12)):
                w[r.randrange(len(w))] = "new"
            out.append(" ".join(w))
    return [*out, "a b", "a  b", "a b c", "", None, " ".join(words(120, 1000, 5000))]


def first_texts(texts):
    """The texts, null where an earlier one has the same N-grams."""
    seen = set()
    return [None if not (g := frozenset(grams(t))) or g in seen or seen.add(g) else t for t in texts]


def linked(texts, threshold):
    """(class, links) of each text, by brute force."""
    pairs = near(texts, threshold)
    root = components(len(texts), pairs)
    links = [0] * len(texts)
    for i in itertools.chain(*pairs):
        links[i] += 1
    return {i: (root[i], links[i]) for i in range(len(texts))}


#: Columns of 2 % of the rows counted apart, blocks in slices of 16 rows.
TIGHT = {"share": 0.02, "cut_at": 16}


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_op9_finds_every_pair(spark, limits):
    texts = near_texts()
    docs = frame(spark, texts)
    assert {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.join(docs, **limits).collect()} == near(first_texts(texts), 0.4)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs, **limits).collect()} == linked(texts, 0.4)


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_op9_finds_edited_copies_in_large_groups(spark, limits):
    r, base, texts = random.Random(12), words(300, 1, 5000), []
    for _ in range(300):
        w = list(base)
        for _ in range(r.choice([4, 8, 15])):
            w[r.randrange(300)] = f"e{r.randrange(10**9)}"
        texts.append(" ".join(w))
    passage = words(60, 2, 5000)
    for i in range(150):  # most alike in nothing but the passage; each two alike in 60 words more
        texts.append(" ".join(words(60, 10_000 + i // 2, 5000) + passage + words(25, 20_000 + i, 5000)))
    texts += [" ".join(words(1000, 30_000 + i, 5000)) for i in range(50)]
    want = near(texts, 0.4)
    assert len([p for p in want if p[1] < 300]) > 40_000 and len([p for p in want if p[0] >= 300]) >= 75
    assert {(x.doc_a, x.doc_b): x.jaccard for x in jaccard.join(frame(spark, texts), **limits).collect()} == want
    assert {x.doc_id: (x.class_id, x.n_links) for x in jaccard.classes(frame(spark, texts), **limits).collect()} == linked(texts, 0.4)


@pytest.mark.parametrize("n", [2, 6, 12, 40])
def test_op9_finds_texts_alike_in_common_text(spark, n):
    shared = words(400, 5, 10**6)
    docs = frame(spark, [" ".join(shared + words(200, 100 + i, 10**6)) for i in range(n)])
    assert jaccard.join(docs).count() == n * (n - 1) // 2
    assert [r.doc_id for r in jaccard.keep_first(docs).collect()] == [0]


def test_op9_odd_rows(spark):
    long = " ".join(words(30_000, 1, 10**6))
    docs = frame(spark, [None, "", " ", "a b", "a  b", "a b", long, long + " end", long], [7, 8, 9, 5, 4, 5, None, 6, 6])
    want = [(7, 7, 0), (8, 8, 0), (9, 9, 0), (5, 4, 1), (4, 4, 1), (None, None, 2), (6, None, 2), (6, None, 2)]
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(jaccard.classes(docs).collect()) == key(want)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and key((r.doc_id, r._k) for r in kept.collect()) == key([(i, "a") for i in (7, 8, 9, 4, None)])
    with pytest.raises(TypeError, match="integer"):
        jaccard.classes(docs.selectExpr("'x' as doc_id", "text"))


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_op9_keeps_the_first_of_each_group(spark):
    texts = near_texts()
    root = components(len(texts), near(texts, 0.4))
    assert sorted(r.doc_id for r in jaccard.keep_first(frame(spark, texts)).collect()) == sorted(set(root))


def test_op10(spark):
    turn = lambda role, text: {"role": role, "text": text}
    u, a = turn("user", "hi"), turn("assistant", "yes")
    rows = [
        (1, [u, a, turn("user", "q <|im_end|>"), turn("assistant", "good")], [u, a, turn("user", "q <|im_end|>"), turn("assistant", "bad one"), u], "x"),
        (2, [u, a], [u, a], "x"),
        (3, [u, a], [u], "x"),
        (4, None, [a], "x"),
        (5, None, [], "x"),
        (None, [turn(None, None)], [turn("assistant", "z")], "x"),
    ]
    t = "array<struct<role:string,text:string>>"
    got = {r.pair_id: r for r in chat.format_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {t}, rejected {t}, _c string")).collect()}
    assert set(got) == {1, 3, 4, None} and got[1]._c == "x"
    r = got[1]
    assert r.prompt_turns == 3 and r.prompt.endswith("<|im_start|>user\nq < |im_end|><|im_end|>\n")
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["good<|im_end|>"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_spans] == ["bad one<|im_end|>"]
    assert got[3].rejected == "" and got[3].rejected_spans == [] and got[3].chosen == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert got[None].chosen == "<|im_start|>user\n<|im_end|>\n" and got[None].chosen_spans == []


@pytest.mark.parametrize("ids", [[64 * i for i in range(70)], [i * 10**12 - 5 for i in range(65)], [*range(65)], [3, None], [None, *range(64)]])
def test_op10_pairs_conversations_however_far_apart(spark, ids):
    rows = [(i, t, r, f"{r} {i}") for i in ids for t, r in enumerate(["user", "assistant", "user"])]
    got = {r.pair_id: r for r in chat.pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == set(ids)
    order = sorted(ids, key=lambda i: (i is None, i))
    for n, i in enumerate(order):
        block = order[n // 64 * 64 : n // 64 * 64 + 64]
        other = block[(n % 64 + 1) % len(block)] if len(block) > 1 else order[(n + 1) % len(order)]
        assert [t.text for t in got[i].chosen] == [f"user {i}", f"assistant {i}"]
        assert [t.text for t in got[i].rejected] == [f"user {i}", f"assistant {other}"]


def test_op10_lends_replies_past_conversations_without(spark):
    rows = [(i, 0, "assistant" if i % 100 == 0 else "user", f"t{i}") for i in range(500)]
    got = {r.pair_id: r.rejected[-1].text for r in chat.pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {0: "t100", 100: "t200", 200: "t300", 300: "t400", 400: "t0"}


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.judge(docs, labels).collect() if r.keep}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    root = components(len(rows), near([t for _, t in rows], 0.4))
    rows = [rows[i] for i in sorted(set(root))]
    spans, cut = repeated(rows, 40), []
    for i, t in rows:
        where = [m.span() for m in re.finditer(r"[^\x00-\x20]+", t)]
        for a, b in reversed(spans.get(i, [])):
            t = t[: where[a][0]] + (t[where[b][0] :] if b < len(where) else "")
        if t.strip() or i not in spans:
            cut.append((i, t))
    frame_ = spark.createDataFrame(cut, "doc_id long, text string")
    bad = {r.doc_id for r in templates.find(frame_, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    assert sorted((r.doc_id, r.text) for r in pieces.decode(out).collect()) == [x for x in cut if x[0] not in bad]


def test_stages_keep_the_documents_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_buffers_take_nulls_and_slices():
    import pyarrow as pa

    a = pa.array(["ab", None, "", "cde"])
    data, at = buffers(a.slice(1))
    assert data.tobytes() == b"cde" and at.tolist() == [0, 0, 0, 3]
