"""The training-data operators against brute force, exact round trips and held-out accuracy, on small and odd tables."""

import functools
import hashlib
import os
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import base, byte_bpe, chosen_path, decontaminate, exact_dedup, fixity, language_id, pii, quality, suffix_dedup, toxicity

# names that the operators use within, so that they clash
SCHEMA = T.StructType(
    [T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("mark", T.StringType()), ("rid", T.IntegerType()), ("name", T.StringType()), ("k", T.LongType()), ("h", T.LongType()), ("bad_id", T.LongType()), ("k_id", T.LongType()), ("stay", T.LongType()))]
)
R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefghiklmnoprstu") for _ in range(R.randint(2, 9))) for _ in range(300)]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


@functools.lru_cache
def odd_texts():
    passage, long = prose(60), prose(9000)
    near = prose(80).split()
    texts = [None, "", "   \n\t", "a", "A b c", "a b c d e", passage, f"{prose(30)} {passage} {prose(30)}", f"{passage} {prose(5)}", long, long, long.replace(" ", "  "), long + " x", "é" * 500, "😀" * 300, "x" * 5000, "\x00\x01 tab\tline\r\n"]
    for k in range(8):
        w = list(near)
        if k:
            w[k * 9] = f"changed{k}"
        texts.append(" ".join(w))
    texts += [texts[-1], texts[-1].upper(), prose(200), prose(12)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "other words under a known id"), (None, texts[6]), (None, None), (900, texts[20])]
    return spark.createDataFrame([(i, t, "en", "m", 1, "n", 2, 3, i, i, 0) for i, t in rows], SCHEMA)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.limit(0)


def plain(t):
    return "".join(c for c in t or "" if c not in exact_dedup.BLANK)


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_dedup(docs, block):
    rows, groups = pairs_of(docs), defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0, i))
    want = Counter((i, min(g := groups[plain(t)])[3], len(g), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows)
    got = exact_dedup.dedup(docs, block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(x.encode()).hexdigest(): 1 for x in groups})
    assert exact_dedup.dedup(empty(docs)).count() == 0


def test_keep_first_keeps_columns_and_one_of_each(docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(plain(r.text) for r in kept.collect()) == Counter({plain(t): 1 for _, t in pairs_of(docs)})


def test_hot_blocks_get_one_name(spark, monkeypatch):
    monkeypatch.setattr(base, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i, f"t{i % 4} {'y' * 30}" if i % 3 else "hot text that many rows have") for i in range(60)], "doc_id long, text string")
    got = {(r.doc_id, r.group_size, r.keep_id) for r in exact_dedup.dedup(rows, 8).collect()}
    groups = defaultdict(list)
    for r in rows.collect():
        groups[plain(r.text)].append(r.doc_id)
    assert got == {(i, len(g), min(g)) for g in groups.values() for i in g}


def test_byte_bpe_is_the_library(docs):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = Counter((i, struct.pack(f"<{len(x)}I", *x), (t or "").encode()) for i, t in pairs_of(docs) for x in [enc.encode_ordinary(t or "")])
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.encode(docs, path, P.PATTERN).collect()) == want
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in byte_bpe.digests(docs, path, P.PATTERN).collect()) == Counter((i, len(x) // 4, hashlib.sha256(x).hexdigest()) for i, x, _ in want.elements())
    assert byte_bpe.digests(empty(docs), path, P.PATTERN).count() == 0


def brute_repeats(texts, n=suffix_dedup.SPAN):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    for r in raws:
        cover = np.zeros(len(r) + 1, int)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                cover[i] += 1
                cover[i + n] -= 1
        gone = np.cumsum(cover)[: len(r)] > 0
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        yield len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 2])
def test_suffix_dedup(docs, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rows = pairs_of(docs)
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(docs).collect()) == want
    assert suffix_dedup.remove(empty(docs)).count() == 0


def test_suffix_array():
    r = random.Random(1)
    for n in (1, 2, 40, 400):
        for top in (1, 2, 60):
            x = np.array([r.randint(1, top) for _ in range(n)] + [0])
            assert suffix_dedup.suffix_array(x, top) == sorted(range(n + 1), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("tile", [chosen_path.TILE, 3])
def test_chosen_path(docs, tile, monkeypatch):
    monkeypatch.setattr(chosen_path, "TILE", tile)
    rows = pairs_of(docs)
    sets = [frozenset(chosen_path.shingles(t).tolist()) for _, t in rows]
    kinds = sorted(set(sets) - {frozenset()}, key=sorted)
    near = {s: [t for t in kinds if t != s and len(s & t) >= 0.8 * len(s | t)] for s in kinds}
    root = {}
    for s in kinds:
        todo, seen = [s], {s}
        while todo:
            for t in near[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        root[s] = seen
    ids = lambda group: min((i is None, i or 0, i) for (i, _), s in zip(rows, sets, strict=True) if s in group)[2]
    want = Counter((i, ids(root[s]), ids({s}), sets.count(s), len(near[s])) if s else (i, i, i, 1, 0) for (i, _), s in zip(rows, sets, strict=True))
    got = chosen_path.join(docs)
    assert Counter((r.doc_id, r.class_id, r.set_id, r.set_size, r.n_links) for r in got.collect()) == want
    assert any(n > 1 for *_, n in want)
    kept = chosen_path.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({frozenset(map(frozenset, root[s])) for s in kinds}) + sets.count(frozenset())
    assert chosen_path.join(empty(docs)).count() == 0


def test_chosen_path_splits_to_the_end(spark, monkeypatch):
    """Large buckets: a passage that many share, and a large group of near copies; links of ids divisible by 20 against all rows."""
    monkeypatch.setattr(chosen_path, "SMALL", 2)
    monkeypatch.setattr(chosen_path, "TILE", 40)
    monkeypatch.setattr(chosen_path, "TILE_SHINGLES", 3000)
    monkeypatch.setattr(base, "HOT_ROWS", 30)
    r = random.Random(31)
    passage, seed, rows = prose(60, r), prose(120, r).split(), []
    for i in range(160):
        rows.append((i, f"{passage} {prose(60, r)}"))
    for i in range(160, 280):
        w = list(seed)
        w[r.randrange(120)] = f"w{i}"
        rows.append((i, " ".join(w)))
    for i in range(280, 600):
        if i % 2:
            w = rows[-1][1].split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"v{i}"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, prose(100, r)))
    sets = {i: set(chosen_path.shingles(t).tolist()) for i, t in rows}
    near = {(i, j) for i in sets for j in sets if i < j and (i % 20 == 0 or j % 20 == 0) and sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {x.doc_id: x for x in chosen_path.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = sum(got[i].class_id == got[j].class_id for i, j in near)
    assert len(near) > 300 and met >= 0.9 * len(near)
    links = {i: len({frozenset(sets[j]) for j in sets if sets[j] != sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}) for i in sets if i % 20 == 0}
    assert sum(got[i].n_links == n for i, n in links.items()) >= 0.9 * len(links)
    assert all(got[i].class_id == i and got[i].n_links == 0 for i in range(160))


def test_rows_of_a_chain_stay_linear(spark, monkeypatch):
    """One long chain of links, each text near to a few others alone: rows dealt to tiles don't grow with the square of the component."""
    monkeypatch.setattr(chosen_path, "SMALL", 40)
    monkeypatch.setattr(chosen_path, "TILE", 60)
    dealt, tiles = [], chosen_path._tiles
    monkeypatch.setattr(chosen_path, "_tiles", lambda rows, *rest: dealt.append((rows.count(), (out := tiles(rows, *rest)).count())) or out)
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghiklmno") for _ in range(6)) for _ in range(6200)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 100])) for i in range(1200)]
    got = {x.doc_id: x for x in chosen_path.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {x.class_id for x in got.values()} == {0}
    assert sum(x.n_links == (min(i, 2) + min(1199 - i, 2)) for i, x in got.items()) >= 0.99 * len(rows)
    runs = chosen_path.runs_for(3)
    assert len(dealt) == 2 and all(out == into <= 4 * runs * len(rows) for into, out in dealt)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_documents(spark):
    """Ids divisible by 20 against all rows of documents, as the module stands; what shares a shingle is found by an index here."""
    docs = base.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    rows = {r.doc_id: frozenset(chosen_path.shingles(r.text).tolist()) for r in docs.collect()}
    got = {r.doc_id: r for r in chosen_path.join(docs).collect()}
    asked = [i for i in rows if i % 20 == 0]
    wanted, index = set().union(*(rows[i] for i in asked)), defaultdict(set)
    for kind in set(rows.values()):
        for h in kind & wanted:
            index[h].add(kind)
    near = {i: {k for k in set().union(*(index[h] for h in rows[i])) if k != rows[i] and len(rows[i] & k) >= 0.8 * len(rows[i] | k)} for i in asked}
    assert sum(map(len, near.values())) >= 20 and len(got) == len(rows)
    assert sum(got[i].n_links for i in asked) >= 0.9 * sum(map(len, near.values())) and all(got[i].n_links <= len(near[i]) for i in asked)


def test_survival_and_runs():
    assert chosen_path.survival(0) == 1 and abs(chosen_path.survival(1) - (1 - 0.2 * 0.8)) < 1e-9
    for depth in (1, 3, 8):
        assert 1 - (1 - chosen_path.survival(depth)) ** chosen_path.runs_for(depth) >= chosen_path.RECALL


def test_shingles_are_of_words():
    same = lambda a, b: chosen_path.shingles(a).tolist() == chosen_path.shingles(b).tolist()
    assert same("One, two three FOUR five six", "one two  three four. five six\n") and not same("a b c d e f", "a b c d e g")
    assert len(chosen_path.shingles("a b c d e f")) == 2 and len(chosen_path.shingles("a b")) == 1 and len(chosen_path.shingles(None)) == 0


def test_decontaminate(spark, docs):
    texts = odd_texts()
    items = [(1, texts[6]), (2, " ".join(texts[6].split()[:20])), (3, None), (4, "..."), (5, "A B"), (6, prose(30)), (7, " ".join(texts[9].split()[4000:4010] + ["zzz"])), (None, texts[20])]
    table = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: decontaminate_words(t)
    want = set()
    for j, item in items:
        w = words(item)
        if not w:
            continue
        k = min(5, len(w))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i, t in pairs_of(docs):
            v = words(t)
            share = len(s & {tuple(v[x : x + k]) for x in range(len(v) - k + 1)}) / len(s)
            if share >= 0.8:
                want.add((i, j, round(share, 9)))
    got = decontaminate.contaminated(docs, table)
    assert {(r.doc_id, r.item_id, round(r.containment, 9)) for r in got.collect()} == want and len(want) > 8
    bad = {i for i, _, _ in want}
    assert Counter(r.doc_id for r in decontaminate.clean(docs, table).collect()) == Counter(i for i, _ in pairs_of(docs) if i not in bad)
    assert decontaminate.contaminated(empty(docs), table).count() == 0 and decontaminate.contaminated(docs, table.limit(0)).count() == 0


def test_a_leak_takes_only_its_own_row(spark, docs, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    passage, clean = prose(40, r), [prose(30, r) for _ in range(3)]
    rows = [(None, f"{clean[0]} {passage}"), (None, clean[0]), (None, None), (5, passage), (5, clean[1]), (6, clean[2]), (7, passage)]
    table = spark.createDataFrame([(i, t, "en", "m", 1, "n", 2, 3, i, i, 0) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.drop_leaks(spark, table, str(tmp_path))
    assert left.columns == table.columns and Counter(pairs_of(left)) == Counter([(None, clean[0]), (None, None), (5, clean[1]), (6, clean[2])])
    items = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == docs.count() and decontaminate.without_leaks(empty(docs), items).count() == 0


def decontaminate_words(t):
    import regex

    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())


def test_language(spark, docs):
    r = random.Random(2)
    sounds = {"aa": "aeiou", "bb": "klmnp", "cc": "xyzwq"}
    line = lambda k: " ".join("".join(r.choice(sounds[k] + "rst") for _ in range(r.randint(2, 8))) for _ in range(30))
    rows = [(i, line(k), k) for i, k in enumerate(r.choice(list(sounds)) for _ in range(300))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(table, F.col("doc_id") % 3 != 0)
    got = {x.doc_id: x for x in language_id.predict(table, model).collect()}
    held = [x for x in rows if x[0] % 3 == 0]
    assert sum(got[i].lang_pred == k for i, _, k in held) >= 0.97 * len(held) and all(0 <= x.score <= 1 for x in got.values())
    odd = language_id.predict(docs, model).collect()
    assert len(odd) == docs.count() and all((x.lang_pred == "und") == x.und for x in language_id.predict(docs, model).join(docs.groupBy("doc_id").agg(F.min((~F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).cast("int")).cast("boolean").alias("und")), "doc_id").where("doc_id <> 3").collect())
    none = language_id.learn(table.limit(0), F.lit(True))
    assert {x.lang_pred for x in language_id.predict(table, none).collect()} == {"und"}
    long, text = "ab" * language_id.PIECE, "ab" * 40
    assert abs(np.array(model.logits(long)) - np.array(model.logits(text))).max() < 0.2


def test_quality(spark, docs):
    r = random.Random(3)
    good = [(i, ". ".join(prose(9, r).capitalize() for _ in range(r.randint(2, 12))), 1) for i in range(150)]
    bad = [(1000 + i, r.choice([" ".join(w.upper() + "!!" for w in prose(60, r).split()), " ".join(w + "###" for w in prose(60, r).split()), "spam " * 60]), 0) for i in range(80)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.learn(rows, rows.select("doc_id", "quality").where("doc_id % 3 <> 1"))
    held = quality.score(rows, model).join(rows.select("doc_id", "quality"), "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([x.predicted == x.quality for x in held]) >= 0.95
    assert len(model.pairs) == quality.PAIRS
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in odd)
    blank = quality.learn(rows.limit(0), rows.select("doc_id", "quality").limit(0))
    assert {x.score for x in quality.score(docs, blank).collect()} == {0.5}


def test_toxicity(spark, docs):
    r = random.Random(4)
    rude = [f"rude{k}" for k in range(4)]
    rows = []
    for i in range(400):
        w = prose(40, r).split()
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(40)] = r.choice(rude) if r.random() < 0.6 else "snarl" + "".join(r.choice("abcde") for _ in range(5))
        rows.append((i, " ".join(w), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table, table.select("doc_id", "toxic").where("doc_id % 3 <> 1"))
    held = toxicity.score(table, model).withColumnRenamed("toxic", "said").join(table.select("doc_id", "toxic"), "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([x.said == x.toxic for x in held]) >= 0.97
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count()
    kept = toxicity.not_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == odd.where("toxic = 0").count()
    none = toxicity.learn(table, table.select("doc_id", "toxic").limit(0))
    assert toxicity.score(table, none).where("toxic = 1").count() == 0


def test_chain_meets_out_of_fold_probabilities():
    bags = [toxicity.bag(f"{'grim' if i % 2 else 'fine'} {prose(5)}") for i in range(60)]
    model = toxicity.train(bags, np.arange(60) % 2)
    assert [len(b) for b in model.before] == [0, 1, 2]


def test_pii_base_spans():
    text = "Write a.b@c.example.com or +1 (826) 555-4081; 10.0.0.1 not 300.1.1.1, card 4111 1111 1111 1111."
    found = {(k, text[a:b]) for k, a, b in pii.base_spans(text)}
    assert found == {("email", "a.b@c.example.com"), ("phone", "+1 (826) 555-4081"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111")}
    r = random.Random(6)
    for _ in range(300):
        t = "".join(r.choice("a1.@+- (9b") for _ in range(60))
        for kind in pii.KINDS:
            import re

            want = [(kind, m.start(), m.end()) for m in re.finditer(pii.PATTERNS[kind], t) if pii._valid(kind, m.group())]
            assert [s for s in pii.base_spans(t) if s[0] == kind] == want
    assert pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@") == []


def test_pii_network(docs):
    net, data = pii.new(), pii.labelled(2)
    codes, tags = pii._codes(data[0][0])[None, :16], pii._tags(len(data[0][0]), data[0][1])[None, :16]
    _, grads = pii.loss(net, codes, tags)
    r = np.random.default_rng(0)
    for part, grad in zip(net.parts(), grads, strict=True):
        at = tuple(r.integers(0, s) for s in part.shape)
        old = part[at]
        part[at] = old + 1e-5
        up = pii.loss(net, codes, tags)[0]
        part[at] = old - 1e-5
        down = pii.loss(net, codes, tags)[0]
        part[at] = old
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-5
    net = pii.standard()
    right = total = 0
    for text, spans in pii.labelled(60, seed=50):
        gold = pii._tags(len(text), spans)
        right += (pii.tags_of(net, text) == gold).sum()
        total += len(text)
    assert right / total > 0.93
    rows = pii.find(docs, net).collect()
    assert len(rows) == docs.count()
    far = "x" * 3_000 + " a@b.co " + "y" * 3_000
    first, every = pii.spans_of(net, far)
    assert first == [("email", 3001, 3007)] and set(first) <= set(every)


def test_pii_find_as_a_whole(spark):
    """find() against spans put together here, and how well the net finds values that it hasn't seen."""
    net, lines = pii.standard(), pii.labelled(150, seed=77)
    docs = spark.createDataFrame([(f"d{i}", t) for i, (t, _) in enumerate(lines)] + [("none", None), ("none", "")], "doc_id string, text string")
    got = {}
    for x in pii.find(docs, net).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in x.spans.split(",") if s)]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        got[x.doc_id] = spans, x.base_sha256
    right = said = wanted = 0
    for i, (text, gold) in enumerate(lines):
        import re

        first = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(pii.PATTERNS[k], text) if pii._valid(k, m.group())]
        spans, digest = got[f"d{i}"]
        assert digest == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in first).encode()).hexdigest() and set(first) <= set(spans)
        for k, a, b in set(spans) - set(first):
            digits = re.sub("[^0-9]", "", text[a:b])
            assert k == "email" or all(int(x) <= 255 for x in re.findall("[0-9]+", text[a:b])) if k != "card" and k != "phone" else len(digits) >= 9
            assert k != "card" or pii._luhn(digits)
        right += len(set(spans) & set(gold))
        said += len(spans)
        wanted += len(gold)
    assert got["none"] == ([], hashlib.sha256(b"").hexdigest())
    assert right >= 0.85 * said and right >= 0.8 * wanted
    for text in ("host 300.1.1.1 down", "pay 1234 5678 9012 3456 now"):
        assert pii.spans_of(net, text) == ([], [])


def test_pii_query_counts_base_spans(spark, tmp_path):
    """The query's counts and digest are those of the base patterns alone, also where the net adds spans; all spans stand in ``spans``."""
    import re

    texts = [None, "", "\x00 a@b.co \U0001f600 10.0.0.1", "mail jane.doe[at]example[dot]org or a.b@c.example.com", "00010.0.0.255 1.2.3.4.5.6.7.8 256.1.1.1", *(t for t, _ in pii.labelled(60, seed=78))]
    spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    wanted = [[(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(pii.PATTERNS[k], t or "") if pii._valid(k, m.group())] for t in texts]
    counts = [[rows[f"d{i}"][f"n_{k}"] for k in pii.KINDS] for i in range(len(texts))]
    assert counts == [[sum(w[0] == k for w in want) for k in pii.KINDS] for want in wanted]
    added = 0
    for i, want in enumerate(wanted):
        x, joined = rows[f"d{i}"], [f"{k}:{a}:{b}" for k, a, b in want]
        assert x.base_spans == ",".join(joined) and x.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        every = [s for s in x.spans.split(",") if s]
        assert set(joined) <= set(every) and [x[f"all_{k}"] for k in pii.KINDS] == [sum(s.startswith(f"{k}:") for s in every) for k in pii.KINDS]
        added += len(every) - len(joined)
    assert added > 20


def test_pii_decodes_all_that_can_hold_a_span(monkeypatch):
    net, r = pii.standard(), random.Random(7)
    for value in ("jane.doe[at]example[dot]org", "tom_lind(at)webpost.de"):
        text = f"{prose(400, r)} {value} {prose(400, r)}"
        at = text.index(value)
        assert pii.spans_of(net, text) == ([], [("email", at, at + len(value))])
    texts = ["", "ab:cd:ef:ab:cd:ef:ab:cd", f"{prose(30, r)} {'abcd:' * 8} {prose(30, r)}", *(t for t, _ in pii.labelled(40, seed=60))]
    for _ in range(80):
        values = [pii._value(r.choice(pii.KINDS), r) if r.random() < 0.7 else "".join(r.choice("ab1:.@[]() (at)") for _ in range(80)) for _ in range(3)]
        texts.append(" ".join(f"{v} {prose(r.randint(0, 40), r)}" for v in values))
    some = [pii.spans_of(net, t) for t in texts]
    monkeypatch.setattr(pii, "stretches", lambda t: [(0, len(t))] if t else [])
    assert some == [pii.spans_of(net, t) for t in texts]


def brute_audit(first, second):
    """(file, record_id, state) of rows (file, record_id, record): same id and content match, the rest of an id has changed."""
    one, two = (Counter((f, i, t or "") for f, i, t in x) for x in (first, second))
    gone, new = (Counter((f, i) for (f, i, _), n in x.items() for _ in range(n)) for x in (one - two, two - one))
    changed = gone & new
    return Counter({(*k, "changed"): n for k, n in changed.items()} | {(*k, "missing"): n for k, n in (gone - changed).items()} | {(*k, "added"): n for k, n in (new - changed).items()})


def audited(got):
    return Counter((r.file, r.b_record_id if r.state == "added" else r.a_record_id, r.state) for r in got.collect())


@pytest.mark.parametrize("fan", [16, 3])
def test_fixity(spark, fan, monkeypatch):
    monkeypatch.setattr(fixity, "FAN", fan)
    r = random.Random(12)
    rows = [(f, i, f"record {f} {i} {'x' * (i % 7)}", "h") for f in range(3) for i in range(100)] + [(7, None, None, "h"), (7, None, None, "h"), (7, None, "x", "h"), (8, 4, "same id", "h"), (8, 4, "same id", "h"), (8, 4, "other", "h")]
    schema = "file int, record_id long, record string, hash string"
    first = spark.createDataFrame(rows, schema)
    assert fixity.audit(first, first).count() == 0 and fixity.audit(first.limit(0), first.limit(0)).count() == 0
    cases = [[x for x in rows if x[:2] != (1, k)] for k in (0, 50, 99)] + [[*rows, (0, k, "new", "h")] for k in (-1, 50, 500)]
    messy = [x for x in rows if r.random() > 0.05] + [(f, r.randrange(120), "extra", "h") for f in (0, 1) for _ in range(4)] + [(9, 1, "new file", "h")]
    messy = [(f, i, t + "!" if t and r.random() < 0.05 else t, h) for f, i, t, h in messy if (f, i) != (2, 0)]
    for other in [cases[1], cases[4], messy] if fan == 3 else [*cases, messy, []]:
        got = audited(fixity.audit(first, spark.createDataFrame(other, schema)))
        assert got == brute_audit([x[:3] for x in rows], [x[:3] for x in other])
    lost = fixity.audit(first, spark.createDataFrame(cases[1], schema)).collect()
    assert [(x.state, x.a_record_id, x.a_pos, x.b_pos) for x in lost] == [("missing", 50, 50, None)]


def test_equal_records_fill_many_files(spark, monkeypatch):
    monkeypatch.setattr(fixity, "FILE_RECORDS", 100)
    monkeypatch.setattr(base, "HOT_ROWS", 50)
    rows = [(7, "u", "same")] * 1000 + [(None, None, None)] * 300 + [(k, f"u{k}", "x" * (k % 40)) for k in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    dealt = fixity.files(pages)
    assert Counter((x.page_id, x.url, x.html) for x in dealt.collect()) == Counter(rows)
    sizes = [x["count"] for x in dealt.groupBy("file").count().collect()]
    assert max(sizes) <= 500 and dealt.where("page_id = 7").select("file").distinct().count() >= 5
    again = fixity.files(pages.repartition(7))
    by = lambda df: Counter((x.file, x.page_id, x.html) for x in df.collect())
    assert by(dealt) == by(again) and fixity.files(pages.limit(0)).count() == 0


def test_fixity_query(spark, tmp_path):
    import zlib

    page = "page_id long, url string, html string"
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" if i % 50 else None) for i in range(600)] + [(None, "http://none", "x"), (5, "http://h/5", "<p>5</p>")]
    spark.createDataFrame(pages, page).write.parquet(str(tmp_path / "pages.parquet"))
    want = Counter()
    for i, _, html in pages:
        r = zlib.crc32(str(i).encode()) % 97 if i is not None else 0
        want[i, "missing" if r == 5 else "changed" if r in (3, 7) and html else "intact"] += 1
        want[i, "added"] += r == 11
    got = Counter((x.page_id, x.state) for x in fixity.op7_fixity(spark, str(tmp_path)).collect())
    assert got == +want and {s for _, s in got} == {"intact", "changed", "missing", "added"}
    spark.createDataFrame([], page).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert fixity.op7_fixity(spark, str(tmp_path / "none")).count() == 0


def test_ids_come_back_as_they_are(spark, tmp_path):
    """A doc_id that is a string, in every operator that carries it."""
    r = random.Random(14)
    rows = [(f"a{i}", prose(30, r), ["en", "de"][i % 2], i % 2, int(i % 5 == 0)) for i in range(40)] + [("a3", None, None, 1, 0), (None, prose(9, r), "en", None, None)]
    t = spark.createDataFrame(rows, "doc_id string, text string, lang string, quality int, toxic int")
    ids = Counter(x[0] for x in rows)
    model = toxicity.learn(t, t.select("doc_id", "toxic"))
    made = [toxicity.score(t, model), quality.score(t, quality.learn(t, t.select("doc_id", "quality"))), language_id.predict(t, language_id.learn(t, F.lit(True))), pii.find(t, pii.standard()), exact_dedup.dedup(t), chosen_path.join(t), suffix_dedup.remove(t)]
    if (P := pytest.importorskip("public_tokenizers")) is not None:
        made.append(byte_bpe.digests(t, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    for df in made:
        assert Counter(x.doc_id for x in df.select("doc_id").collect()) == ids
    assert toxicity.not_toxic(t, model).columns == t.columns


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 10), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {(r.node, r.root) for r in base.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)} | {(i, 10) for i in range(10, 15)} | {(i, 100) for i in range(100, 141)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    r = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        w = prose(40, r).split()
        if i % 6 == 0:
            w[3] = "vileword"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 0)))
    passage = prose(40, r)
    rows += [(500, rows[1][1]), (501, rows[1][1] + " "), (502, rows[2][1] + " tail"), (503, f"{prose(30, r)} {passage} {prose(30, r)}"), (504, None)]
    for name, data, schema in (("documents", rows, "doc_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, passage)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    none = tmp_path / "none"
    for name, schema in (("documents", "doc_id long, text string, k_id long, mark string"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(none / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
    left = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert left == {i for i in range(240) if i % 6 and i not in (1, 2)} | {501, 2, 504}


def test_pii_one_best_sequence_over_all_windows(monkeypatch):
    """viterbi() against all sequences; tags_of() against one plain pass over scores blended character by character."""
    import itertools

    r = np.random.default_rng(4)
    e, trans = r.normal(size=(4, 3, 3)), r.normal(size=(3, 3))
    lengths = np.array([4, 2, 1])
    got = pii.viterbi(e, trans, lengths)
    for k, n in enumerate(lengths):
        def total(tags, k=k):
            return sum(e[t, k, x] for t, x in enumerate(tags)) + sum(trans[a, b] for a, b in itertools.pairwise(tags))

        assert tuple(got[k, :n]) == max(itertools.product(range(3), repeat=int(n)), key=total)

    net, half, draw = pii.standard(), pii.WINDOW // 2, random.Random(11)
    texts = [t for t, _ in pii.labelled(12, seed=91)] + ["1", "7" * 31, "4 " * 16, "4 " * 16 + "4", "12. " * 40, prose(60, draw) + " +49 301 555 1234"]
    monkeypatch.setattr(pii, "stretches", lambda t: [(0, len(t))])
    for text in texts:
        codes = np.concatenate([pii._codes(text), np.zeros(2 * pii.WINDOW, np.int64)])
        rows = [([], []) for _ in text]
        for at in range(0, max(1, len(text) - half), half):
            window = pii.scores(net, codes[None, at : at + pii.WINDOW])[0][:, 0]
            for t in range(min(pii.WINDOW, len(text) - at)):
                rows[at + t][0].append(window[t])
                rows[at + t][1].append(min(t + 1, pii.WINDOW - t))
        best, back = None, []
        for scored, weights in rows:
            here = sum(s * w for s, w in zip(scored, weights, strict=True)) / sum(weights)
            if best is None:
                best = here
                continue
            step = best[:, None] + net.trans
            back.append(step.argmax(0))
            best = step.max(0) + here
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        assert pii.tags_of(net, text).tolist() == tags[::-1]
    value = "jane.doe" * 9 + "[at]example[dot]org"  # a run of tags that goes on is followed to both ends
    text = f"{prose(60, draw)} {value} {prose(60, draw)}"
    at = text.index(value)
    for k in range(len(value)):
        monkeypatch.setattr(pii, "stretches", lambda t, k=k: [(at + k, at + k + 1)])
        assert pii.spans_of(net, text) == ([], [("email", at, at + len(value))])
