"""The numbered operators against brute force, on small fixtures and on the small tables."""

import html as html_module
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import audio, importance, licenses, mixing, neardup, packing, pages, quality_rules, tokens, url_filters
from waymark.llm.components import components
from waymark.llm.words import shingle_set

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = tokens.tokenizer_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False):
    """Documents from texts, with a null id, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("kept", F.lit(7)).withColumn("component", F.lit("x")).withColumn("size", F.lit("y")) if extra else df


def odd_texts():
    long = " ".join(f"w{k}" for k in range(30_000))
    return [None, "", " \n\t ", "one", "a b c d", "a b c d", "A B C D", long, long + " end", "x" * 5000, "\n".join(["same line here"] * 9), "é 日本 <|endoftext|> 👍"]


def brute_components(texts):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        both, small, large = None, *sorted((len(sets[i]), len(sets[j])))
        if not small or 100 * small < 75 * large:
            continue
        both = len(sets[i] & sets[j])
        if 100 * both >= 75 * (small + large - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"v{k}" for k in rng.integers(0, 4000, 150)]
    texts = odd_texts()
    for _ in range(60):  # near copies, many of them just short of the limit from one another
        w = list(base)
        for p in rng.integers(0, 150, rng.integers(0, 9)):
            w[p] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"q{k}" for k in rng.integers(0, 10**6, 40)) for _ in range(40)]
    df = docs_of(spark, texts, extra=True)
    got = neardup.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(list(enumerate(texts)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_near_duplicates_on_the_small_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in df.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()} == want


def test_near_duplicates_of_repeated_and_null_rows(spark):
    two = [(1, "a b c d e f"), (2, "u v w x y z"), (3, "p q r s t"), (5, "u v w x y z"), (5, "a b c d e f"), (5, None)]
    for rows in (two, two[::-1]):  # an id with two texts links what both link with
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(1, 1): 1, (2, 1): 1, (3, 3): 1, (5, 1): 3})
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    a = shingle_set(" ".join(f"w{k}" for k in range(1000)))
    b = shingle_set(" ".join(f"w{k}" for k in range(250, 1250)))
    alike = (neardup.signature(a, 1024) == neardup.signature(b, 1024)).mean()
    assert abs(alike - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.06


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    texts = odd_texts() + ["  two  spaces ", "line\n\nline\n", " \n x", "it's 123 don't", "tab\tand\r\nreturn"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in tokens.count_tokens(docs_of(spark, texts), BPE).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)


def test_long_texts_are_split_safely():
    encoder = tokens.load(BPE)
    text = " ".join(f"wörd{k},\n x" for k in range(400))
    for t in (text, "漢字、" * 300, "x" * 500):
        want = encoder.library.encode(t, add_special_tokens=False).ids
        assert [i for p in tokens.windows(t, 50) for i in encoder.encode(p)] == want == encoder.encode(t).tolist()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = docs_of(spark, texts, extra=True)
    got = packing.pack(df, BPE).collect()
    own, where = defaultdict(list), defaultdict(list)
    for r in got:
        own[r.doc_id].append(r)
        where[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(where) == list(range(len(where)))
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in got) > 0.97 * 2048 * len(where)
    twice = packing.pack(df.filter("doc_id < 5").unionByName(df.filter("doc_id < 5")), BPE)
    assert twice.count() == 10 and twice.select("sequence_id", "offset").distinct().count() == 10
    assert packing.pack(df.filter("false"), BPE).count() == 0


def test_patterns_place_every_length():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 129), 60, replace=False), rng.integers(1, 50, 60), strict=True)}
    placed = Counter()
    for pattern, n in packing.patterns(histogram, 128):
        assert sum(pattern) <= 128 and list(pattern) == sorted(pattern, reverse=True)
        placed.update({k: v * n for k, v in Counter(pattern).items()})
    assert placed == histogram


def test_packs_take_several_pieces_of_one_length(spark):
    assert sum(n for _, n in packing.patterns({100: 1000})) == 50
    assert packing.patterns({1: 5000}) == [((1,) * 2048, 2), ((1,) * 904, 1)]
    for hot in ({200: 30_000, 1500: 700, 348: 300, 1: 9000}, {1: 10**6} | dict.fromkeys(range(1025, 2048), 1)):
        packs = packing.patterns(hot)
        placed = Counter()
        for pattern, n in packs:
            assert sum(pattern) <= 2048
            placed.update({k: v * n for k, v in Counter(pattern).items()})
        assert placed == hot and sum(n for _, n in packs) <= 1.1 * sum(k * n for k, n in hot.items()) / 2048
    df = docs_of(spark, [None] * 3000 + ["the same short text of a few words"] * 1500)
    where = defaultdict(list)
    for r in packing.pack(df, BPE).collect():
        where[r.sequence_id].append((r.offset, r.length))
    filled = sum(length for parts in where.values() for _, length in parts)
    assert sum(map(len, where.values())) == 4500 and len(where) == -(-filled // 2048) and sorted(where) == list(range(len(where)))
    for parts in where.values():
        assert [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(length for _, length in sorted(parts))][:-1]


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeat)


def test_quality_rules(spark):
    small, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_rules.fit_quality_rules(small, labels)
    texts = odd_texts() + [r.text for r in small.collect()]
    df = docs_of(spark, texts, extra=True)
    got = {r.doc_id: r for r in quality_rules.judge(df, model).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    kept = quality_rules.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.judge(df.filter("false"), model).count() == 0
    none = quality_rules.fit_quality_rules(small, labels.filter("false"))
    assert none.forest is None and quality_rules.judge(small, none).filter("kept").count() > 0


def held_out(spark, judge):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = judge(docs, labels.filter("doc_id % 2 = 0"))
    return labels.filter("doc_id % 2 = 1").join(kept, "doc_id").collect()


def test_forest_on_held_out_labels(spark):
    rows = held_out(spark, lambda d, y: quality_rules.judge(d, quality_rules.fit_quality_rules(d, y)))
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.05 and sum(r.quality == 0 and not r.base_failed for r in rows) > 50


def test_importance_on_held_out_labels(spark):
    rows = held_out(spark, lambda d, y: importance.resample(d, importance.fit_importance(d, y))[0])
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.15


def test_importance_against_an_independent_model(spark):
    small, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = [r.text or "" for r in small.orderBy("doc_id").collect()]
    good = {r.doc_id: r.quality for r in labels.collect()}
    ids = [r.doc_id for r in small.orderBy("doc_id").collect()]

    def grams(t):
        b = t.encode()
        return [(int.from_bytes(b[i : i + 4], "big") * 0x9E3779B1 % 2**32) >> 16 for i in range(len(b) - 3)]

    raw, target = Counter(), Counter()
    for i, t in zip(ids, texts, strict=True):
        raw.update(g := grams(t))
        target.update(g if good.get(i) == 1 else [])
    log_p = lambda c, g: np.log((c[g] + 1) / (sum(c.values()) + 65536))
    ratio = {g: log_p(target, g) - log_p(raw, g) for g in raw}
    model = importance.fit_importance(small, labels)
    rows, cut = importance.resample(small, model)
    got = {r.doc_id: r for r in rows.collect()}
    for i, t in zip(ids, texts, strict=True):
        g = grams(t)
        assert abs(got[i].score - (50 * sum(ratio[x] for x in g) / len(g) if g else -1e9)) < 1e-6
    share = np.mean([good[i] for i in ids if i in good])
    k = int(np.ceil(len(ids) * min(1.0, share + 2 * (share * (1 - share) / sum(i in good for i in ids)) ** 0.5)))
    keys = sorted((r.key for r in got.values()), reverse=True)
    assert cut == keys[k - 1] and {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if r.key >= cut and r.score > -1e8}
    noise = np.array([r.key - r.score for r in got.values() if r.score > -1e8])
    assert abs(noise.mean() - 0.5772) < 0.3 and abs(noise.std() - np.pi / 6**0.5) < 0.3
    plain = set(sorted(got, key=lambda i: -got[i].score)[:k])
    assert 0 < len(plain - {i for i, r in got.items() if r.kept}) <= 0.05 * k  # the sample isn't the plain top k


def test_importance_of_odd_rows(spark):
    small, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = importance.fit_importance(small, labels)
    df = docs_of(spark, odd_texts() + [r.text for r in small.collect()], extra=True).withColumn("doc_id", F.expr("nullif(doc_id, 3)"))
    got = importance.resample(df, model)[0].collect()
    assert all(not r.kept for r in got if r.doc_id in (0, 1)) and sum(r.doc_id is None for r in got) == 1
    kept = importance.keep_sampled(df, model)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert importance.fit_importance(small, labels.filter("false")) is None
    assert importance.resample(df.filter("false"), model)[0].count() == 0


def test_gumbel_top_k_samples_by_weight():
    model = importance.Importance(np.zeros(1), 0.5)
    weights = np.log(np.array([8.0, 4.0, 2.0, 1.0, 1.0]))
    import pyarrow as pa

    first = Counter()
    for draw in range(8000):
        first[int(np.argmax(model.keys(pa.array(range(5 * draw, 5 * draw + 5)), weights)))] += 1
    assert np.abs(np.array([first[i] / 8000 for i in range(5)]) - np.exp(weights) / 16).max() < 0.02


def test_kth_largest(spark):
    values = [1.0, 5.0, 5.0, 5.0, 2.0, 1e-300, 7.5, -3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, 9):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "x", 9) == float("-inf") and importance.kth_largest(df, "x", 0) == float("inf")


def test_mixing_meets_its_targets(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, again = mixing.mix(df).collect(), mixing.mix(df).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    text = {r.doc_id: r for r in df.collect()}
    taken, target, longest, sizes = Counter(), {}, Counter(), Counter()
    for r in got:
        assert r.size == len(WORD.findall(text[r.doc_id].text or "")) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        s = text[r.doc_id].source
        taken[s] += r.taken
        sizes[s] += r.size
        target[s] = r.target
        longest[s] = max(longest[s], r.size)
    assert all(r.source_size == sizes[text[r.doc_id].source] for r in got)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-3
    small = docs_of(spark, odd_texts(), extra=True)
    mixed = mixing.apply_mix(small)
    copies = {r.doc_id: r.copies for r in mixing.mix(small).collect()}
    assert mixed.columns == small.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})
    assert mixing.mix(small.filter("false")).count() == 0


def brute_mix(docs, seed="mix"):
    """taken by row, from the rules alone: docs are (id, text, source)."""
    import hashlib
    import math

    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, d in zip(size, docs, strict=True) if d[2] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    goal, free, left = {}, set(sources), sum(size)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * own[s]}
        if not above:
            break
        goal |= {s: 3 * own[s] for s in above}
        left -= sum(3 * own[s] for s in above)
        free -= above
    goal |= share
    taken = [0] * len(docs)
    for s in sources:
        rows = [(i, size[i], str(docs[i][0]) if docs[i][0] is not None else "text:" + hashlib.md5((docs[i][1] or "").encode()).hexdigest()) for i in range(len(docs)) if docs[i][2] == s and size[i]]
        whole = int(goal[s] // own[s]) if own[s] else 0
        quota = goal[s] - whole * own[s] if own[s] else 0
        classes = defaultdict(list)
        for _, n, _ in rows:
            classes[math.floor(math.log2(n) * 16)].append(n)
        low, high = 0.0, 1.0
        for _ in range(200):  # words included on average at a scale
            c = (low + high) / 2
            mean = sum(min(sum(ns), c * sum(n * n for n in ns)) for ns in classes.values())
            low, high = (low, c) if mean > quota else (c, high)
        ranked = defaultdict(list)
        for i, n, key in rows:
            u = (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = min(1.0, high * n)
            ranked[u / (1 - u) * (1 - p) / p, n, key].append(i)
        done = 0
        for key in sorted(ranked):
            amount = key[1] * len(ranked[key])
            if quota <= 0 or 2 * done + amount > 2 * quota:
                break
            done += amount
            for i in ranked[key]:
                taken[i] += size[i]
        for i, n, _ in rows:
            taken[i] += whole * n
    return taken


def test_mixing_against_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(["w"] * int(rng.lognormal(3, 1.2))), [None, "", "a", "b", "é"][rng.integers(0, 5)]) for i in range(1500)]
    docs += [(None, t, "a") for t in ("x y z", "x y z", None, "p q")] + [(7, docs[7][1], docs[7][2])] * 3 + [(8, "other text", "b"), (-5, "huge " * 4000, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("copies", F.lit("x")).withColumn("_u", F.lit(1))
    want = Counter((i, s, t) for (i, _, s), t in zip(docs, brute_mix(docs), strict=True))
    assert Counter((r.doc_id, r.source, r.taken) for r in mixing.mix(df).collect()) == want
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert words == Counter({s: n for s in {d[2] for d in docs} if (n := sum(t for (_, s2, t), k in want.items() if s2 == s for _ in range(k)))})


def test_mixing_includes_documents_as_often_as_it_should(spark):
    rng = np.random.default_rng(6)
    sizes = rng.integers(5, 200, 400).tolist()
    docs = spark.createDataFrame([(i, "w " * n, "xy"[i % 2]) for i, n in enumerate(sizes)], "doc_id long, text string, source string").cache()
    found, draws = np.zeros(400), 40
    for k in range(draws):
        for r in mixing.mix(docs, lambda s: {"x": 1.0, "y": 2.0}, seed=f"draw {k}").collect():
            found[r.doc_id] += r.copies
    rows = mixing.mix(docs, lambda s: {"x": 1.0, "y": 2.0}).collect()
    goal = {r.source: (r.target, r.source_size) for r in rows}
    for s, part in (("x", 0), ("y", 1)):
        target, size = goal[s]
        whole = target // size
        p = np.minimum(1.0, np.array(sizes[part::2]) * (target - whole * size) / sum(n * n for n in sizes[part::2]))
        if p.max() < 1:
            z = (found[part::2] / draws - whole - p) / np.sqrt(p * (1 - p) / draws)
            assert abs(z.mean()) < 0.3 and z.std() < 1.3
        assert np.corrcoef(found[part::2], p)[0, 1] > 0.6


def test_targets_are_capped_and_reshared():
    sizes = {"a": 10, "b": 1000, "c": 10, None: 980}
    got = mixing.targets(sizes, mixing.cycle_weights(list(sizes)))
    assert got["a"] == 30 and got["c"] == 30 and abs(got["b"] / got[None] - 2) < 1e-9 and abs(sum(got.values()) - 2000) < 1e-9


URLS = [
    ("https://Blog.Example.NET/en/1?x", "blog.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    ("http://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"),
    ("http://notexample.com/de/a", "notexample.com", "/de/a", None, None),
    ("http://x.org/fr/y#z", "x.org", "/fr/y", "org/fr/", "allow"),
    ("http://x.net", "x.net", "", None, None),
    (None, "", "", None, None),
    ("no scheme", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("http://www.casino-poker.example.com/bonus", "www.casino-poker.example.com", "/bonus", None, "block"),
    ("http://city-library.example.com/en/7", "city-library.example.com", "/en/7", None, "allow"),
]


def test_url_filters(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filters.filter_urls(df, url_filters.fit_urls(spark)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block") and verdict in (None, got[i].verdict)
    plan = url_filters.filter_urls(df, url_filters.fit_urls(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_url_model_on_held_out_urls(spark):
    """URLs of words that the labelled table hasn't as such."""
    bad = "best-casino-bonus onlinepoker24 sports-betting-tips viagra4u cheap-cialis replicawatches.shop xxxtube freeporn sexdates ads2 adserver1 clicktrack buybacklinks payday-cash loans-payday crackedgames keygens torrents-downloads lottery-winner phishing-kit".split()
    good = "citylibrary universityofx dailyherald cookingrecipes gardenclub historical-society sciencejournal weatherstation artgallery-museum councils schools-online musicschool photographers chessclub mathforum hospitals railways bookreviews translations travelnotes".split()
    urls = [(f"https://www.{w}.example.com/en/{k}" if k % 2 else f"http://{w}.example.org/", w in bad) for k, w in enumerate(bad + good)]
    urls += [("https://ads.example.com/en/5", True), ("http://replica-watches.example.org/", True), ("http://m.thend.example.com/fr/812.html", False)]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in url_filters.filter_urls(df, url_filters.fit_urls(spark)).collect()}
    wrong = [u for k, (u, b) in enumerate(urls) if got[k] != b]
    assert len(wrong) <= 0.12 * len(urls), wrong
    table = [(k, u) for k, (u, _) in enumerate(url_filters.labelled_urls())]
    assert not {u for u, _ in urls} & {u for _, u in table}
    assert url_filters.filter_urls(df.filter("false"), url_filters.fit_urls(spark)).count() == 0


def test_licence_scan(spark):
    model = licenses.fit_licenses()
    texts = odd_texts() + ["Some text.\nReleased under the MIT License.\nMore.", "x\n\nlicensed under the apache license, version 2.0", "She went to MIT.", "Licensed under CC BY-NC 4.0. All of it.", "Er kam mit dem Zug."]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(spark, texts, extra=True), model).collect()}
    n = len(odd_texts())
    assert [got[n + k].license for k in range(5)] == ["MIT", "Apache-2.0", None, "CC-BY-NC", None]
    assert got[n].paragraph == 1 and got[n + 1].paragraph == 2
    assert all(got[i].license is None for i in range(n))
    assert [got[i].n_paragraphs for i in range(5)] == [0, 0, 0, 1, 1]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    families = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License", "GPL-3.0": "GNU General Public License", "CC-BY-NC": "Licensed under CC BY-NC"}
    want = {r.doc_id: next((f for f, s in families.items() if s in r.text), None) for r in df.collect()}
    assert {r.doc_id: r.license for r in licenses.scan_licenses(df, model).collect()} == want


def test_wrapped_licence_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    cc = "This work is licensed under a\nCreative Commons Attribution 4.0\nInternational License."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    texts = [bsd, "Copyright x\n\n" + gpl, cc, mit, gpl.replace("# the Free", "#\n# the Free").replace("GNU", "\n\n"), "It rained.\n" + bsd + "\n\n" + bsd, "Released under the MIT License.\nIt rained.\nMore."]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(spark, texts), licenses.fit_licenses()).collect()}
    assert [got[k].license for k in range(7)] == ["BSD", "GPL-3.0", "CC-BY", "MIT", None, "BSD", "MIT"]
    assert [got[k].n_licensed for k in range(7)] == [1, 1, 1, 1, 0, 2, 1] and got[1].paragraph in (2, 3)
    versions = ["This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 1.", gpl.replace("General", "Affero General"), gpl.replace("General", "Lesser General"), gpl.replace("version 3", "version 2")]
    said = {r.doc_id: r.license for r in licenses.scan_licenses(docs_of(spark, versions), licenses.fit_licenses()).collect()}
    assert [said[k] for k in range(6)] == ["GPL-2.0", "GPL-3.0", None, "AGPL-3.0", "LGPL", "GPL-2.0"]
    narrow = "\n".join(" ".join(w) for w in itertools.batched(gpl.replace("#", "").split(), 6))
    assert licenses.scan_licenses(docs_of(spark, [narrow]), licenses.fit_licenses()).first().license == "GPL-3.0"


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home"><nav><a>menu</a></nav><header>top</header>
<div class="ad">buy</div><article><h1>Head &amp; more</h1><p>One <b>two
 three.<br><p>Four&nbsp;five<script>var a="</p>";</script><aside>side</aside><ul><li>six<li>seven</ul><div class="comments"><p>first!</p></div></article>
<form>mail</form><footer>&copy; x</footer></body></html>"""


def text_of(html, shared=()):
    return pages.main_text(pages.parse(html), set(shared))


def test_pages(spark):
    assert text_of(PAGE) == "Head & more\n\nOne two three.\n\nFour five\n\nsix\n\nseven"
    assert text_of("<article><header><h1>Title</h1></header><p class='article-header'>Lead</p><p>Text <span class='ad'>x</span> on</p></article>") == "Title\n\nLead\n\nText on"
    plain = "<body><div>Shared banner</div><p>{}</p><p>Shared end</p></body>"
    rows = [(1, "http://a.b/x/1", plain.format("own one")), (2, "http://a.b/x/2", plain.format("own two")), (3, "http://z.y/", plain.format("own three")), (4, None, None), (5, "http://a.b/q", PAGE), (5, "http://a.b/q", PAGE), (None, "http://n.n", "<p>" + "word " * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("k1", F.lit("x")).withColumn("lines", F.lit(1))
    got = pages.extract(df).collect()
    text = {r.page_id: r for r in got}
    assert len(got) == 7 and text[3].text == "Shared banner\n\nown three\n\nShared end" and text[4].text == "" and text[None].n_chars == 1_499_999
    assert text[5].text.startswith("Head & more") and all(r.n_chars == len(r.text) for r in got)
    assert text[1].text == "own one" and text[2].text == "own two" and (text[1].n_lines, text[1].n_shared, text[1].n_restored) == (3, 2, 0)
    assert pages.extract(df.filter("false")).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    plain = "<body><div>Shared banner</div><p>{}</p><p>Shared end</p></body>"
    one, two = plain.format("own one"), plain.format("own two")
    rows = [(1, "http://a.b/x/1", one), (2, "http://a.b/x/1?print", one), (3, "http://m.n/p", one), (4, "http://m.n/q", one + "<!-- mirror -->")]
    rows += [(k, "http://r.s/x/1", one) for k in (5, 7, 8, 9)] + [(6, "http://r.s/x/1", two), (10, "http://r.s/x/2", two)]
    rows += [(11, "http://a.b/y", two)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in pages.extract(df).collect()}
    whole = "Shared banner\n\nown one\n\nShared end"
    assert text[1] == text[2] == "own one" and text[11] == "own two" and text[3] == text[4] == whole
    assert [text[k] for k in range(5, 11)] == ["own one", "own two", "own one", "own one", "own one", "own two"]


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_differencing_doesn_t_depend_on_the_borders_of_tasks(spark, parts):
    rng = np.random.default_rng(8)
    lines = [f"line {k}" for k in range(12)]
    rows = []
    for k in range(150):
        host, path = f"h{rng.integers(0, 3)}.x", f"/{rng.integers(0, 4)}/{rng.integers(0, 30)}"
        body = [lines[i] for i in sorted(rng.integers(0, 12, 4))] if k % 3 else lines[:3]  # every third one the same lines
        rows.append((k, f"http://{host}{path}", "".join(f"<div>{x}</div>" for x in body) + f"<!--{k % 9}-->"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    keys = {(r.k1, r.k2): r for r in pages.digests(df).collect()}
    order = sorted(keys, key=lambda k: (keys[k].url.split("/")[2], keys[k].url.split("/", 3)[3], *k))
    body = {k: pages.parse(keys[k].html).lines for k in order}
    want = {}
    for n, k in enumerate(order):
        host, path = keys[k].url.split("/")[2], "/" + keys[k].url.split("/", 3)[3]
        best = []
        for step in (-1, 1):
            m = n + step
            while 0 <= m < len(order) and keys[order[m]].url.split("/")[2] == host and body[order[m]] == body[k]:
                m += step
            if 0 <= m < len(order) and keys[order[m]].url.split("/")[2] == host:
                other = "/" + keys[order[m]].url.split("/", 3)[3]
                alike = next((i for i, (a, b) in enumerate(zip(path, other, strict=False)) if a != b), min(len(path), len(other)))
                best.append((-alike, step, order[m]))
        shared = set(pages.common_lines(body[k], body[min(best)[2]])) if best else set()
        want[k] = "\n\n".join(x for i, x in enumerate(body[k]) if i not in shared)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.k1, r.k2): r.text for r in pages.extract(df).join(pages.digests(df).select("page_id", "k1", "k2"), "page_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == want


def test_main_text_within_a_layout_named_after_its_sidebar():
    text = text_of
    for layout in ("layout has-sidebar", "no-sidebar", "widget"):
        page = f"<body><div class='{layout}'><div>menu</div><article><h1>Head</h1><p>Text<div class='comments'><article>first</article></div></article><p>after</div><p>end"
        assert text(page) == "Head\n\nText\n\nend" and text(page, [4, 5]) == "Head\n\nText"
    assert text("<div class='no-sidebar'><main class='has-sidebar'><p>Text</main></div>") == "Text"
    assert text("<p>Text</p><aside class='x'><article>no</article></aside><div id='comments'><article class='comment'>no</article></div>") == "Text"


def test_common_lines_are_longest():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (tuple(map(str, rng.integers(0, 4, rng.integers(0, 12)))) for _ in "ab")
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        at = pages.common_lines(a, b)
        assert at == sorted(set(at)) and len(at) == best[-1, -1]
        rest = iter(b)
        assert all(a[i] in rest for i in at)


def test_page_texts_of_the_small_table(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    text = {r.page_id: r.text for r in pages.extract(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [html_module.unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert text[r.page_id] == "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())


def test_audio_aligns_shifted_and_noisy_recordings(spark):
    rng = np.random.default_rng(2)
    tunes = [audio.sonify(rng.normal(size=64)) for _ in range(30)]
    recordings = [(i, t) for i, t in enumerate(tunes)]
    recordings += [(100 + i, t + rng.normal(0, 0.01, len(t))) for i, t in enumerate(tunes)]
    recordings += [(200, tunes[0][audio.HOP * 10 :]), (201, tunes[1]), (202, np.zeros(50_000)), (203, np.zeros(10))]
    pcm = [(i, (np.clip(t, -1, 1) * 32000).astype("<i2").tobytes()) for i, t in recordings] + [(None, None)]
    df = spark.createDataFrame(pcm, "rec long, sound binary").withColumn("codes", F.lit(0)).withColumn("class", F.lit(0))
    prints = audio.fingerprints(df, "rec", "sound", audio.pcm16)
    rows = audio.align(prints, F.col("id") < 30).collect()
    match = {(r.id, r.class_id): r for r in rows if r.kind == "match"}
    assert sum(r.kind == "member" for r in rows) == len(pcm)
    assert all((i, i) in match and match[i, i].bit_error_rate == 0 for i in range(30) if i != 201)
    assert sum((i, 100 + i) in match for i in range(30)) >= 27
    assert match[0, 200].offset == 10
    assert not [k for k in match if k[0] < 30 and k[1] < 30 and k[0] != k[1]]
    assert next(r.class_id for r in rows if r.kind == "member" and r.id == 201) == 1


@pytest.fixture(scope="module")
def sounds(spark):
    """500 vectors as sound, and 40 of them, the queries, with noise of eight strengths 5 times each."""
    rng = np.random.default_rng(12)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    known = dict(rows)
    queries = sorted(i for i in known if i % 20 == 0)[:40]
    for n, i in enumerate(q for q in queries for _ in range(5)):
        v = np.array(known[i])
        rows.append((10_001 + 20 * n, (v + rng.normal(0, v.std() * 0.02 * (1 + n % 8), len(v))).tolist()))
    return audio.fingerprints(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), "vec_id", "embedding", audio.sonify).cache()


@pytest.mark.parametrize("frequent", [audio.FREQUENT, 60])
def test_audio_recall_against_brute_force(spark, sounds, frequent, monkeypatch):
    monkeypatch.setattr(audio, "FREQUENT", frequent)
    got = {(r.id, r.class_id) for r in audio.align(sounds, F.col("id") % 20 == 0).collect() if r.kind == "match"}
    codes = {r.id: np.array(r.codes, np.int32).view(np.uint32) for r in sounds.collect()}
    want = set()
    ids = sorted(codes)
    table = np.stack([codes[i] for i in ids])
    for q in [i for i in ids if i % 20 == 0]:
        for shift in range(-4, 5):
            a, b = codes[q][max(0, shift) :], table[:, max(0, -shift) :]
            n = min(len(a), b.shape[1])
            errors = np.bitwise_count(a[:n] ^ b[:, :n]).sum(1) / (32.0 * n)
            want |= {(q, ids[k]) for k in np.flatnonzero(errors <= audio.BIT_ERRORS)}
    others = {p for p in want if p[0] != p[1]}
    print("audio pairs", len(want), len(want & got), len(others), len(others & got), len(got - want))
    assert len(others) > 30 and len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(got)


def test_audio_matches_depend_on_no_other_rows(spark, sounds, monkeypatch):
    """Whether codes count as frequent, as they do in larger tables, changes nothing."""
    matches = lambda df: sorted(tuple(r) for r in audio.align(df, F.col("id") % 20 == 0).collect() if r.kind == "match")
    all_at_once = matches(sounds)
    assert len(all_at_once) > 60
    for frequent in (60, 7):
        monkeypatch.setattr(audio, "FREQUENT", frequent)
        assert matches(sounds) == all_at_once
    some = sounds.filter("id % 3 < 2")
    kept = {r.id for r in some.select("id").collect()}
    assert matches(some) == [m for m in all_at_once if m[1] in kept and m[2] in kept]


def test_the_pipeline_runs_and_keeps_its_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < after.count() and (name == "mixing" or after.count() <= before)
        docs, before = after, after.count()
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 0


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "pipeline"])
def test_every_query_is_registered(name):
    import __spark_entry__

    assert sum(q.startswith(name) for q in __spark_entry__.queries()) == 1


def test_encoder_learns_pieces_together_as_alone():
    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    texts = ["a it's <|endoftext|>b\nc d", " \n\n x\t y", "é日本 !?\r\n 12", "", "w " * 50, "Ġ Ċx\nĠ"]
    for many in (texts, texts * 3000):
        want = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts] * (len(many) // len(texts))
        got = list(encoder.encode_many(many))
        assert np.concatenate([n for n, _ in got]).tolist() == list(map(len, want))
        assert np.concatenate([ids for _, ids in got]).tolist() == list(itertools.chain(*want))
        assert np.concatenate([n for n, _ in encoder.encode_many(many, want_ids=False)]).tolist() == list(map(len, want))
    encoder.cuts = False
    assert [ids.tolist() for _, ids in [next(encoder.encode_many([t])) for t in texts]] == want[: len(texts)]
    pieces = ["one", "\ntwo", "three's", "<|endoftext|>"]
    assert encoder._learn_plain(pieces) == encoder._learn_each(pieces)


def test_marks_behind_words_are_encoded_apart():
    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    given, plain = [], encoder._learn_plain
    encoder._learn_plain = lambda pieces: given.extend(pieces) or plain(pieces)
    words = ["it's.", "x'", "x'.", "don't!", "²", "a²", "日本", "日本語a", "a_b", "_", "ß", "ª", "ŀ", "e\u0301", "a.b", "'s", "<|endoftext|>", "x<|endoftext|>", "endoftext|>", "'", "queen", "\nqueen", "\n", "\n\n", "12", "Ⅷ", "İ"]
    text = "first " + " ".join(w + m for w in words for m in ("", ".", ",", "###", "!!", "_", "|>", "?'", "\u3002", "…", "-1"))
    assert encoder.encode(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    lines = "first queen?\nqueen!!\nqueen queen"
    assert encoder.encode(lines).tolist() == encoder.library.encode(lines, add_special_tokens=False).ids
    assert given.count("queen") >= 1 and given.count("\nqueen") == 1 and not {"queen.", "queen,", "queen###", "queen_", "queen?", "\nqueen!!"} & set(given)
    for content, single, good in (("<|endoftext|>", False, True), ("##", False, True), ("word.", False, False), ("word", True, False), ("<x>", True, False)):
        assert tokens.tailed({"added_tokens": [{"content": content, "single_word": single}]}) is good


def odd_table(spark):
    """Nulls in every column, repeated rows and ids, and columns named like the operators' own."""
    rows = [(None, None, None, None, None), (None, "a b c", None, "s", 5), (3, "x y", "en", None, 3), (3, "x y", "en", None, 3), (3, "other words here", "en", "s", 9)]
    rows += [(100 + i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("n_tokens", "n_bytes", "start", "length", "rank", "kept", "score", "key", "copies", "size", "_size", "_id", "component_id", "high", "features", "license", "found", "lines"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_every_document_operator_on_odd_and_empty_tables(spark):
    df = odd_table(spark)
    n, ids = df.count(), Counter(r.doc_id for r in df.select("doc_id").collect())
    small, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules, weights, licences = quality_rules.fit_quality_rules(small, labels), importance.fit_importance(small, labels), licenses.fit_licenses()
    runs = {
        "tokens": lambda d: tokens.count_tokens(d, BPE), "rules": lambda d: quality_rules.judge(d, rules), "weights": lambda d: importance.resample(d, weights)[0],
        "licences": lambda d: licenses.scan_licenses(d, licences), "mix": mixing.mix, "near": neardup.near_duplicates,
    }
    for name, run in runs.items():
        assert Counter(r.doc_id for r in run(df).collect()) == ids, name
        assert run(df.filter("false")).count() == 0, name
    packed = packing.pack(df, BPE).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == ids and packing.pack(df.filter("false"), BPE).count() == 0
    for keep in (lambda d: quality_rules.keep_good(d, rules), lambda d: importance.keep_sampled(d, weights), neardup.keep_first, mixing.apply_mix):
        got = keep(df)
        assert got.columns == df.columns and set(got.select("doc_id").distinct().toPandas()["doc_id"].fillna(-1)) <= {-1 if i is None else i for i in ids}
        assert keep(df.filter("false")).count() == 0
    assert sum(r.n_tokens for r in tokens.count_tokens(df.filter("text is null"), BPE).collect()) == 0 and n == len(ids) + 3


def test_audio_of_odd_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None), (1, [0.5] * 40), (1, [0.5] * 40), (20, []), (40, [float("nan")] * 40), (60, None)], "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("code", F.lit("x"))
    prints = audio.fingerprints(df, "vec_id", "embedding", audio.sonify)
    rows = audio.align(prints, F.col("id") % 20 == 0).collect()
    assert Counter(r.id for r in rows if r.kind == "member") == Counter([None, 1, 1, 20, 40, 60]) and {r.id for r in rows if r.kind == "match"} == {40}
    assert audio.align(prints.filter("false"), F.col("id") % 20 == 0).count() == 0


def test_class_names_count_as_a_whole():
    text = lambda html: pages.main_text(pages.parse(html), ())
    for name in ("social-history", "post-notice", "comments-on-kant", "menu-of-the-day", "related-work"):
        assert text(f'<div class="{name}"><p>Kept.</p></div>') == "Kept." and text(f'<article><div id="{name}"><p>Kept.</p></div></article>') == "Kept.", name
    for name in ("ad", "social-links", "cookie-notice", "site-header", "x sidebar", "ad_slot-2", "page-menu", "comments"):
        assert text(f'<div class="{name}"><p>Gone.</p></div><p>Kept.</p>') == "Kept.", name


def test_long_and_malformed_pages_take_linear_time_and_little_memory():
    import time
    import tracemalloc

    began = time.time()
    page = pages.parse("<div>" * 100_000 + "</b>" * 100_000 + "text" + "</div>" * 100_000 + "<p>more")
    assert page.lines == ("text", "more") and time.time() - began < 20
    n = 40_000
    a, b = tuple(f"l{k % 30_000}" for k in range(n)), tuple(f"l{(k * 7) % 30_000}" if k % 3 else f"l{k % 30_000}" for k in range(n))
    tracemalloc.start()
    found = pages.common_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) >= n // 3 and peak < 40e6
    it = iter(b)
    assert all(any(x == a[k] for x in it) for k in found)  # a subsequence of b
