"""SimHash, spelling variants and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waymark.llm import conversations, queries, simhash, spelling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, print string, word string, n string, component string"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "p", "w", "n", "c") for i, t in rows], DOCS)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def connected(nodes, links):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in nodes}


def plain_print(text):
    words = WORD.findall(low(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def brute_near(rows):
    prints = {(i, t): plain_print(t) for i, t in rows}
    links = [(a[0], b[0]) for a, b in itertools.combinations(prints, 2) if None not in (a[0], b[0]) and bin(prints[a] ^ prints[b]).count("1") <= 2]
    label = connected({i for i, _ in rows if i is not None}, links)
    return sorted([(i, f"{prints[i, t]:016x}", label.get(i)) for i, t in rows], key=str)


def found_near(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_near_prints_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(90)}" for _ in range(rng.choice([4, 40, 400]))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(90)}"
            rows.append((len(rows) * 7 + 3, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "oNE"), (905, "a b"), (906, "a b c"), (907, "é 日本 👍 x"), (908, " ".join(f"w{k}" for k in range(40_000)))]
    got = found_near(simhash.near_prints(docs_of(spark, rows)))
    assert got == brute_near(rows)
    assert len({c for _, _, c in got}) < len(rows) - 30  # there are links


def test_near_prints_of_repeated_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "q r s t u"), (9, "q r s t u"), (2, "q r s t u"), (5, "a b c d"), (None, "a b c d"), (None, None), (7, None), (4, "")]
    got = found_near(simhash.near_prints(docs_of(spark, rows)))
    assert got == brute_near(rows)
    assert [c for i, _, c in got if i == 9] == [2] and [c for i, _, c in got if i is None] == [None, None]
    empty = simhash.near_prints(docs_of(spark, [(1, "a")]).limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "fingerprint", "component_id"]


def test_close_prints_join_what_all_pairs_join(spark):
    rng = random.Random(11)
    prints = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(9)}
    ball = rng.getrandbits(64)
    prints |= {ball ^ (1 << k) for k in range(64)} | {0, 1, 3, 1 << 63, (1 << 63) | 1}
    signed = [int(x) for x in np.array(sorted(prints), np.uint64).view(np.int64)]
    links = simhash.close_prints(spark.createDataFrame([(x,) for x in signed], "print long")).collect()
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    assert all(near(r.a, r.b) for r in links) and len(links) == len({tuple(sorted(r)) for r in links})
    assert connected(signed, [tuple(r) for r in links]) == connected(signed, [p for p in itertools.combinations(signed, 2) if near(*p)])


def test_near_prints_of_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found_near(queries.op11_simhash_near_dedup(spark, SF)) == brute_near(rows)


def brute_spelling(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if k >= 3 and len(w) >= 5}
    cut = defaultdict(set)  # words without one letter: an independent way to near words
    for w in n:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add(w)
    near = {w: set() for w in n}
    for key, words in cut.items():
        for a, b in itertools.permutations(words | ({key} & n.keys()), 2):
            if len(a) != len(b) and key in (a, b) or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted([(w, n[w], form.get(w), root(w), len(near[w]), n.get(form.get(w))) for w in n])


def found_spelling(df):
    assert df.columns == ["word", "n", "form", "root", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def test_spelling_variants_match_brute_force(spark):
    rng = random.Random(3)
    base = ["mangle", "tangle", "aaaaab", "aaaaaa", "étoile", "ÉTOILE", "parapluie", "weather", "Straße", "x" * 300]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rng.choice(base[: 2 + rng.randrange(len(base) - 1)])
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeé") + w[at:], w[:at] + rng.choice("aeé") + w[at + 1 :], w.upper()])
            words.append(w)
        rows.append((i if i % 50 else None, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(900, None), (901, ""), (901, "mangle"), (901, "mangle"), (902, "日本 👍 ab"), (903, "word" * 30_000)]
    rows += [(904, "kettle " * 20 + "kettla " * 8 + "kebtla " * 3)]
    want = brute_spelling(rows)
    assert sum(r[2] is not None for r in want) > 50 and any(r[2] not in (None, r[3]) for r in want)
    assert found_spelling(spelling.group_variants(docs_of(spark, rows))) == want
    assert found_spelling(spelling.group_variants(docs_of(spark, rows).limit(0))) == []
    assert found_spelling(spelling.group_variants(docs_of(spark, [(1, None), (2, "aaa")]))) == []


def test_spelling_variants_of_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found_spelling(queries.op12_spelling_variants(spark, SF)) == brute_spelling(rows)


def test_counts_are_the_same_however_often_tasks_hand_them_on(spark, monkeypatch):
    rows = [(i, f"alpha{'b' * (i % 9)} Gamma deltas") for i in range(300)]
    monkeypatch.setattr(spelling, "FLUSH", 4)
    assert found_spelling(spelling.group_variants(docs_of(spark, rows))) == brute_spelling(rows)


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_neighbourhoods_are_whole_and_distinct(block, monkeypatch):
    monkeypatch.setattr(spelling, "_BLOCK", block)
    letters = "abcé"
    every = np.full((1 << 12) // 64, 2**64 - 1, np.uint64)  # a filter that lets all pass
    words = ["abc", "aab", "éa", "b", "aaaa", "abcéab"]
    found = list(spelling.neighbourhood(words, np.array([ord(c) for c in letters], np.uint32), every))
    assert len(found) == len(set(found))
    for k, w in enumerate(words):
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in letters} - {w}
        assert {x for i, x in found if i == k} == want


#: Edits of a row or before it: letter, cost, the roles' initials that it leaves.
def brute_repair(rows):
    """rows: (conv_id, turn, role, text), each conversation on its own, by dynamic programming over (cost, audit)."""
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    out = []
    for conv, group in of.items():
        kept = []
        for _, turn, role, text in group:
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {t for t, _, _ in kept if t is not None}
        seen, faults = set(), []
        for _, role, text in kept:
            last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        n = len(kept)
        grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        turn_of = {"": "user", "s": "user", "u": "assistant", "a": "user"}
        best = {(n, s): (0, "", []) for s in ("", "a")}
        for i in range(n, -1, -1):
            for _ in range(5):  # rows put in lead from state to state
                for s in ("", "s", "u", "a"):
                    ways = [best[i, s]] if (i, s) in best else []
                    role = turn_of[s]
                    if (i, role[0]) in best:
                        c, a, t = best[i, role[0]]
                        ways.append((c + 5, "I" + a, [f"{role}:", *t]))
                    if i < n:
                        _, own, text = kept[i]
                        if (i + 1, s) in best:
                            c, a, t = best[i + 1, s]
                            ways.append((c + 2, "D" + a, t))
                        if faults[i] in ("", "truncated"):
                            more = 5 if faults[i] else 0
                            if (to := grammar.get((s, own[:1]))) and (i + 1, to) in best:
                                c, a, t = best[i + 1, to]
                                ways.append((c + more, "K" + a, [f"{own}:{text}", *t]))
                            if (i + 1, role[0]) in best:
                                c, a, t = best[i + 1, role[0]]
                                ways.append((c + more + 1, "R" + a, [f"{role}:{text}", *t]))
                    if ways:
                        best[i, s] = min(ways, key=lambda w: w[:2])
        cost, audit, lines = best[0, ""]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found_repairs(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=str)


TURNS = "conv_id long, turn long, role string, text string, pos string, code string, edits string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "p", "c", "e") for r in rows], TURNS)


@pytest.fixture(scope="module")
def odd_turns():
    rng = random.Random(17)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Hi.", "No", "What? ", "", "  ", None, "Fine!\n", "…", "é.\x0b", "Hi."]
    rows = []
    for conv in range(120):
        n = rng.choice([1, 2, 5, 8, 13, 40])
        turns = rng.sample(range(3 * n), n)
        if conv % 10 == 0:
            turns[0] = None
        for k, t in enumerate(sorted(turns, key=lambda t: (t is not None, t))):
            role = ("user", "assistant")[k % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv if conv != 77 else None, t, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(9 * n)}."))
    gone = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:4".encode()) % 20 == 0)
    return rows + [(gone, 4, "user", "All of it goes."), (-3, None, None, None), (5000, 1, "user", "x " * 200_000 + ".")]


@pytest.mark.parametrize("bits", [8, 2, 0])
def test_repairs_match_brute_force(spark, odd_turns, bits):
    got = found_repairs(conversations.repair(turns_of(spark, odd_turns), bits))
    assert got == brute_repair(odd_turns)
    assert {c for r in got for c in r[7]} == set("DKR")  # a row put in costs more than two deletions


def test_a_long_conversation_is_repaired_over_blocks(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), f"T{rng.randrange(2500)}" + rng.choice([".", "", "!"])) for t in range(2500)]
    many = turns_of(spark, rows).repartition(7)
    assert found_repairs(conversations.repair(many, 5)) == brute_repair(rows)


def test_repairs_of_an_empty_table(spark):
    assert found_repairs(conversations.repair(turns_of(spark, [(1, 1, "user", "a")]).limit(0))) == []


def test_repeated_rows_of_one_turn(spark):
    rows = [(1, 2, "user", "Hi.")] * 3 + [(1, 3, "assistant", "Yes.")] * 2
    got = found_repairs(conversations.repair(turns_of(spark, rows)))
    assert got == brute_repair(rows) and got[0][3] >= 3


def test_repairs_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_repairs(queries.op13_conversation_repair(spark, SF)) == brute_repair(rows)


def test_the_ascii_least_of_equally_cheap_edits(spark):
    """Layers and traces of all short rows of codes against the brute force over edit strings."""
    for codes in itertools.product([0, 4, 8, 12, 5, 6], repeat=3):
        s, pieces = conversations.block_edits(list(codes), [0, 1 << 40, 1 << 40, 0], 0)
        best = None
        for n in range(7):
            for edits in itertools.product("DIKR", repeat=n):
                cost, state, i = 0, 0, 0
                for e in edits:
                    if e != "I" and i == len(codes):
                        break
                    role, fault = divmod(codes[i], 4) if e != "I" else (None, 0)
                    to = 2 if state != 2 else 3
                    if e == "K":
                        to = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}.get((role, state))
                    if e in "KR" and fault > 1 or to is None:
                        break
                    cost += {"D": 2, "I": 5, "K": 5 * fault, "R": 1 + 5 * fault}[e]
                    state, i = state if e == "D" else to, i + (e != "I")
                else:
                    if i == len(codes) and state in (0, 3) and (best is None or (cost, edits) < best):
                        best = cost, edits
        assert "".join(pieces) == "".join(best[1]) and s in (0, 3)


def test_sources_are_spark_columns_only(spark):
    """Rows of other types of id are repaired alike."""
    rows = turns_of(spark, [(3, 1, "user", "Hi."), (3, 2, "assistant", "Yes.")]).withColumn("conv_id", F.col("conv_id").cast("string"))
    assert conversations.repair(rows).first().conv_id == "3"
