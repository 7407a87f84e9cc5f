import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewgraph.llm import lexical_search, packing, prefix_trie
from reviewgraph.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# Ranked lexical search

def best(docs, items, k):
    """Brute force: every score of every document."""
    counts = {d: Counter(TERM.findall((t or "").translate(FOLD))) for d, t in docs}
    n = {d: c.total() for d, c in counts.items() if c}
    total, df = sum(n.values()), Counter(t for c in counts.values() for t in c)
    out = []
    for item, text in items:
        scores = []
        for d in n:
            m = 100 - 50 + 50 * n[d] * len(n) // total
            score = 0
            for t in set(TERM.findall((text or "").translate(FOLD))) & set(counts[d]):
                w = math.floor(1000 * math.log((2 * len(n) + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * counts[d][t] // (1000 * counts[d][t] + 20 * m))
            if score > 0:
                scores.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.expovariate(0.1))}" for _ in range(200)] + ["É", "é", "A", "a-b", "中文"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 10, 10, 40, 200])))
            for _ in range(n)]


SEARCHED = [*enumerate(texts(1, 200)), (900, None), (901, ""), (902, "-- !"), (903, "x\x00y\x7fz"),
            (904, "w1 " * 5000), *((1000 + i, "w1 w2 w3 w2") for i in range(80))]
ASKED = [*enumerate(texts(2, 25)), (97, "x Y z É"), (98, "nowhere"), (99, None)]


@pytest.mark.parametrize("bounds", [{}, {
    "SLICE_POSTINGS": 50, "HELD_POSTINGS": 100, "SUMMED": 37, "BLOCK_TERMS": 60,
    "VOCABULARY_BYTES": 10}])
def test_search_matches_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs = spark.createDataFrame([(*r, "m", 1) for r in SEARCHED],
                                 "doc_id long, text string, term string, n int").repartition(5)
    items = spark.createDataFrame([(*r, 0) for r in ASKED + ASKED[:3]],
                                  "item_id long, text string, rank int")
    got = sorted(map(tuple, lexical_search.ranked_search(docs, items, 7).collect()))
    assert got == best(SEARCHED, ASKED, 7)


def test_search_of_empty_tables_and_rows_without_ids(spark):
    schema = "doc_id long, text string", "item_id long, text string"
    none = [spark.createDataFrame([], s) for s in schema]
    some = [spark.createDataFrame([(1, "a b"), (None, "a"), (1, "a")], s) for s in schema]
    for docs, items in ((none[0], some[1]), (some[0], none[1]), none):
        assert lexical_search.ranked_search(docs, items).collect() == []
    assert [tuple(r)[:3] for r in lexical_search.ranked_search(*some).collect()] == [(1, 1, 1)]


def test_an_index_of_all_terms_serves_any_item(spark):
    docs = spark.createDataFrame(SEARCHED, "doc_id long, text string")
    items = spark.createDataFrame(ASKED, "item_id long, text string")
    index = lexical_search.build_index(docs)
    got = lexical_search.search(index, lexical_search.item_terms(items), 3).collect()
    assert sorted(map(tuple, got)) == best(SEARCHED, ASKED, 3)
    # Every stratum holds one normaliser, its postings by term and falling tf.
    for row in index.strata.collect():
        assert row["terms"] == sorted(row["terms"]) and len(set(row["docs"])) == len(row["docs"])
        for a, b in zip(row["starts"], row["starts"][1:]):
            assert row["tfs"][a:b] == sorted(row["tfs"][a:b], reverse=True) and a < b


def test_strata_below_the_kth_score_are_not_visited(spark, monkeypatch):
    rare = [(i, "needle in " + "hay " * (3 + i % 5)) for i in range(20)]
    docs = rare + [(100 + i, "hay " * (20 + i)) for i in range(60)]
    items = [(1, "needle hay")]
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = index.strata.collect()
    asked = lexical_search._Items([{"item_id": 1, "terms": [
        {"term": t, "df": r["df"]} for r in index.df.collect() for t in [r["term"]]
        if t in ("needle", "hay")]}], index.n_docs)
    floor = best(docs, items, 10)[-1][3]
    bounds = []
    for row in rows:
        held = lexical_search._Stratum(row.asDict(), asked)
        bounds.append(held.bounds[0])
        for _, scores in held.scores(held.bounds > 0):
            assert scores.max() <= held.bounds[0]
    assert sum(b < floor for b in bounds) >= 10


# Conversation prefix trie

def nodes(rows, family=100, most=6):
    """Brute force: all prefixes of all conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m),
                   len(children.get(p, ())), leaves[p], saved[p], hashlib.sha256(",".join(
                       str(c) for c in m if len(whole[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def talk(seed, n):
    rng = random.Random(seed)
    return [(c if c % 7 else -c, t if t % 5 else None, rng.choice(["user", "assistant", None]),
             rng.choice(["a", "b", "cc", None, ""]))
            for c in range(n) for t in range(rng.choice([1, 2, 3, 7, 12]))]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def trie(spark, rows, height):
    turns = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id long, turn long,"
                                  " role string, text string, key string, depth int")
    got = prefix_trie.conversation_trie(turns.repartition(3), height).select(*COLUMNS).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in got)


@pytest.mark.parametrize("height", [8, 3])
def test_trie_matches_brute_force(spark, height):
    rows = talk(1, 150) + [(None, 1, "x", "y")] + [(100, 5, "user", "a")] * 3
    assert trie(spark, rows, height) == nodes(rows)


def test_trie_of_a_long_conversation_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = [(200, t, "user", "ab" * (t % 4)) for t in range(60)]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]
    assert trie(spark, rows, 2) == nodes(rows)


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    assert trie(spark, [], 8) == []
    # It gives up its only turn, and the conversation to borrow from is absent.
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "x")]
    assert trie(spark, rows, 8) == nodes(rows) and trie(spark, rows, 8)[0][:6] == (c, 0, -1, 1, 0, 1)


# Packing

def sound(rows, capacity):
    """Sequences without gaps and overlaps; how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity
    return len(by)


TEXTS = [None, "", "a", "<|endoftext|>x", "é 中文 😀", "word " * 3000, "x" * 9000,
         *(" ".join(f"t{j}" for j in range(i * 7 % 120)) for i in range(150))]


@pytest.mark.parametrize("capacity, task_items", [(2048, 50_000), (64, 20)])
def test_pieces_are_the_library_s_ids_and_sequences_are_sound(spark, capacity, task_items):
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(None, "b", "s", 1), (3, "c", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string, piece int")
    packed = packing.pack(docs.repartition(4), tokenizer_path(), capacity, task_items=task_items)
    got = packed.collect()
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    own = defaultdict(list)
    for r in sorted(got, key=lambda r: r["piece"]):
        own[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"]))
        assert r["length"] == len(r["ids"]) <= capacity
        assert r["length"] == capacity or r["piece"] == 0
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        if i != 3:
            assert [x for r in own[i] for x in r["ids"]] == ids
            assert [r["start"] for r in own[i]] == [
                sum(r["length"] for r in own[i][:k]) for k in range(len(own[i]))]
            assert [r["piece"] for r in own[i]] == list(range(-(-len(ids) // capacity)))
    assert len(own[3]) == 2 and len(own[None]) == 1
    total = sum(r["length"] for r in got)
    assert -(-total // capacity) <= sound(got, capacity) <= total / capacity * 1.1 + 1
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in got:
        assert joined[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]


def test_best_fit_takes_the_least_room_that_fits():
    bins, places, fills = packing.best_fit([6, 5, 4, 3, 2, 10], 10)
    assert (bins, places, fills) == ([0, 1, 0, 1, 1, 2], [0, 0, 6, 5, 8, 0], [10, 10, 10])


def test_rounds_fill_underfull_bins_and_end_when_nothing_fits(spark):
    rng = random.Random(4)
    lengths = [rng.randint(1, 300) for _ in range(2000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    few = packing.placement(items, 1000, 50).join(items, "item").collect()
    assert len(few) == 2000 and sound(few, 1000) <= 1.03 * sum(lengths) / 1000
    large = items.withColumn("length", F.lit(600))
    alone = packing.placement(large, 1000, 50).join(large, "item").collect()
    assert sound(alone, 1000) == 2000
    with pytest.raises(Exception, match="length"):
        packing.placement(items.withColumn("length", F.lit(1001)), 1000).collect()


def test_packing_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, tokenizer_path()).collect() == []
