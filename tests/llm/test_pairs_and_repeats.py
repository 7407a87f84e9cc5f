import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from reviewgraph.llm import components, jaccard_join, substring_dedup
from reviewgraph.llm.decontamination import benchmark_leaks, common_subsequence
from reviewgraph.llm.run_index import repeated_windows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def linked(rows, size, percent):
    """Brute force: set size and smallest reachable document."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets[i] = ({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size
                   else {tuple(w)} if w else set())
    group = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i: (len(s), group[i]) for i, s in sets.items()}


def families(seed, n, sizes):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = []
    for k in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        for i in range(25):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((k * 100 + i, " ".join(own)))
    return rows


EDGES = [(10_000 + i, t) for i, t in enumerate(
    [None, "", " \n", "a", "A", "a b", "a  B", "b a", "a b c", "A b\nc", "a b c d", "a b c d"])]


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, monkeypatch, size, percent):
    monkeypatch.setattr(jaccard_join, "SLICE_MEMBERS", 7)
    monkeypatch.setattr(jaccard_join, "SLICE_OTHERS", 4)
    rows = families(size, 8, [4, 12, 40, 150]) + EDGES
    docs = frame(spark, [(*r, "x", 1) for r in rows],
                 "doc_id long, text string, key string, n int")
    got = jaccard_join.jaccard_components(docs, size=size, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} \
        == linked(rows, size, percent)
    assert len(got) == len(rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, "a"), (3, "z")]
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == {(1, 2, 1), (2, 2, 1), (3, 1, 3)}
    assert len(got) == 3
    assert jaccard_join.jaccard_components(frame(spark, [])).collect() == []


def test_keys_are_made_and_moved_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 3, 7), (2, 3, 7), (3, 3, 7), (3, 3, 8), (4, 3, 9)],
                                 "doc_id long, class int, key long")
    first = spark.createDataFrame([(1,), (2,), (4,)], "doc_id long")
    monkeypatch.setattr(jaccard_join, "stored", lambda df: df)
    kept = jaccard_join._shared_keys(rows, first)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key") == 1
    assert sorted(map(tuple, kept.collect())) == [(1, 3, 7), (2, 3, 7)]


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(1, 61)}, 101: 100}


def without_repeats(rows, size):
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[k:k + size] for b in raw.values() for k in range(len(b) - size + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k:k + size]] > 1:
                gone[k:k + size] = b"\1" * size
        kept = bytes(x for x, f in zip(b, gone) if not f)
        spans = sum(f and not (k and gone[k - 1]) for k, f in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    words = ["é", "the", "of", "ab", "a", "xyz", "lorem", "ñandu"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 20, 80]))) for _ in range(12)]
    rows = [(900, None), (901, ""), (902, "aaaa"), (903, "aaaa"), (904, "ab " * 150)]
    for i in range(150):
        own = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own) + (rng.choice(base) if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("size, limits", [
    (40, {}), (40, {"REGION_BYTES": 2000, "INDEX_BYTES": 700}),
    (33, {"REGION_BYTES": 150, "INDEX_BYTES": 100, "RUN": 5, "CHUNK": 64})])
def test_repeats_match_brute_force(spark, monkeypatch, size, limits):
    for name, value in limits.items():
        monkeypatch.setattr(substring_dedup, name, value)
    rows = passages(size)
    docs = frame(spark, [(*r, 5) for r in rows], "doc_id long, text string, region long")
    got = substring_dedup.remove_repeats(docs, size=size).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"],
                          hashlib.sha256(r["kept"]).hexdigest()) for r in got} \
        == without_repeats(rows, size)
    assert len(got) == len(rows)


def test_repeats_of_an_empty_table_and_repeated_rows(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []
    got = substring_dedup.remove_repeats(frame(spark, [(1, "x" * 30), (1, "x" * 30), (None, "y")]),
                                         size=29).collect()
    assert [(r["doc_id"], r["n_removed"]) for r in got] == [(1, 30)]


def test_run_index_matches_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        letters = rng.choice([b"ab", b"a", b"\0a", bytes(range(40))])
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 50)))
                  for _ in range(rng.randint(1, 6))]
        size = rng.choice([1, 3, 8, 9, 17])
        count = Counter(p[i:i + size] for p in pieces for i in range(len(p) - size + 1))
        want = {(k, i) for k, p in enumerate(pieces) for i in range(len(p) - size + 1)
                if count[p[i:i + size]] > 1}
        assert want == {(k, i) for k, a, b in repeated_windows(pieces, size)
                        for i in range(a, b + 1)}


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = list(row)
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    import numpy as np

    rng = random.Random(2)
    for _ in range(100):
        a = [rng.randint(0, 6) for _ in range(rng.randint(1, 90))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 90))]
        assert common_subsequence(np.array(a), np.array(b, int)) == subsequence(a, b)


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 70))))
             for k in range(30)] + [(90, None), (91, ""), (92, "too short")]
    docs, want = [(500, None), (501, ""), (None, items[7][1])], {(None, 7)}
    for i in range(200):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if i % 4 == 0:
            k = rng.randrange(30)
            told = items[k][1].upper().lower().split()
            if i % 8 == 0:  # a changed word in ten
                for p in range(0, len(told), 10):
                    told[p] = "changed"
            at = rng.randint(0, len(own))
            own[at:at] = told
            want.add((i, k))
        docs.append((i, " ".join(own)))
    docs.append(docs[3])
    got = benchmark_leaks(frame(spark, [(*d, 1) for d in docs], "doc_id long, text string, item_id int"),
                          frame(spark, items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found == want and len(got) == len(want)


def test_leak_of_a_paraphrase_needs_the_answer(spark):
    rng = random.Random(5)
    question = [f"q{i}" for i in range(40)]
    told = [w if i % 10 < 7 else f"other{i}" for i, w in enumerate(question)]
    noise = [(10 + i, " ".join(f"n{rng.randint(0, 999)}" for _ in range(60))) for i in range(20)]
    docs = frame(spark, [(1, " ".join([*told, "forty", "two"])), (2, " ".join(told)), *noise])
    items = frame(spark, [(7, " ".join(question), "forty two")],
                  "item_id long, text string, answer string")
    got = benchmark_leaks(docs, items, answer_col="answer").collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]


def test_copies_of_a_large_benchmark_are_found(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(6000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(15, 59)))) for k in range(2040)]
    docs = []
    for k, text in items[::7]:
        own = rng.choices(vocabulary, k=120)
        at = rng.randint(0, len(own))
        docs.append((k, " ".join([*own[:at], text, *own[at:]])))
    got = benchmark_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, k) for k, _ in docs}


def test_passage_in_a_third_of_all_documents_is_found_in_each(spark):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(24)]
    docs = []
    for i in range(600):
        own = [f"w{rng.randrange(200000)}" for _ in range(90)]
        if i % 3 == 0:
            at = rng.randint(0, 90)
            own[at:at] = common
        docs.append((i, " ".join(own)))
    items = frame(spark, [(1, " ".join(common))], "item_id long, text string")
    got = [r["doc_id"] for r in benchmark_leaks(frame(spark, docs), items).collect()]
    assert sorted(got) == list(range(0, 600, 3))


def test_short_items_are_found_as_exact_sequences(spark):
    docs = frame(spark, [(1, "x y who wrote\nThe Raven who wrote the raven"), (2, "who wrote"),
                         (3, "the raven who wrote"), (4, None), (5, "")])
    short = [(7, "Who wrote the raven"), (8, "wrote"), (None, "the raven"), (9, "")]
    want = {(1, 7, 2), (1, 8, 3), (2, 8, 1), (3, 8, 3), (1, None, 4), (3, None, 0)}
    for more in ([], [(10, " ".join(f"q{i}" for i in range(20)))]):
        items = frame(spark, short + more, "item_id long, text string")
        got = benchmark_leaks(docs, items).collect()
        assert {(r["doc_id"], r["item_id"], r["first_word"]) for r in got} == want
        assert len(got) == len(want) and {r["common_share"] for r in got} == {1.0}


def test_leaks_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), frame(spark, [], "item_id long, text string")
    assert benchmark_leaks(docs, items).collect() == []
    some = frame(spark, [(1, "a b c d e f g h i j")], "item_id long, text string")
    assert benchmark_leaks(frame(spark, []), some).collect() == []


def test_families_are_not_trivial():
    sizes = defaultdict(int)
    for _, g in linked(families(3, 8, [4, 12, 40, 150]), 3, 90).values():
        sizes[g] += 1
    assert max(sizes.values()) > 3 and len(sizes) > 8
