import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewgraph.llm import license_scan, quality_rules
from reviewgraph.llm.line_dedup import drop_repeated_lines, line_bitmaps
from reviewgraph.llm.quality_rules import jensen_shannon

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "This line is repeated in many documents"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def lines_kept(rows):
    """Brute force over (id, text): kept lines by row."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(FOLD)
            if len(key) >= 20:
                holders[key].add(-2 ** 63 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keys = [x.strip(SPACE).translate(FOLD) for x in lines]
        mine = -2 ** 63 if i is None else i
        kept = [x for x, k in zip(lines, keys)
                if len(holders[k]) < 3 or max(holders[k]) == mine]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINE_ROWS = [
    (1, f"{LONG}\nfirst own line of its document"), (2, f"  {LONG.upper()}\t\n\n{LONG}"),
    (3, f"head\n{LONG}\r\ntail\n{LONG}"), (4, None), (5, ""), (6, "\n\n"),
    (7, "short\nshort"), (8, "short"), (9, "short"), (9, "short"),
    (10, f"É{LONG}\né{LONG}"), (11, f"É{LONG}"), (12, f"É{LONG}"), (None, LONG), (None, "none"),
    (13, "\n".join(f"line number {k % 50} of a very long text" for k in range(5000))),
    (14, "line number 7 of a very long text"), (15, "x\nline number 7 of a very long text\ny"),
]


def test_lines_match_brute_force(spark):
    rows = frame(spark, [(*r, "keep me", 7) for r in LINE_ROWS],
                 "doc_id long, text string, h1 string, n_lines long")
    got = drop_repeated_lines(rows)
    assert {r["h1"] for r in got.collect()} == {"keep me"}
    told = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()]
    assert Counter(told) == Counter(lines_kept(LINE_ROWS))
    for r in got.collect():
        lines = (r["text"] or "").split("\n")
        assert sum(x["length"] for x in r["keep_runs"]) == len(lines) - r["n_dropped"]


def test_line_in_a_third_of_all_documents(spark):
    """Found in every slice of the documents, and kept in the largest of them all."""
    rows = [(i, f"{LONG}\nown line number {i} of this document" if i % 3 == 0 else f"text {i}")
            for i in range(600)]
    got = drop_repeated_lines(frame(spark, rows))
    told = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()]
    assert Counter(told) == Counter(lines_kept(rows))
    assert [r["doc_id"] for r in got.where("kept_text like 'This line%'").collect()] == [597]


def test_bitmaps_are_runs_of_lines(spark):
    """Every second line of a very long text and then a block of 1,000 go: 2,001 runs."""
    block = "\n".join(f"the {k}th line of a block of lines" for k in range(1000))
    alternating = "\n".join(f"own line\n{LONG}" for _ in range(2000))
    rows = [(1, f"{alternating}\nx\n{block}"), (2, f"{LONG}\n{block}"), (3, f"{LONG}\n{block}")]
    runs = {r["_ld_id"]: [tuple(x) for x in r["_ld_dropped"]]
            for r in line_bitmaps(frame(spark, rows)).collect()}
    assert runs == {1: [(2 * k + 1, 1) for k in range(2000)] + [(4001, 1000)], 2: [(0, 1001)]}


def test_lines_are_streamed_in_the_order_of_their_range(spark):
    """The range exchange feeds a sort and a window, with no exchange between them."""
    plan = line_bitmaps(frame(spark, LINE_ROWS))._jdf.queryExecution().executedPlan().toString()
    ranged = [x.strip(" +-:") for x in plan.split("\n")]
    at = next(i for i, x in enumerate(ranged) if x.startswith("Exchange rangepartitioning"))
    assert [x.split(" ")[0] for x in ranged[at - 2:at]] == ["Window", "Sort"]


def test_lines_of_an_empty_table(spark):
    assert drop_repeated_lines(frame(spark, [])).collect() == []


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1
           for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


RULE_TEXTS = [None, "", " \t\n", "one", "a b c d e", "a b c d e a b c d e",
              "a b c d e f a b c d e g " + " ".join(map(str, range(60))), "x y " * 40,
              "same line here\nsame line here\n \n\nother\nsame line here", "# * $ % & | < > a",
              "né à b \x0b c\x0cd " + " ".join(f"w{i}" for i in range(30)),
              " ".join(f"w{i % 700}" for i in range(3000))]


def test_base_rules_match_brute_force(spark):
    rows = [(i, t, "en" if i % 3 else None, "clash") for i, t in enumerate(RULE_TEXTS * 2)]
    got = quality_rules.quality_rules(
        frame(spark, rows, "doc_id long, text string, lang string, words string"))
    told = {r["doc_id"]: tuple(r)[1:7] for r in got.collect()}
    assert told == {i: base_counts(t) for i, t, *_ in rows}
    assert all(not r["kept"] for r in got.where("base_failed").collect())
    assert got.where("lang IS NULL AND kept = base_failed").count() == 0


def test_divergence_fails_text_unlike_its_language(spark):
    usual = ["the cat and the dog of the house is in the garden and it is the best of all "
             + " ".join(f"the w{i}{k} and of" for k in range(30)) for i in range(40)]
    odd = " ".join(f"Q{k}7! Z{k}9? X0{k};" for k in range(60))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(
        spark, [(i, t, "en") for i, t in enumerate([*usual, odd])],
        "doc_id long, text string, lang string")).collect()}
    assert not got[40]["base_failed"] and not got[40]["kept"]
    assert all(got[i]["kept"] for i in range(40))
    assert got[40]["char_distance"] > got[0]["char_distance"]


def test_common_words_of_any_length(spark):
    texts = [("de", "grundsätzlich und grundsätzlich oder"), ("zh", "这是一个没有空格的很长的句子 这是"),
             ("zh", "这是一个没有空格的很长的句子"), ("th", "ประโยคยาวที่ไม่มีช่องว่าง"), (None, "none")]
    docs = frame(spark, texts, "lang string, text string")
    got = {r["lang"]: r for r in quality_rules.common_words(docs, n=2).collect()}
    assert {k: r["common_words"] for k, r in got.items()} == {
        "de": ["grundsätzlich", "oder"], "zh": ["这是一个没有空格的很长的句子", "这是"],
        "th": ["ประโยคยาวที่ไม่มีช่องว่าง"]}
    assert got["de"]["word_ref"] == [0.5, 0.25, 0.25]


def test_jensen_shannon_distance(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])],
                                 "p array<double>, q array<double>")
    assert [r[0] for r in rows.select(jensen_shannon(F.col("p"), F.col("q"))).collect()] == [1, 0]


def test_rules_of_an_empty_table(spark):
    empty = frame(spark, [], "doc_id long, text string, lang string")
    assert quality_rules.quality_rules(empty).collect() == []


def notices(text):
    def words(x):
        return license_scan.plain(x).lower().split()

    own = words(text)
    own = {tuple(own[i:i + 5]) for i in range(len(own) - 4)}
    out = set()
    for name, told in license_scan.TEMPLATES.items():
        w = words(told)
        s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        if 100 * len(s & own) >= 80 * len(s):
            out.add(name)
    return out


def test_licenses_match_brute_force(spark):
    filler = " ".join(f"word{i}" for i in range(333))
    texts = [None, "", "released under", filler]
    for told in license_scan.TEMPLATES.values():
        w = told.split()
        texts += [told, told.upper(), f"{filler} {told} {filler}", f"{filler}\n{told}",
                  " ".join(w[:len(w) // 2]), " ".join([*w[:-1], "changed"])]
    got = license_scan.license_notices(frame(spark, [(i, t, "x") for i, t in enumerate(texts)],
                                             "doc_id long, text string, license string"))
    found = defaultdict(set)
    for r in got.collect():
        found[r["doc_id"]].add(r["license"])
    assert {i: found[i] for i in range(len(texts))} == {i: notices(t) for i, t in enumerate(texts)}


def test_short_notices_are_found_exactly(spark):
    texts = ["All rights reserved.", "x y\nALL RIGHTS RESERVED\nz all rights, reserved", "all rights",
             "reserved", "all rights are reserved", None, "", "some all rights reserved"]
    got = license_scan.license_notices(frame(spark, list(enumerate(texts))))
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, "all-rights-reserved", 1.0, 0, 1), (1, "all-rights-reserved", 1.0, 2, 2),
        (7, "all-rights-reserved", 1.0, 1, 1)]
    own = license_scan.license_notices(frame(spark, [(1, "a b c d e f g")]),
                                       templates={"one": "G", "four": "b c d e", "five": "a b c d e"})
    assert {r["license"]: r["first_word"] for r in own.collect()} == {"one": 6, "four": 1, "five": 0}
    with pytest.raises(ValueError):
        license_scan.license_notices(frame(spark, []), templates={"none": " ."})


def test_licenses_of_an_empty_table_and_short_templates(spark):
    assert license_scan.license_notices(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        license_scan.prepared({"short": "four words only here"})


def test_digests_of_kept_text(spark):
    row = drop_repeated_lines(frame(spark, [(1, "é\nb")])).select(
        F.sha2("kept_text", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256("é\nb".encode()).hexdigest()
